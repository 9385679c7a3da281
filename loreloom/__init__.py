"""Spark-native analytics over linked, front-matter-annotated notes."""
