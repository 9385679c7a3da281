"""Bounded labelled samples for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import lowest, staged


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; rows of fold 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample: int) -> DataFrame:
    """doc_id, text, label (0 or 1) and fold of at most ``sample`` labelled documents that aren't held out.

    The labels with the least hashes of doc_id are taken first, so the side that the join
    broadcasts has ``sample`` rows at most, whatever the tables hold. Null labels, ids and
    texts are left out; a doc_id with several labels or texts gives a row for each.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    some = lowest(some.where(fold(F.col("doc_id")) != 0), F.xxhash64("doc_id"), sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    joined = texts.join(F.broadcast(some), "doc_id").select("doc_id", "text", "label", fold(F.col("doc_id")).cast("int").alias("fold"))
    return staged(joined, f"labelled-{column}")[0]
