"""The corpus pipeline: documents in, token ids of the documents that stay out.

Each stage takes what its predecessor kept, as rows of ``documents`` with whatever columns
it has, and its decisions take effect. Columns besides doc_id and text get neutral names
inside a stage, so none can clash with an operator's.

Defined results: rows without text, or with an empty one, pass every stage. Rows are told
apart by their place, not by doc_id: rows that share a doc_id each count as a document, so
different texts both stay and repeated rows are duplicates like any. Of a near-duplicate
group the row with the smallest doc_id stays (rows without one come last), and of several
with that doc_id the first. A score equal to TOXIC is rejected. An empty ``documents``
gives an empty result; empty labels or an empty benchmark reject nothing of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm import decontaminate, near_dups, pieces, secrets, toxicity
from loreloom.llm.staging import shared_dir, staged

TOXIC = 0.5


def _neutral(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """The rows with neutral names for all columns but doc_id and text, and these names."""
    names = [c if c in ("doc_id", "text") else f"kept_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), tuple(c for c in names if c not in ("doc_id", "text"))


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order and types."""
    neutral, _ = _neutral(docs)
    return rows.select(*(F.col(n).cast(f.dataType).alias(f.name) for n, f in zip(neutral.columns, docs.schema.fields, strict=True)))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity is TOXIC or more."""
    rows, kept = _neutral(docs)
    model = toxicity.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _restored(toxicity.score_toxicity(rows, model, ("text", *kept)).where(F.col("score") < TOXIC), docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group keep one row: that with the smallest doc_id, then the first."""
    rows, _ = _neutral(docs)
    rows, _ = staged(rows.withColumn("place", F.monotonically_increasing_id()), "placed", compression="zstd")
    groups = near_dups.near_duplicates(rows.select(F.col("place").alias("doc_id"), "text")).select(F.col("doc_id").alias("place"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "place")
    first = rows.select("place", "doc_id").join(groups, "place").groupBy("component_id").agg(F.min(order).alias("first")).select("first.place")
    return _restored(rows.join(first, "place", "left_semi").drop("place"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    rows, kept = _neutral(docs)
    found = decontaminate.find_overlaps(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=kept)
    return _restored(found.where(F.size("starts") == 0), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mask; n_chars follows."""
    rows, kept = _neutral(docs)
    found = secrets.find_secrets(rows.withColumn("no_text", F.col("text").isNull()), keep=(*kept, "no_text"))
    some = F.size("spans") > 0
    text = F.when(some, secrets.redacted(F.col("text"), F.col("spans"))).when(~F.col("no_text"), F.col("text"))
    found = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        n_chars = f"kept_{docs.columns.index('n_chars')}"
        found = found.withColumn(n_chars, F.when(some, F.length("text")).otherwise(F.col(n_chars)))
    return _restored(found, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and the digests of ids and decoded text."""
    import public_tokenizers

    rows = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.sha2(F.col("decoded").cast("binary"), 256)
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), digest.alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("pieces", encode),
]

#: SQL can express neither the classifier nor the similarity join nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
