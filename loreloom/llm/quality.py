"""Operator 9: quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words (lower-cased and hashed to ``WORDS`` columns), adjacent pairs
of byte classes (letters, digits, spaces, each mark), words equal to the one before, words
seen before in the text, and words seen first. Term weights are log counts times inverse
document frequency; a singular value decomposition of at most ``SAMPLE`` labelled documents
gives the latent space. Their vectors, a bounded number, are broadcast; every document's
vector is compared with all of them in blocks of exact cosine products, and the
``NEIGHBOURS`` nearest vote with their similarity.

Defined results: a text without terms (empty or null) has no similarity with any and gets
the labelled share of 1; similarities are compared to five decimals, and ties go to the
labelled document with the smaller doc_id, then the smaller text; without labels every
score is 1; repeated rows score alike; a null doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labels import fold, labelled
from .staging import chunks
from .words import SPACED, words_of

SAMPLE, RANK, NEIGHBOURS, WORDS = 4_000, 48, 15, 1_024
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if "a" <= _c <= "z" or _b >= 0x80 else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c == " " else 4 if _b < 0x20 or _b == 0x7F else 5 + sum(1 for x in range(0x21, _b) if not chr(x).isalnum())
CLASSES = int(_CLASS.max()) + 1
TERMS = CLASSES * CLASSES + 3 + WORDS


def counts(texts: list[str | None]) -> np.ndarray:
    """Term counts, a row a text."""
    raw = [b"" if t is None else t.encode() for t in texts]
    n = len(texts)
    size = np.array([len(x) for x in raw], np.int64)
    flat = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(n), size)
    same = doc[1:] == doc[:-1]
    pair = (doc[1:] * TERMS + flat[:-1] * CLASSES + flat[1:])[same] if len(flat) > 1 else np.zeros(0, np.int64)
    words = words_of(texts, SPACED)
    order = np.lexsort((words.hash, words.doc))
    again = np.zeros(len(order), bool)
    if len(order) > 1:
        again[order[1:]] = (words.hash[order[1:]] == words.hash[order[:-1]]) & (words.doc[order[1:]] == words.doc[order[:-1]])
    repeat = np.zeros(len(order), bool)
    if len(order) > 1:
        repeat[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    kind = np.where(repeat, 0, np.where(again, 1, 2))
    extra = words.doc * TERMS + CLASSES * CLASSES + kind
    column = words.doc * TERMS + (TERMS - WORDS) + (words.hash % np.uint64(WORDS)).astype(np.int64)
    return np.bincount(np.r_[pair, extra, column], minlength=n * TERMS).reshape(n, TERMS)


class Model:
    """Latent space, labelled unit vectors in it, and their labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.prior = float(labels.mean()) if len(labels) else 1.0
        self.labels = labels.astype(np.float32)
        seen = (x > 0).sum(0)
        self.idf = np.where(seen > 0, np.log((1 + len(x)) / (1 + seen)) + 1, 0.0).astype(np.float32)
        weighted = self._weights(x)
        values, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        self.axes = np.ascontiguousarray(vectors[:, np.argsort(-values)[:rank]]).astype(np.float32)
        self.vectors = self._unit(weighted @ self.axes)

    def _weights(self, x: np.ndarray) -> np.ndarray:
        """Log counts by the length of the text, so that long and short texts compare."""
        total = np.maximum(x.sum(1, keepdims=True), 1).astype(np.float32)
        return np.log1p(x.astype(np.float32) * (1000 / total)) * self.idf

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return np.where(norm > 0, x / np.maximum(norm, 1e-12), 0).astype(np.float32)

    def score(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(texts), block):
            x = counts(texts[i : i + block])
            own = self._unit(self._weights(x) @ self.axes)
            cosine = np.round(own @ self.vectors.T, 5)
            least = np.partition(cosine, -k, axis=1)[:, -k][:, None]
            near, tied = cosine > least, cosine == least
            near |= tied & (np.cumsum(tied, axis=1) <= k - near.sum(1, keepdims=True))
            vote = np.where(near, np.maximum(cosine, 0), 0).astype(np.float64) ** 4
            total = vote.sum(1)
            some = (total > 0) & (x.sum(1) > 0)
            out[i : i + block][some] = np.clip((vote @ self.labels)[some] / total[some], 0, 1)
        return out


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled documents; their term counts are all the driver gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                rows = [x.astype("<i4").tobytes() for x in counts(batch.column("text").to_pylist())]
                yield pa.record_batch([batch.column("doc_id"), pa.array(rows, pa.binary()), batch.column("label")], names=["doc_id", "x", "label"])

    got = labelled(docs, labels, column, sample).orderBy("doc_id", "text", "label").select("doc_id", "text", "label").mapInArrow(run, "doc_id long, x binary, label int").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), "<i4").reshape(len(got), TERMS)
    return Model(x, np.array([r.label for r in got], np.float64))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of all documents; no exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                yield pa.record_batch([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
