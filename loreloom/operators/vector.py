"""Semantic search over chunks (id, file_path, heading, content_preview, embedding) and its blend with the graph."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, round3
from .graph import proximity

Embedder = Callable[[list[str]], np.ndarray]
CANDIDATES = 50


def hash_embedder(dim: int = 256) -> Embedder:
    """Unit vectors of hashed words: the embedder where no model is at hand."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


class Busy(RuntimeError):
    """The embedding service asks to come back later."""


class Refused(ValueError):
    """The embedding service can't embed a text of the batch."""


def served(call: Callable[[list[str], float], list[tuple[int, list[float]]]], batch: int = 128, tries: int = 3, timeout: float = 30.0, wait: Callable[[float], None] = time.sleep) -> Embedder:
    """An embedder that asks a service for ``batch`` texts at a time.

    ``call(texts, timeout)`` gives the vectors with the place of their text, in any order. Where it
    is Busy or takes longer than ``timeout`` seconds (TimeoutError), it is asked again after 1, 2,
    4, ... seconds, ``tries`` times in all. An answer that leaves a text out, or has one twice, is an error.
    """

    def ask(texts: list[str]) -> list[list[float]]:
        for attempt in range(tries):
            try:
                found = sorted(call(texts, timeout), key=lambda x: x[0])
            except (Busy, TimeoutError):
                if attempt + 1 == tries:
                    raise
                wait(2.0**attempt)
                continue
            if [i for i, _ in found] != list(range(len(texts))):
                raise RuntimeError(f"{len(found)} vectors for {len(texts)} texts, or not one for each")
            return [v for _, v in found]
        raise ValueError("tries: at least one")

    return lambda texts: np.asarray([v for i in range(0, len(texts), batch) for v in ask(texts[i : i + batch])], float)


def _sound(embedder: Embedder, texts: list[str]) -> list[np.ndarray | None]:
    """The vectors of texts, None for those that the service refuses: a refused batch is halved until these are alone."""
    try:
        return [v.astype(np.float32) for v in embedder(texts)]
    except Refused:
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return _sound(embedder, texts[:half]) + _sound(embedder, texts[half:])


def embedded(rows: DataFrame, text: str, embedder: Embedder, batch: int = 128) -> DataFrame:
    """The rows with ``embedding``, made by an embedder in batches; null for a text that is refused. Any other failure fails the task, which Spark repeats."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in _sound(embedder, texts[i : i + batch])]
            yield pd.Series(vectors, index=part.index, dtype=object)

    return rows.withColumn("embedding", embed(text))


def distance(a: Column, vector: list[float]) -> Column:
    """Euclidean, in double precision."""
    other = F.array(*(F.lit(float(x)) for x in vector))
    squares = F.zip_with(a.cast("array<double>"), other, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def search_raw(chunks: DataFrame, vector: list[float], limit: int = 5, folder: str | None = None, threshold: float | None = None, exclude: list[str] | None = None, prefilter: bool = False) -> DataFrame:
    """path, heading, score, preview: the nearest chunk of each of the nearest files.

    The nearest min(3 * limit, 50) chunks are taken first; folder, threshold and excluded
    files filter these, so fewer than ``limit`` may stay. prefilter applies folder and
    excluded files before. Chunks with a vector of another length never match.
    """
    keep = F.lit(True)
    if folder:
        keep &= F.col("file_path").startswith(folder.rstrip("/") + "/")
    if exclude:
        keep &= ~F.col("file_path").isin(*exclude)
    rows = chunks.where(F.size("embedding") == len(vector))
    rows = rows.where(keep) if prefilter else rows
    near = rows.select("id", "file_path", "heading", "content_preview", distance(F.col("embedding"), vector).alias("d")).orderBy("d", "id").limit(min(3 * limit, CANDIDATES))
    score = F.least(F.greatest(1 - F.col("d") / 2, F.lit(0.0)), F.lit(1.0))
    near = near.withColumn("score", score).where(keep)
    if threshold:
        near = near.where(F.col("score") >= threshold)
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("file_path").orderBy("d", "id"))).where("n = 1")
    return best.orderBy("d", "id").limit(limit).select(F.col("file_path").alias("path"), "heading", round3(F.col("score")).alias("score"), F.col("content_preview").alias("preview"))


def blend(hits: DataFrame, nodes: DataFrame, weight: float = 0.3, limit: int = 5) -> DataFrame:
    """Hits with depth (null outside the graph) and combined: the weighted mean of score and proximity."""
    if not 0 <= weight <= 1:
        raise ValueError("graph_weight must lie between 0 and 1")
    depth = nodes.groupBy("path").agg(F.min("depth").alias("depth"))
    joined = hits.join(depth, "path", "left")
    combined = round3(F.col("score") * (1 - weight) + proximity(F.col("depth")) * weight)
    return joined.withColumn("combined", combined).orderBy(F.desc("combined"), F.desc("score"), "path").limit(limit)


def unlinked(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits outside a neighbourhood."""
    return hits.join(nodes.select("path"), "path", "left_anti")


def suggestions(hits: DataFrame, linked_names: DataFrame, limit: int = 5) -> DataFrame:
    """Hits whose name (lower-case, without .md) is not among ``linked_names`` (name)."""
    own = hits.withColumn("name", F.lower(basename(F.col("path"))))
    return own.join(linked_names.select("name").distinct(), "name", "left_anti").drop("name").orderBy(F.desc("score"), "path").limit(limit)
