"""The links of all notes, kept by the refresh like the index of chunks: a neighbourhood reads no contents.

Links are stored as they are written, with the name that they ask for, and resolved when they
are asked for: a new note may change where the links of others lead, and no row of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import link_target
from ..operators import graph
from ..operators.links import note_name, outgoing
from .refresh import PartIndex


class LinkIndex(PartIndex):
    """An index of the links of all notes."""

    TABLE, ROWS = "links", "target string, pos int, raw string, file_path string"

    def _made(self, fresh: DataFrame) -> DataFrame:
        return outgoing(fresh).select(note_name("cleaned").alias("target"), "pos", "raw", F.col("src").alias("file_path"))

    def links(self, version: int | None = None) -> DataFrame:
        """src, pos, raw, cleaned, target: the links of a version."""
        rows = self._held(self._manifest(self.version() if version is None else version))
        return rows.select(F.col("file_path").alias("src"), "pos", "raw", link_target(F.col("raw")).alias("cleaned"), "target")

    def neighborhood(self, starts: DataFrame, depth: object = 2, direction: str = "both", ordered: bool = False) -> DataFrame:
        """graph.neighborhood of the notes that were indexed last."""
        version = self.version()
        return graph.neighborhood(self.files(version).select("path"), starts, depth, direction, ordered, self.links(version))
