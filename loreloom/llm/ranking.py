"""Positions of rows in a total order and in their groups, without gathering a group.

Rows are dealt by range, so a group with a third of all rows lies in many partitions; what
joins them is one row for each partition and group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged, tasks

#: monotonically_increasing_id has a row's place in its partition in so many bits.
_PLACE = 33


class Ranked:
    """``rows`` ordered by ``group`` (not null) and then by ``order``, written to shared storage.

    ``groups`` has for each group its value, ``start`` (place of its first row among all
    rows) and ``n`` (rows). ``order`` must tell all rows apart, or rows that it doesn't
    tell apart must be equal in every column.
    """

    def __init__(self, rows: DataFrame, group: str, order: list[str]):
        keys = [group, *order]
        dealt = rows.repartitionByRange(tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys)
        self._group, at = group, F.col("_at")
        placed = dealt.withColumn("_at", F.monotonically_increasing_id())
        self._rows, _ = staged(placed.select("*", F.shiftright(at, _PLACE).alias("_part"), at.bitwiseAND((1 << _PLACE) - 1).alias("_slot")).drop("_at"), "ranked", compression="zstd")
        spans, _ = staged(self._rows.groupBy("_part", group).agg(F.min("_slot").alias("_first"), F.count("*").alias("_rows")), "spans")
        sizes = {r[0]: r[1] for r in spans.groupBy("_part").agg(F.sum("_rows")).collect()}  # a row for each partition
        before, total = {}, 0
        for part in sorted(sizes):
            before[part], total = total, total + sizes[part]
        self.total = total
        offsets = rows.sparkSession.createDataFrame(sorted(before.items()), "_part long, _before long")
        self._spans = spans.join(F.broadcast(offsets), "_part").withColumn("_first", F.col("_before") + F.col("_first"))
        self.groups, _ = staged(self._spans.groupBy(group).agg(F.min("_first").alias("start"), F.sum("_rows").alias("n")), "groups")
        self._offsets = offsets

    def attach(self, groups: DataFrame | None = None) -> DataFrame:
        """The rows with ``position`` in their group (from 0) and the columns of ``groups``.

        ``groups`` is ``self.groups`` with more columns and without some rows: rows of groups
        that it lacks are left out. The join's keys are partition and group, so none is hot.
        """
        groups = self.groups if groups is None else groups
        own = self._spans.select("_part", self._group).join(groups, self._group)
        rows = self._rows.join(own, ["_part", self._group]).join(F.broadcast(self._offsets), "_part")
        return rows.withColumn("position", F.col("_before") + F.col("_slot") - F.col("start")).drop("_part", "_slot", "_before")
