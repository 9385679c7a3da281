"""The activity log: id, timestamp (ISO text), session_id, tool_name, args_json."""

from __future__ import annotations

import itertools
import json
import random
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.versions import Versions
from .catalog import positive

SCHEMA = "id long, timestamp string, session_id string, tool_name string, args_json string"
#: Folders of a day from which it is merged; the part of entries without a date.
FOLDERS, UNDATED = 16, "undated"
_COUNT = itertools.count(random.getrandbits(22))


def day() -> Column:
    """The part of an entry."""
    return F.coalesce(F.when(F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\d"), F.substring("timestamp", 1, 10)), F.lit(UNDATED))


def conditions(tool: str | None = None, session: str | None = None, since: str | None = None, before: str | None = None, path: str | None = None, before_inclusive: bool = True) -> Column:
    """All that are given hold; session is a prefix and path a part, without regard to ASCII case."""
    out = F.lit(True)
    if tool:
        out &= F.col("tool_name") == tool
    if session:
        out &= F.lower("session_id").startswith(session.lower())
    if since:
        out &= F.col("timestamp") >= since
    if before:
        out &= (F.col("timestamp") <= before) if before_inclusive else (F.col("timestamp") < before)
    if path:
        out &= F.lower("args_json").contains(path.lower())
    return F.coalesce(out, F.lit(False))


def query(log: DataFrame, limit: object = 50, **filters) -> DataFrame:
    """The latest entries that match."""
    return log.where(conditions(**filters)).orderBy(F.desc("timestamp"), F.desc("id")).limit(positive(limit, 50))


def kept_after_clear(log: DataFrame, tool: str | None = None, session: str | None = None, before: str | None = None, everything: bool = False) -> DataFrame:
    """What clearing leaves; ``before`` is exclusive. Without a condition, ``everything`` must say so."""
    if not (tool or session or before or everything):
        raise ValueError("clear needs a condition, or everything=True")
    return log.where(~conditions(tool, session, None, before, before_inclusive=False))


class ActivityLog(Versions):
    """The log in a folder of shared storage, in a part for each day; any number of sessions append to it.

    An append writes a folder and names it in the next version; a day with more than ``FOLDERS``
    of them is merged. ``since`` and ``before`` decide which days are listed and read at all.
    Entries whose time doesn't begin with a date are a part of their own, which is always read.
    """

    def __init__(self, spark: SparkSession, folder: str, session: str | None = None):
        super().__init__(spark, folder)
        self.session = session or str(uuid.uuid4())

    def _write(self, entries: DataFrame, name: str) -> list[str]:
        """Write entries by day and name the days; a day with very many is split over tasks."""
        to = f"data/{name}"
        entries.select("id", "timestamp", "session_id", "tool_name", "args_json", day().alias("day")).hint("rebalance", "day").write.partitionBy("day").parquet(f"{self.folder}/{to}")
        return [n.removeprefix("day=") for n in (s.getPath().getName() for s in self._store().listStatus(self._path(to))) if n.startswith("day=")]

    def _rows(self, live: dict[str, list]) -> DataFrame:
        paths = [f"{self.folder}/data/{name}/day={day}" for day, folders in live.items() for _, name in folders]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def append(self, entries: DataFrame) -> int:
        """Add entries (SCHEMA); the version that has them. None change nothing."""
        name = uuid.uuid4().hex
        days = self._write(entries, name)
        if not days:
            self._store().delete(self._path(f"data/{name}"), True)
            return self.version()

        def add(manifest: dict) -> None:
            for d in days:
                manifest["live"].setdefault(d, []).append([manifest["version"], name])

        version = self._commit(add)
        return self.compact(FOLDERS) or version

    def record(self, tool: str, args: dict) -> None:
        """Add one call of a tool."""
        self.append(entry(self.spark, tool, args, self.session))

    def read(self, since: str | None = None, before: str | None = None, version: int | None = None) -> DataFrame:
        """Entries of the days that may hold times from ``since`` to ``before``."""
        return self._rows(_days(self._manifest(self.version() if version is None else version)["live"], since, before))

    def query(self, limit: object = 50, **filters) -> DataFrame:
        """The latest entries that match, from the days that may hold them."""
        return query(self.read(filters.get("since"), filters.get("before")), limit, **filters)

    def clear(self, tool: str | None = None, session: str | None = None, before: str | None = None, everything: bool = False) -> int:
        """Remove entries as kept_after_clear says; how many. Days without one stay as they are, as does what others add meanwhile."""
        live = _days(self._manifest(self.version())["live"], None, before)
        rows = self._rows(live)
        kept = kept_after_clear(rows, tool, session, before, everything)
        gone = conditions(tool, session, None, before, before_inclusive=False)
        lost = {r.day: r.n for r in rows.where(gone).groupBy(day().alias("day")).agg(F.count("*").alias("n")).collect()}  # a row a day
        if lost:
            self._replace({d: live[d] for d in lost}, kept.where(day().isin(*lost)))
        return sum(lost.values())

    def compact(self, most: int = 1) -> int | None:
        """Merge the folders of every day that has more than ``most``; the new version, if any."""
        old = {d: f for d, f in self._manifest(self.version())["live"].items() if len(f) > most}
        return self._replace(old, self._rows(old)) if old else None

    def _replace(self, old: dict[str, list], rows: DataFrame) -> int:
        """Put rows in place of the folders of some days."""
        name = uuid.uuid4().hex
        days = self._write(rows, name)

        def replace(manifest: dict) -> None:
            for d, folders in old.items():
                self._merge(manifest, d, folders, [[folders[-1][0], name]] if d in days else [])
                if not manifest["live"][d]:
                    del manifest["live"][d]

        return self._commit(replace)


def _days(live: dict[str, list], since: str | None, before: str | None) -> dict[str, list]:
    """The parts that may hold times from ``since`` to ``before``: texts compare as their first ten characters do."""
    return {d: f for d, f in live.items() if d == UNDATED or (not since or d >= since[:10]) and (not before or d <= before[:10])}


def record(spark: SparkSession, folder: str, tool: str, args: dict, session: str | None = None) -> None:
    """Append one entry to the log in a folder of shared storage."""
    ActivityLog(spark, folder, session).record(tool, args)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The log in a folder."""
    return ActivityLog(spark, folder).read()


def entry(spark: SparkSession, tool: str, args: dict, session: str | None = None) -> DataFrame:
    """One log entry. Its id begins with the time in milliseconds and ends with a count that starts anywhere."""
    now = datetime.now(UTC)
    millis = int(now.timestamp() * 1000)
    stamp = now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{millis % 1000:03d}Z"
    row = ((millis << 22) + next(_COUNT) % (1 << 22), stamp, session or str(uuid.uuid4()), tool, json.dumps(args, default=str))
    return spark.createDataFrame([row], SCHEMA).coalesce(1)
