"""Operator 10: secret scans with DataFrame functions only.

Three patterns give the base spans; two character Markov models add what they miss. One
model is of random strings, one of ordinary words and identifiers; a candidate, a run of
``MIN_RUN`` or more token characters, is a secret where the log-likelihood ratio of its
adjacent characters is ``MIN_RATIO`` or more and ``MIN_RATE`` or more a pair, as a whole or in a
part between separators. UUIDs in it, and runs of numbers alone (dates, telephone
numbers), are ordinary.

Training: random strings are made by rule (hex, base 64 and base 62 of digests); ordinary
ones are ``IDENTIFIERS`` (also where names meet numbers) and the words of at most ``SAMPLE`` documents, taken by the hash
of their text, with base matches and candidates removed and cased as words are, alone and joined as
identifiers are. Counting is a Spark
aggregation; the driver gets one row a pair of characters at most. Scoring looks ratios
up in a constant array. All documents are scanned, whole.

Defined results: a null text counts as empty; spans are in code points, end exclusive,
ordered by start, then kind (assign, access, hex, markov); candidates are cut at the edges
of base spans, and what is left outside them is scored if it still has ``MIN_RUN``
characters; repeated rows each keep a row; other columns are ignored; an empty table gives
no rows; texts of any length are scanned whole.
"""

from __future__ import annotations

import builtins
import keyword
import math
import sys
from collections.abc import Iterable
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import lowest, tasks

#: kind, pattern, group to measure (1: the whole match), its least length.
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
KINDS = (*(k for k, *_ in BASE), "markov")
MIN_RUN = 12
RUN = rf"((?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{{{MIN_RUN},}})"  # looking back first, each run is tried once
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+/-"
#: A secret's least log-likelihood ratio, in all and for each pair of characters.
MIN_RATIO, MIN_RATE, BACKED = 20.0, 1.2, 10.0
#: Characters for each separator from which a run is scored as a whole, too: names have more of them than random strings.
APART = 8
#: Identifiers made of random digits by a public rule, which are no secrets; and runs of numbers, as in dates, times and telephone numbers.
UUID, NUMBERS = "(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", "^[0-9TZ_+/-]*$"
SAMPLE = 500
NAMES = sorted({*sys.stdlib_module_names, *keyword.kwlist, *dir(builtins), *dir(F), *dir(str)})
#: How names meet numbers in paths, versions and identifiers: two letters before, then these with numbers and two letters.
FORMS = ("{0}", "_{0}_{1}", "-{2}-{0}/{1}{2}", "/{1}{2}{1}", "{2}{1}_{0}")
#: Ordinary whatever the documents hold: public names, where names meet numbers, dates, numbers, and rules drawn with one character.
IDENTIFIERS = [
    *NAMES,
    *(a[-2:] + FORMS[i % len(FORMS)].format(i % 97, b[:2], i % 10) for i, (a, b) in enumerate(pairwise(NAMES))),
    *(f"{2000 + i % 40}-{i % 12 + 1:02}-{i % 28 + 1:02}T{i % 24:02}-{i % 60:02}-{i * 7 % 60:02}Z" for i in range(500)),
    *(str(i * 7919) for i in range(500)),
    *(c * (800 if c in "-_/+" else 160) for c in ALPHABET),
]
SPAN = "array<struct<start:int,rank:int,end:int>>"
#: Spans with their text.
RUNS = "array<struct<start:int,rank:int,end:int,s:string>>"


def _matches(text: Column, pattern: str, group: int, least: int, rank: int, texts: bool = False) -> Column:
    """Spans of the leftmost, non-overlapping matches whose group is long enough.

    What splitting by the pattern leaves and what it matches alternate, so their lengths
    add up to the places. The group is measured in the match alone. With texts, for matches
    that most texts have, the spans carry theirs; else a text without a match is read once.
    """
    left, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = (lambda w: F.length(w)) if group == 1 else (lambda w: F.length(F.regexp_extract(w, pattern, group)))
    steps = F.zip_with(F.slice(left, 1, F.size(left) - 1), whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("n"), part(w).alias("part"), w.alias("s")))
    none = F.array().cast(RUNS if texts else SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["n"]
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), *([x["s"].alias("s")] if texts else [])))
        return F.struct(end.alias("at"), F.when(x["part"] >= least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(steps, start, step, lambda acc: acc["spans"])
    return found if texts else F.when(text.rlike(pattern), found).otherwise(none)


def _pairs(strings: DataFrame, label: str) -> DataFrame:
    """Counts of adjacent character pairs (a, b: places in ALPHABET) of column ``s``."""
    two = F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr(F.col("s"), i, F.lit(2))))
    return strings.where(F.length("s") >= 2).select(two.alias("p")).groupBy("p").agg(F.count("*").alias("n")).select("p", "n", F.lit(label).alias("label"))


def labelled_strings(docs: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Random and ordinary strings, one a row in column ``s``."""
    spark = docs.sparkSession
    seed = spark.range(2_000, numPartitions=1).select(F.sha2(F.col("id").cast("string"), 512).alias("h"))
    binary = F.unhex(F.substring("h", 1, 96))
    sixty_two = F.regexp_replace(F.base64(binary).cast("string"), "[+/=]", "")
    kinds = [F.substring("h", 1, 40), F.regexp_replace(F.base64(binary).cast("string"), "=", ""), sixty_two, F.translate(F.base64(binary).cast("string"), "+/=", "-_")]
    random = seed.select(F.explode(F.array(*kinds)).alias("s"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"))
    few = lowest(texts, F.xxhash64("text"), sample).repartition(tasks(spark))
    plain = F.col("text")
    for _, pattern, *_ in BASE:
        plain = F.regexp_replace(plain, pattern, " ")
    usual = F.filter(F.regexp_extract_all(plain, F.lit("([A-Za-z0-9]{3,})"), F.lit(1)), lambda x: (F.length(x) < MIN_RUN) & x.rlike("^([A-Z]?[a-z]+|[A-Z]+|[0-9]+)$"))
    words = few.select(usual.alias("w")).where(F.size("w") > 1)
    joined = F.transform(F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("x"), F.slice("w", 2, F.size("w") - 1).alias("y")), lambda p: F.element_at(F.array(*(F.concat_ws(j, p["x"], p["y"]) for j in "_-/"), F.concat(p["x"], F.initcap(p["y"])), F.upper(F.concat_ws("_", p["x"], p["y"]))), (F.pmod(F.hash(p["x"]), F.lit(5)) + 1).cast("int")))
    names = spark.createDataFrame([(x,) for x in IDENTIFIERS], "s string").coalesce(1)
    return random, words.select(F.explode(F.concat("w", joined)).alias("s")).unionByName(names)


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratios of each pair of characters, one row of ALPHABET after another."""
    random, ordinary = labelled_strings(docs, sample)
    rows = _pairs(random, "random").unionByName(_pairs(ordinary, "ordinary")).collect()  # at most 2 * 66 * 66 and few more
    return ratios((r.label, r.p, r.n) for r in rows)


def ratios(counts: Iterable[tuple[str, str, int]]) -> list[float]:
    """From counts by label and pair: log P(b | a, random) - log P(b | a, ordinary).

    Rare first characters fall back to how often the second one is with this label at all:
    BACKED such observations are added to each row, so little training is enough.
    """
    n, place = len(ALPHABET), {c: i for i, c in enumerate(ALPHABET)}
    table = {label: [[0.0] * n for _ in range(n)] for label in ("random", "ordinary")}
    for label, pair, count in counts:
        if pair[0] in place and pair[1] in place:
            table[label][place[pair[0]]][place[pair[1]]] += count
    logs = {}
    for label, rows in table.items():
        second = [0.5 + sum(row[b] for row in rows) for b in range(n)]
        share = [x / sum(second) for x in second]
        logs[label] = [[math.log((x + BACKED * p) / (sum(row) + BACKED)) for x, p in zip(row, share, strict=True)] for row in rows]
    return [logs["random"][a][b] - logs["ordinary"][a][b] for a in range(n) for b in range(n)]


def ratio(string: Column, table: Column) -> Column:
    """The log-likelihood ratio of a run of ALPHABET characters; table: the constant array of ratios()."""
    at = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    pair = F.zip_with(F.slice(at, 1, F.length(string) - 1), F.slice(at, 2, F.length(string) - 1), lambda a, b: F.get(table, a * len(ALPHABET) + b))
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def is_secret(run: Column, table: Column) -> Column:
    """Whether a run, or a part of it between separators, is random enough, in all and for each pair.

    A long ordinary run adds up to MIN_RATIO in time, so the rate counts too. Parts count as a
    secret may end a long path; a run with many separators counts by its parts alone.
    """

    def random(s: Column) -> Column:
        return (F.length(s) >= MIN_RUN) & (ratio(s, table) >= F.greatest(F.lit(MIN_RATIO), MIN_RATE * (F.length(s) - 1)))

    rest = F.regexp_replace(run, UUID, "/")
    dense = APART * F.length(F.regexp_replace(rest, "[^_+/-]", "")) <= F.length(rest)
    return ~rest.rlike(NUMBERS) & ((dense & random(rest)) | F.exists(F.split(rest, "[_+/-]"), random))


def _outside(run: Column, base: Column) -> Column:
    """The parts of a run between the base spans (ordered) that overlap it, as far as they have MIN_RUN characters."""
    start = F.struct(run["start"].alias("at"), F.array().cast(RUNS).alias("parts"))

    def part(begin: Column, end: Column, parts: Column) -> Column:
        own = F.array(F.struct(begin.alias("start"), run["rank"].alias("rank"), end.alias("end"), F.substr(run["s"], begin - run["start"] + 1, end - begin).alias("s")))
        return F.when(end - begin >= MIN_RUN, F.concat(parts, own)).otherwise(parts)

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), part(acc["at"], b["start"], acc["parts"]).alias("parts"))

    among = F.filter(base, lambda b: (b["start"] < run["end"]) & (b["end"] > run["start"]))
    return F.aggregate(among, start, step, lambda acc: part(acc["at"], run["end"], acc["parts"]))


def find_secrets(docs: DataFrame, sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the kept columns, text, base (spans) and spans (base and Markov ones), each ordered.

    Narrow: no exchange but the two small ones of the training.
    """
    table = F.split(F.lit(",".join(map(repr, train(docs, sample)))), ",").cast("array<double>")  # folded to a constant
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        rows = rows.withColumn(kind, _matches(F.col("text"), pattern, group, least, rank))
    rows = rows.withColumn("base", F.array_sort(F.concat(*(kind for kind, *_ in BASE))))
    # Runs need places only where one is a secret, or a base span may cut one.
    secret = F.exists(F.regexp_extract_all("text", F.lit(RUN), F.lit(1)), lambda r: is_secret(r, table))
    rows = rows.withColumn("runs", F.when((F.size("base") > 0) | secret, _matches(F.col("text"), RUN, 1, MIN_RUN, len(BASE), texts=True)).otherwise(F.array().cast(RUNS)))
    apart = F.when(F.size("base") > 0, F.flatten(F.transform("runs", lambda r: _outside(r, F.col("base"))))).otherwise(F.col("runs"))
    added = F.transform(F.filter(apart, lambda r: is_secret(r["s"], table)), lambda r: F.struct(r["start"], r["rank"], r["end"]))
    return rows.withColumn("spans", F.array_sort(F.concat("base", added))).select("doc_id", *keep, "text", "base", "spans", *(kind for kind, *_ in BASE))


def named(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping ones, replaced by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        out = F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], out).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(named("base").cast("binary"), 256).alias("base_sha256"), named("spans").alias("spans"))
