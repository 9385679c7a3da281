"""Operator 4: toxicity by a weighted finite-state grammar over clauses.

Words have classes: insult and threat (given ones, and words and word beginnings that
labelled documents teach, with weights), target, negation, report. A learned word is a
threat if toxic documents have a target behind it more often than before it. Five
transducers read a clause's classes side by side; their composition, a product machine over
all joint states, is built once as one table. It puts out which of ``FACTORS`` apply to an
insult or threat word: behind an insult, a target in reach, a threat without one, behind a
negation, in reported speech. Such a word scores its weight times its factors, a clause the
sum; a document's features are taken from its clauses' scores, never from words on their
own, and a logistic function turns them into a score from 0 to 1.

Training: at most ``SAMPLE`` labelled documents (fold 0 is held out). Folds 1 to 3 teach
words, in a Spark aggregation of which only the at most ``LEXICON`` most telling entries
reach the driver; fold 4 fits the factors, each in turn on a grid, and the function. What
isn't seen there keeps its first value, as a distance from it costs likelihood.

Defined results: an empty or null text has no clause and gets the score of a document
without any; rows are independent, so repeated rows score alike; without any labels the
given words and first factors count; a null doc_id is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labels import fold, labelled
from .staging import chunks
from .words import ALNUM, Words, words_of

SAMPLE, LEXICON = 8_000, 5_000
#: Least likelihood-ratio statistic and weight of a learned entry.
TELLING, LEAST = 25.0, 1.5
STEMS = (6, 8)
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
GIVEN = {
    INSULT: "idiot idiots moron morons stupid dumb fool loser losers scum trash worthless pathetic disgusting clown vermin imbecile pig jerk dumm trottel abschaum débile crétin ordure imbécil basura estúpido",
    THREAT: "kill hurt destroy beat smash burn hang shoot stab crush töten schlagen tuer frapper matar golpear",
    TARGET: "you your yours yourself u he she they them him her his their these those people everyone du dich dein ihr euch sie tu toi te vous ils elles usted tú ustedes ellos",
    NEGATION: "not no never nobody isn aren wasn don doesn didn won without nicht kein keine nie ne pas jamais nunca jamás sin",
    REPORT: "said says say wrote writes claimed claims called quoted according reported alleged sagte schrieb laut dit écrit selon dijo escribió según",
}
_CLAUSE = np.zeros(256, bool)
_CLAUSE[[ord(c) for c in ".!?;:\n"]] = True


#: First values of the factors, by name; the number of a factor is its place.
FACTORS = {"repeated": 1.2, "targeted": 1.3, "untargeted threat": 0.3, "negated": 0.4, "reported insult": 0.6, "reported threat": 0.5}
GRID = (0.1, 0.2, 0.4, 0.7, 1.0, 1.4, 2.0)
#: Log-likelihood that a factor must gain to move by a ratio of e.
STIFF = 1.0


class Transducer:
    """States with a transition and at most one factor (its name) for each class of word; classes not named keep the state."""

    def __init__(self, start: int, moves: dict[tuple[int, int], int], factors: dict[tuple[int, int], str], fade: dict[int, int] | None = None):
        self.start, self.moves, self.factors, self.fade = start, moves, factors, fade or {}
        self.states = sorted({start, *self.fade, *self.fade.values(), *(s for s, _ in moves), *moves.values(), *(s for s, _ in factors)})

    def read(self, state: int, kind: int) -> tuple[int, str | None]:
        return self.moves.get((state, kind), self.fade.get(state, state)), self.factors.get((state, kind))


def compose(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """Next state and set of factors (a bit each) by joint state and class; joint state 0 is the start."""
    joint = sorted(product(*(t.states for t in parts)), key=lambda s: s != tuple(t.start for t in parts))
    number = {s: i for i, s in enumerate(joint)}
    bit = {name: 1 << i for i, name in enumerate(FACTORS)} | {None: 0}
    moves, masks = np.zeros((len(joint), 6), np.int32), np.zeros((len(joint), 6), np.int32)
    for s, kind in product(joint, range(6)):
        read = [t.read(x, kind) for t, x in zip(parts, s, strict=True)]
        moves[number[s], kind] = number[tuple(x for x, _ in read)]
        masks[number[s], kind] = sum(bit[f] for _, f in read)
    return moves, masks


def grammar() -> tuple[np.ndarray, np.ndarray]:
    """The composition of the five transducers."""
    insult = Transducer(0, {(0, INSULT): 1, (1, INSULT): 1}, {(1, INSULT): "repeated"}, {1: 0})
    target = Transducer(0, {(s, TARGET): 4 for s in range(5)}, {(s, INSULT): "targeted" for s in range(1, 5)}, {4: 3, 3: 2, 2: 1, 1: 0})
    threat = Transducer(0, {(s, TARGET): 4 for s in range(5)}, {(0, THREAT): "untargeted threat"}, {4: 3, 3: 2, 2: 1, 1: 0})
    negation = Transducer(0, {(s, NEGATION): 3 for s in range(4)}, {(s, k): "negated" for s in (1, 2, 3) for k in (INSULT, THREAT)}, {3: 2, 2: 1, 1: 0})
    report = Transducer(0, {(0, REPORT): 1}, {(1, INSULT): "reported insult", (1, THREAT): "reported threat"})
    return compose([insult, target, threat, negation, report])


def products(factors: np.ndarray) -> np.ndarray:
    """The product of each set of factors."""
    bits = np.arange(1 << len(factors))[:, None] >> np.arange(len(factors)) & 1
    return np.prod(np.where(bits, factors, 1.0), axis=1)


def _words(texts: list[str | None]) -> Words:
    return words_of([None if t is None else t.lower() for t in texts], ALNUM, lower=False)


def _starts(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first n bytes of the words that are longer, and which words these are."""
    longer = np.flatnonzero(words.end - words.begin > n)
    raw = np.frombuffer(words.data, np.uint8)
    h = np.full(len(longer), 0x811C9DC5 + n, np.uint64)
    for i in range(n):
        h = (h ^ raw[words.begin[longer] + i]) * np.uint64(0x100000001B3)
    return h ^ (h >> np.uint64(29)), longer


class Lexicon:
    """Class and weight of words by hash, and of word beginnings."""

    def __init__(self, learned: list[tuple[int, float, int]]):
        entries: dict[int, tuple[int, float]] = {int(np.int64(h)): (kind, w) for h, w, kind in learned}
        for kind, names in GIVEN.items():
            for h in _words([names]).hash.view(np.int64).tolist():
                entries[h] = kind, max(2.0, entries.get(h, (0, 0.0))[1]) if kind in (INSULT, THREAT) else 0.0
        keys = np.array(sorted(entries), np.int64)
        self.keys = keys
        self.kind = np.array([entries[k][0] for k in keys.tolist()], np.int8)
        self.weight = np.array([entries[k][1] for k in keys.tolist()])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class (0 if unknown) and weight of each hash."""
        h = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        return np.where(known, self.kind[at], 0), np.where(known, self.weight[at], 0.0)

    def read(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        kind, weight = self.find(words.hash)
        for n in STEMS:
            h, longer = _starts(words, n)
            k, w = self.find(h)
            new = (kind[longer] == OTHER) & (k != OTHER)
            kind[longer[new]], weight[longer[new]] = k[new], 0.7 * w[new]
        return kind, weight


FEATURES = 5


class Hits:
    """The insult and threat words of some texts: text, clause, weight and set of factors of each; and the texts' numbers of words."""

    def __init__(self, doc: np.ndarray, clause: np.ndarray, weight: np.ndarray, mask: np.ndarray, n_words: np.ndarray):
        self.doc, self.clause, self.weight, self.mask, self.n_words = doc, clause, weight, mask, n_words


def matched(texts: list[str | None], lexicon: Lexicon, machine: tuple[np.ndarray, np.ndarray]) -> Hits:
    """What the machine puts out over each clause; clauses are numbered through all texts."""
    words = _words(texts)
    moves, masks = machine
    kind, weight = lexicon.read(words) if len(words.hash) else (np.zeros(0, np.int8), np.zeros(0))
    edge = np.r_[0, np.cumsum(_CLAUSE[np.frombuffer(words.data, np.uint8)])]
    clause = edge[words.begin] if len(words.hash) else np.zeros(0, np.int64)
    hit = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    of, place = [], []
    for c in np.unique(clause[hit]).tolist():
        a, b = np.searchsorted(clause, [c, c + 1]).tolist()
        state = 0
        for i, k in enumerate(kind[a:b].tolist(), a):
            if k in (INSULT, THREAT):
                place.append(i)
                of.append(masks[state, k])
            state = moves[state, k]
    at = np.array(place, np.int64)
    return Hits(words.doc[at], clause[at], weight[at], np.array(of, np.int64), words.counts())


def features(hits: Hits, factors: np.ndarray) -> np.ndarray:
    """By text: log of the sum, the greatest and the log of the number of scored clauses' scores, the sum a word, a constant."""
    n = len(hits.n_words)
    score = hits.weight * products(factors)[hits.mask]
    first = np.flatnonzero(np.r_[True, hits.clause[1:] != hits.clause[:-1]]) if len(score) else np.zeros(0, np.int64)
    sums = np.add.reduceat(score, first) if len(first) else score
    doc, most = hits.doc[first], np.zeros(n)
    np.maximum.at(most, doc, sums)
    total = np.bincount(doc, weights=sums, minlength=n)
    return np.c_[np.log1p(total), np.minimum(most, 20) / 4, np.log1p(np.bincount(doc, minlength=n)), np.sqrt(total / np.maximum(hits.n_words, 20)), np.ones(n)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic function by Newton steps; half a row of either label keeps them finite."""
    x, y = np.r_[x, x[:1] * 0 + np.eye(FEATURES)[-1:], x[:1] * 0 + np.eye(FEATURES)[-1:]], np.r_[y, 0.0, 1.0]
    w = np.zeros(FEATURES)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * len(y) * w * (np.arange(FEATURES) < FEATURES - 1)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(FEATURES), grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fitted(hits: Hits, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors and weights of the logistic function that labelled texts are likeliest by."""
    first = np.array(list(FACTORS.values()))

    def loss(factors: np.ndarray) -> float:
        x = features(hits, factors)
        z = np.clip(x @ _logistic(x, labels), -30, 30)
        return float(np.logaddexp(0, z).sum() - (z * labels).sum() + STIFF * (np.log(factors / first) ** 2).sum())

    factors, best = first.copy(), loss(first)
    for _ in range(2):
        for j in range(len(factors)):
            for value in GRID:
                tried = factors.copy()
                tried[j] = value
                if (now := loss(tried)) < best - 1e-9:
                    factors, best = tried, now
    return factors, _logistic(features(hits, factors), labels)


class Model:
    def __init__(self, lexicon: Lexicon, factors: np.ndarray, weights: np.ndarray):
        self.lexicon, self.factors, self.weights, self.machine = lexicon, factors, weights, grammar()

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(matched(texts, self.lexicon, self.machine), self.factors) @ self.weights, -30, 30)))


def _near(flags: np.ndarray, doc: np.ndarray, steps: range) -> np.ndarray:
    """Is a flag set so many words further on in the same text?"""
    out = np.zeros(len(flags), bool)
    for k in steps:
        a, b = (slice(None, -k), slice(k, None)) if k > 0 else (slice(-k, None), slice(None, k))
        out[a] |= flags[b] & (doc[a] == doc[b])
    return out


def learned_entries(rows: DataFrame) -> list[tuple[int, float, int]]:
    """Hash, weight and class of the words and beginnings that tell toxic documents from others."""
    given = Lexicon([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                words = _words(batch.column("text").to_pylist())
                target = given.find(words.hash)[0] == TARGET
                ahead, behind = (_near(target, words.doc, steps) for steps in (range(1, 5), range(-4, 0)))
                places = [(np.arange(len(words.hash)), words.hash)] + [(at, h) for h, at in (_starts(words, n) for n in STEMS)]
                at, h = (np.concatenate(x) for x in zip(*places, strict=True))
                order = np.lexsort((h, words.doc[at]))
                at, h = at[order], h[order]
                doc = words.doc[at]
                new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
                any_ = [np.maximum.reduceat(x[at].astype(np.int64), new) if len(new) else new for x in (ahead, behind)]
                label = np.array(batch.column("label").to_pylist(), np.int64)
                yield pa.record_batch([pa.array(h[new].view(np.int64)), pa.array(label[doc[new]]), *(pa.array(x) for x in any_)], names=["h", "label", "ahead", "behind"])

    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not pos or n == pos:
        return []
    sums = [F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"), *(F.sum(F.col(c) * F.col("label")).alias(c) for c in ("ahead", "behind"))]
    counts = rows.select("text", "label").mapInArrow(run, "h long, label long, ahead long, behind long").groupBy("h").agg(*sums).where("a >= 3")
    weight = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (n - pos + 1))
    both = F.col("a") + F.col("b")
    part = lambda x, share: F.when(x > 0, x * F.log(x / (both * share))).otherwise(0.0)
    telling = 2 * (part(F.col("a"), pos / n) + part(F.col("b"), (n - pos) / n))
    kind = F.when((F.col("ahead") >= 3) & (F.col("ahead") > F.col("behind")), THREAT).otherwise(INSULT)
    best = counts.select("h", weight.alias("w"), telling.alias("g"), kind.alias("kind")).where((F.col("g") >= TELLING) & (F.col("w") >= LEAST)).orderBy(F.desc("g"), "h").limit(LEXICON)
    return [(r.h, min(r.w, 6.0), r.kind) for r in best.collect()]


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", sample: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, column, sample)
    lexicon = Lexicon(learned_entries(rows.where("fold <> 4")))
    machine = grammar()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                hits = matched(batch.column("text").to_pylist(), lexicon, machine)
                edge = np.searchsorted(hits.doc, np.arange(batch.num_rows + 1))
                columns = [pa.array([x[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]) for x in (hits.clause, hits.weight, hits.mask)]
                yield pa.record_batch([*columns, pa.array(hits.n_words), batch.column("label")], names=["clause", "weight", "mask", "n_words", "label"])

    schema = "clause array<long>, weight array<double>, mask array<long>, n_words long, label int"
    got = rows.where("fold = 4").orderBy("doc_id", "text").select("text", "label").mapInArrow(run, schema).collect()  # a bounded sample's hits
    if not got:
        return Model(lexicon, np.array(list(FACTORS.values())), np.array([1.0, 0, 0, 0, -2.0]))
    flat = [np.array([x for r in got for x in r[c]], t) for c, t in (("weight", float), ("mask", np.int64))]
    doc = np.repeat(np.arange(len(got)), [len(r.clause) for r in got])
    clause = np.array([(i, x) for i, r in enumerate(got) for x in r.clause], np.int64).reshape(-1, 2)
    number = np.cumsum(np.r_[0, (clause[1:] != clause[:-1]).any(1)]) if len(clause) else clause[:, 0]
    hits = Hits(doc, number, *flat, np.array([r.n_words for r in got]))
    return Model(lexicon, *fitted(hits, np.array([float(r.label) for r in got])))


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score and the kept columns (others than these two) of all documents; no exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c for c in keep if c != "text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), *(rows.schema[c] for c in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                score = pa.array(shared.value.score(batch.column("text").to_pylist()))
                yield pa.record_batch([batch.column("doc_id"), score, *(batch.column(c) for c in keep)], names=["doc_id", "score", *keep])

    return rows.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
