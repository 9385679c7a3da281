"""Operator 6: SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a batch that a worker has not met yet lie in flat numpy arrays:
one symbol a character, and the rank of each adjacent pair. A round takes the least rank
of each word (a segmented minimum), merges its occurrences in all words at once, leftmost
first, and compacts the arrays; words without a known pair leave. Where a merge could
create a pair that comes before the occurrences still to be merged, only the leftmost one
of that word is merged in the round, which is the library's order exactly.

Words may be encoded apart because no piece has a word mark after another character;
a model of which that isn't true, or with a normalization of its own, is refused.

Defined results: a null or empty text has the begin and end ids only and decodes to an
empty text; unknown characters become byte pieces; further columns are ignored; rows are
neither joined nor reordered, so repeated rows and empty tables need no care.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import chunks

MARK = "▁"
CACHED_WORDS = 400_000
NONE = np.int32(2**31 - 1)
_RUN = re.compile(f"{MARK}+[^{MARK}]*")


class PairTable:
    """Rank and result of merging two symbols: an open-addressing hash table in numpy arrays."""

    def __init__(self, keys: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 6))))
        size = 1 << self.bits
        self.keys, self.rank, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        self.probes, at, left = 0, self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            spot = at[left]
            free = self.keys[spot] < 0
            _, first = np.unique(spot, return_index=True)
            won = first[free[first]]
            put = left[won]
            self.keys[at[put]], self.rank[at[put]], self.merged[at[put]] = keys[put], rank[put], merged[put]
            left = np.delete(left, won)
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; -1 where they have none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, at, -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] >= 0) & (keys >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[open_]]
            found = hit == keys[open_]
            out[open_[found]] = at[open_[found]]
            open_ = open_[~found & (hit >= 0)]
        return out


class PieceModel:
    """Vocabulary, pair table and word cache of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        own = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trained = proto.normalizer_spec, proto.trainer_spec
        if trained.model_type != trained.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces) or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("only BPE models with a dummy prefix, identity normalization and no own symbols")
        n = own.get_piece_size()
        self.n, self.begin, self.end = n, own.bos_id(), own.eos_id()
        text = {own.id_to_piece(i): i for i in range(n) if not (own.is_byte(i) or own.is_control(i) or own.is_unknown(i))}
        if any(MARK in p.lstrip(MARK) for p in text):
            raise ValueError("a piece has a word mark after another character")
        own_bytes = [i for i in range(n) if own.is_byte(i)]
        if len(own_bytes) != 256:
            raise ValueError("only models with byte fallback")
        self.byte_id = np.array(sorted(own_bytes, key=lambda i: int(own.id_to_piece(i)[3:-1], 16)), np.int32)
        symbol = dict(text)
        for c in sorted({c for p in text for c in p} - symbol.keys()):
            symbol[c] = n + len(symbol) - len(text)
        ranks = {s: r for r, s in enumerate(sorted({own.get_score(i) for i in text.values()}, reverse=True))}
        pairs = [(symbol[p[:k]], symbol[p[k:]], ranks[own.get_score(i)], i) for p, i in text.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, rank, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.pairs = PairTable(left << 32 | right, rank.astype(np.int32), merged.astype(np.int32))
        single = [(ord(c), i) for c, i in symbol.items() if len(c) == 1]
        self.of_char = np.full(0x110000, -1, np.int32)
        self.of_char[[c for c, _ in single]] = [i for _, i in single]
        self.char_of = np.full(max(symbol.values(), default=n) + 1, -1, np.int32)
        for c, i in single:
            self.char_of[i] = c
        raw = [b"" if own.is_control(i) else " ⁇ ".encode() if own.is_unknown(i) else b"" if own.is_byte(i) else own.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_id):
            raw[i] = bytes([b])
        self.size = np.array([len(x) for x in raw], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.marked = np.array([own.id_to_piece(i).startswith(MARK) for i in range(n)])
        self.cache: dict[str, bytes] = {}

    def merge(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words, in order, after all merges. word: ascending numbers from 0."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        table = self.pairs

        def slots(at: np.ndarray) -> np.ndarray:
            """Pair-table slots of the pairs that begin at these places."""
            nxt = np.minimum(at + 1, len(symbol) - 1)
            out = table.find(symbol[at], symbol[nxt])
            out[(nxt == at) | (word[nxt] != word[at])] = -1
            return out

        def rank_of(slot: np.ndarray) -> np.ndarray:
            return np.where(slot < 0, NONE, table.rank[slot])

        slot = slots(np.arange(len(symbol)))
        rank = rank_of(slot)
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbol)])
            over = least == NONE
            if over.any():
                gone = np.repeat(over, lengths)
                done.append((symbol[gone], word[gone]))
                stay = ~gone
                symbol, word, slot, rank = symbol[stay], word[stay], slot[stay], rank[stay]
                least, lengths = least[~over], lengths[~over]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            if len(at) > len(least):  # some word has more than one occurrence
                fresh = np.r_[True, (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]])]
                begin = np.flatnonzero(fresh)
                at = at[(np.arange(len(at)) - begin[np.cumsum(fresh) - 1]) % 2 == 0]
                merged = table.merged[slot[at]]
                after = np.minimum(at + 2, len(symbol) - 1)
                right = np.where((at + 2 < len(symbol)) & (word[after] == word[at]), symbol[after], -1)
                before = np.maximum(at - 1, 0)
                left = np.where((at > 0) & (word[before] == word[at]), symbol[before], -1)
                touching = np.r_[False, (np.diff(at) == 2) & (word[at[1:]] == word[at[:-1]])]
                left[touching] = merged[np.flatnonzero(touching) - 1]
                new = np.minimum(rank_of(table.find(left, merged)), rank_of(table.find(merged, right)))
                first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                number = np.cumsum(first) - 1
                unsafe = np.zeros(int(first.sum()), bool)
                unsafe[number[new <= rank[at]]] = True
                at = at[first | ~unsafe[number]]
            symbol[at] = table.merged[slot[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            symbol, word, slot, rank = symbol[keep], word[keep], slot[keep], rank[keep]
            changed = np.zeros(len(symbol), bool)
            changed[moved] = changed[np.maximum(moved - 1, 0)] = True
            stale = np.flatnonzero(changed)
            slot[stale] = slots(stale)
            rank[stale] = rank_of(slot[stale])
        symbols = np.concatenate([s for s, _ in done]) if done else symbol
        words = np.concatenate([w for _, w in done]) if done else word
        order = np.argsort(words, kind="stable")
        return symbols[order], words[order]

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word, which stands behind a word mark, as little-endian 16- or 32-bit integers."""
        flat = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), "<u4").astype(np.int32)
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        symbol = self.of_char[flat]
        symbol = np.where(symbol < 0, -1 - flat, symbol)
        symbol, word = self.merge(symbol, word)
        char = np.where(symbol < 0, -1 - symbol, np.where(symbol >= self.n, self.char_of[np.maximum(symbol, 0)], -1))
        if (char >= 0).any():
            wide = 1 + (char > 0x7F).astype(np.int64) + (char > 0x7FF) + (char > 0xFFFF)
            start = np.cumsum(wide) - wide
            out = np.repeat(symbol, wide)
            lost = np.flatnonzero(char >= 0)
            raw = np.frombuffer(char[lost].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            spots = np.repeat(start[lost] - (np.cumsum(wide[lost]) - wide[lost]), wide[lost]) + np.arange(len(raw))
            out[spots] = self.byte_id[raw]
            symbol, word = out, np.repeat(word, wide)
        raw = symbol.astype(self.dtype).tobytes()
        step = np.dtype(self.dtype).itemsize
        ends = (np.cumsum(np.bincount(word, minlength=len(words))) * step).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @property
    def dtype(self) -> str:
        return "<u2" if self.n <= 1 << 16 else "<u4"

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with begin and end ids."""
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        split = []
        for t in texts:
            if not t:
                split.append([])
            elif "  " in t or MARK in t or t[0] == " " or t[-1] == " ":
                split.append([x[1:] for x in _RUN.findall(MARK + t.replace(" ", MARK))])
            else:
                split.append(t.split(" "))
        fresh = list({w for words in split for w in words}.difference(self.cache))
        for part in _by_size(fresh, 1 << 19):
            self.cache.update(zip(part, self.ids(part), strict=True))
        known = self.cache.__getitem__
        begin, end = (np.array([x], self.dtype).tobytes() for x in (self.begin, self.end))
        return [np.frombuffer(b"".join([begin, *map(known, words), end]), self.dtype) for words in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """UTF-8 of each list of ids."""
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        size = self.size[flat]
        ends = np.cumsum(size)
        out = self.raw[np.repeat(self.offset[flat] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        tail = np.r_[0, ends][np.cumsum([0, *map(len, ids)])].tolist()
        texts = []
        for x, a, b in zip(ids, tail[:-1], tail[1:], strict=True):
            first = next((i for i in x[:2].tolist() if i != self.begin), None)
            texts.append(out[a + (first is not None and bool(self.marked[first])) : b])
        return texts


def _by_size(words: list[str], limit: int) -> Iterator[list[str]]:
    """Lists of words of about so many characters."""
    part, n = [], 0
    for w in words:
        part.append(w)
        n += len(w) + 1
        if n >= limit:
            yield part
            part, n = [], 0
    if part:
        yield part


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """This worker's copy of a model."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit), decoded (the text of those ids); no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_path)
        own.cache.clear()  # a worker outlives its tasks
        for whole in batches:
            for batch in chunks(whole, "text", 2 << 20):
                ids = own.encode(["" if t is None else t for t in batch.column("text").to_pylist()])
                columns = [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())]
                yield pa.record_batch([*columns, pa.array([x.decode("utf-8", "replace") for x in own.decode(ids)], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])
        own.cache.clear()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` encoded and decoded."""
    import public_tokenizers

    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")))
