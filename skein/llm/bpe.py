"""BPE by speculation: greedy longest matches are proposed, all adjacent pairs checked at once, failing words merged exactly."""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from skein.llm import _text as X

#: Where the ranks are read, on the driver, unless a call names another file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets the words it has encoded at so many; they are then encoded anew.
REMEMBER = 300_000


@dataclass
class Vocabulary:
    """ranks: bytes to id. left, right: the pair that a token was merged from, itself if none.
    pairs: sorted left << 32 | right of all pairs that make a token, made: these tokens."""

    ranks: dict[bytes, int]
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray
    made: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        top = max(ranks.values()) + 1
        left, right = np.arange(top), np.arange(top)
        pairs = {}
        for token, i in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
            if len(token) > 1:
                parts = merge(token, ranks, i)
                if len(parts) == 2:
                    left[i], right[i] = parts
        keys = np.array(sorted(pairs), np.int64)
        by_id = sorted(ranks.items(), key=lambda x: x[1])
        size = np.zeros(top, np.int64)
        size[[i for _, i in by_id]] = [len(t) for t, _ in by_id]
        return cls(ranks, left, right, keys, np.array([pairs[k] for k in keys.tolist()], np.int64), np.frombuffer(b"".join(t for t, _ in by_id), np.uint8), np.concatenate(([0], np.cumsum(size))))


def merge(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[int]:
    """Exact BPE: the adjacent pair of the lowest rank is merged, the leftmost first, until none (of a rank under below) is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def merge_all(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """merge() of many words at once: the ids of all words in sequence, and the number of each word's."""
    byte = np.array([v.ranks[bytes([i])] for i in range(256)], np.int64)
    ids = byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    done = []
    none = np.iinfo(np.int64).max
    while len(ids):
        key = ids[:-1] << 32 | ids[1:]
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        rank = np.concatenate((np.where((v.pairs[at] == key) & (word[1:] == word[:-1]), v.made[at], none), [none]))
        begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.concatenate((begin, [len(ids)]))))
        live = least < none
        done.append((word[~live], ids[~live]))
        ids, word, rank, least = ids[live], word[live], rank[live], least[live]
        hit = np.flatnonzero(rank == least)
        hit = hit[np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))] if len(hit) else hit
        ids[hit] = rank[hit]
        keep = np.ones(len(ids), bool)
        keep[hit + 1] = False
        ids, word = ids[keep], word[keep]
    word, ids = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(word, kind="stable")
    return ids[order], np.bincount(word, minlength=len(words))


def compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether BPE of the two tokens' bytes gives these two tokens again, for all pairs at once.

    The merges that built both are undone from the last one back, on either side of
    the boundary; a pair across it that would have merged earlier than the
    merge undone last is a conflict. BPE gives a sequence of tokens if and only if all adjacent pairs are compatible.
    """
    a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
    limit, good = np.full(len(a), np.iinfo(np.int64).max), np.ones(len(a), bool)
    live = np.arange(len(a))
    while len(live):
        x, y, lim = a[live], b[live], limit[live]
        key = x << 32 | y
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        bad = (v.pairs[at] == key) & (v.made[at] < lim)
        good[live[bad]] = False
        live, x, y = live[~bad], x[~bad], y[~bad]
        xs, ys = v.right[x], v.left[y]
        x_can, y_can = xs != x, ys != y
        use_x = x_can & (~y_can | (x > y))
        use_y = y_can & ~use_x
        a[live[use_x]], limit[live[use_x]] = xs[use_x], x[use_x]
        b[live[use_y]], limit[live[use_y]] = ys[use_y], y[use_y] + 1
        live = live[use_x | use_y]
    return good


class Encoder:
    """Encodes words and remembers them; words are bytes of one piece of PATTERN."""

    def __init__(self, v: Vocabulary):
        self.v, self.split = v, regex.compile(PATTERN).findall
        self.longest = max(map(len, v.ranks))
        self.proposed = self.merged = 0
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        ranks, flat, size = self.v.ranks, [], []
        raw = [w.encode() for w in words]
        for w in raw:
            got = ranks.get(w)
            if got is not None:
                flat.append(got)
                size.append(1)
                continue
            p, n, before = 0, len(w), len(flat)
            while p < n:
                q = min(n, p + self.longest)
                while w[p:q] not in ranks:
                    q -= 1
                flat.append(ranks[w[p:q]])
                p = q
            size.append(len(flat) - before)
        ids, size = np.array(flat, np.int32), np.array(size, np.int64)
        word = np.repeat(np.arange(len(words)), size)
        inner = np.flatnonzero(word[1:] == word[:-1])
        failing = np.unique(word[inner[~compatible(self.v, ids[inner], ids[inner + 1])]])
        self.proposed += len(words)
        self.merged += len(failing)
        if len(failing):
            exact, count = merge_all([raw[k] for k in failing.tolist()], self.v)
            again = np.zeros(len(words), bool)
            again[failing] = True
            ids, exact_of = ids[~again[word]], np.repeat(failing, count)
            size[failing] = count
            order = np.argsort(np.concatenate((word[~again[word]], exact_of)), kind="stable")
            ids = np.concatenate((ids, exact.astype(np.int32)))[order]
        start = len(self.known)
        self.known.update(zip(words, range(start, start + len(words))))
        self.ids = np.concatenate((self.ids, ids))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(size)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in sequence, and the bounds of each text's."""
        if len(self.known) > REMEMBER:
            self.forget()
        pieces = [self.split(t) if t else [] for t in texts]
        words = [w for p in pieces for w in p]
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        size = self.begin[at + 1] - self.begin[at]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.begin[at] - ends[:-1], size)]
        return ids, ends[np.concatenate(([0], np.cumsum([len(p) for p in pieces]))).astype(np.int64)]


def decode(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of each text."""
    size = v.offsets[ids + 1] - v.offsets[ids]
    ends = np.concatenate(([0], np.cumsum(size)))
    data = v.data[np.arange(ends[-1]) + np.repeat(v.offsets[ids] - ends[:-1], size)].tobytes()
    at = ends[bounds].tolist()
    return [data[s:e] for s, e in zip(at, at[1:])]


_encoders: dict[int, Encoder] = {}


def _encoder(held) -> Encoder:
    if held.key not in _encoders:
        _encoders.clear()
        _encoders[held.key] = Encoder(held.value)
    return _encoders[held.key]


class _Held:
    """A broadcast vocabulary and a key that tells it from others in a worker that is used again."""

    def __init__(self, spark: SparkSession, path: str):
        self.cast, self.key = spark.sparkContext.broadcast(Vocabulary.load(path)), path

    @property
    def value(self) -> Vocabulary:
        return self.cast.value


def _runs(texts: list[str | None]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= X.CHUNK_CHARS or i + 1 == len(texts):
            yield lo, i + 1
            lo, size = i + 1, 0


def _ids(enc: Encoder, texts: list[str | None], check: bool):
    """Arrow arrays of a run of texts: ids, their number, whether decoding them gives the text."""
    ids, bounds = enc.encode(texts)
    offsets = pa.array([None if t is None else b for t, b in zip(texts, bounds.tolist())] + [int(bounds[-1])], pa.int32())
    out = [pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array([None if t is None else n for t, n in zip(texts, np.diff(bounds).tolist())], pa.int32())]
    if check:
        out.append(pa.array([None if t is None else t.encode() == d for t, d in zip(texts, decode(enc.v, ids, bounds))], pa.bool_()))
    return out


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip: the tokens of each row's text, and whether decoding them gives it back.

    The vocabulary is loaded from path, on the driver, and broadcast; its size doesn't depend on the
    data. An empty text has no tokens; a null text has null ids, number and round_trip. Every
    row is encoded on its own, also rows that repeat a doc_id or have none; an empty table has no row.
    """
    held = _Held(docs.sparkSession, path)

    def run(batches):
        enc = _encoder(held)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _runs(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], *_ids(enc, texts[lo:hi], True)], names=["doc_id", "ids", "n_tokens", "round_trip"])

    return X.need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, round_trip boolean")


def decode_ids(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids have a null text, bytes that aren't UTF-8 become U+FFFD."""
    held = _Held(encoded.sparkSession, path)

    def run(batches):
        v = held.value
        for batch in batches:
            ids = batch.column("ids")
            size = np.array([len(x) if x is not None else 0 for x in ids.to_pylist()], np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode(v, flat, np.concatenate(([0], np.cumsum(size))).astype(np.int64))
            null = ids.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if n else t.decode("utf-8", "replace") for t, n in zip(texts, null)], pa.string())], names=["doc_id", "text"])

    return X.need(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str = VOCABULARY) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens of every row of docs, with the vocabulary at path.

    A null text has null ids and n_tokens, an empty one none and 0; other columns may be null and go, rows that repeat stay, an empty table stays empty.
    """
    held = _Held(spark, path)

    def run(batches):
        enc = _encoder(held)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _runs(texts):
                own = [batch.column(c)[lo:hi] for c in ("doc_id", "lang", "source")]
                yield pa.RecordBatch.from_arrays([*own, *_ids(enc, texts[lo:hi], False)], names=["doc_id", "lang", "source", "ids", "n_tokens"])

    return X.need(docs, "doc_id", "lang", "source", "text").mapInArrow(run, "doc_id long, lang string, source string, ids array<int>, n_tokens int")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
