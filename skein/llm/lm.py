"""Language-model scoring: hierarchical Pitman-Yor model over words, seating sampled by Gibbs, perplexity from averaged predictions."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import _text as X

#: Discount and strength of the restaurants: of no character, of one, of a word's ending, of a whole word, of two words.
DISCOUNT = (0.5, 0.6, 0.7, 0.8, 0.8)
STRENGTH = (1.0, 1.0, 1.0, 1.0, 1.0)
BURN_IN, SAMPLES = 4, 6
#: The tables of so many customers of a dish, the first, are drawn exactly.
EXACT = 32
#: Characters of a block of documents, tokens of a bucket or piece of restaurants, classes of endings and their length.
BLOCK, BUCKET, CLASSES, ENDING = 1 << 23, 1 << 20, 1 << 16, 3
#: Bytes of a bucket's pieces that a worker holds in memory, others are in a file. Shares of the words when they are counted.
HELD, SHARES = 1 << 27, 1 << 8
BITS, EDGE, END = 21, 0, 1
LONGEST = 32
SEED = 7
_NONE = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "share int, key long, n long, words binary"
PARTS = "bucket long, piece int, block long, parts binary, ids array<long>, chars array<long>, n_parts int"
SUMS = "block long, doc binary, total binary, ids array<long>, chars array<long>, n_parts int"

_stirling: dict[float, np.ndarray] = {}


def stirling(d: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: seatings of so many customers at so many tables."""
    if d not in _stirling:
        s = np.full((n + 1, n + 1), -np.inf)
        s[1, 1] = 0
        t = np.arange(1, n + 1)
        for k in range(1, n):
            with np.errstate(divide="ignore"):
                s[k + 1, 1:] = np.logaddexp(s[k, :-1], np.log(np.maximum(k - d * t, 0)) + s[k, 1:])
        _stirling[d] = s
    return _stirling[d]


def uniform(key: np.ndarray, sweep: int, turn: int) -> np.ndarray:
    """A number between 0 and 1 for each key, sweep and turn, whatever else is drawn."""
    return ((X.mix(key.astype(np.uint64) * _NONE + np.uint64((sweep << 32) + (turn << 8) + SEED)) >> np.uint64(11)) + 0.5) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Binomial numbers, of two uniform ones each: by adding up probabilities, or, beyond a variance of 16, a normal number corrected for skewness."""
    q = np.minimum(p, 1 - p)
    out, variance = np.zeros(len(n)), n * q * (1 - q)
    far = variance > 16
    z = np.sqrt(-2 * np.log(u[far])) * np.cos(2 * np.pi * v[far])
    out[far] = np.clip(np.floor(n[far] * q[far] + np.sqrt(variance[far]) * z + (1 - 2 * q[far]) * (z * z - 1) / 6 + 0.5), 0, n[far])
    live = np.flatnonzero(~far)
    share, odds = np.exp(n[live] * np.log1p(-q[live])), q[live] / (1 - q[live])
    rest, k = u[live] - share, 0
    while len(live):
        more = (rest > 0) & (n[live] > k)
        live, share, odds, rest, k = live[more], share[more], odds[more], rest[more], k + 1
        out[live] = k
        share = share * odds * (n[live] - k + 1) / k
        rest = rest - share
    return np.where(p > 0.5, n - out, out)


class Level:
    """Restaurants of one context length: dishes that are eaten (code: context and symbol, in order), customers and tables of each.

    With a key for each dish, its draws are those of the key and the sweep, else the next ones of a generator.
    """

    def __init__(self, length: int, code: np.ndarray, radix: int = 1 << BITS, key: np.ndarray | None = None):
        self.length, self.code, self.key = length, code, key
        context = code // radix
        new = np.append(True, context[1:] != context[:-1])[: len(code)]
        self.context, self.at = context[new], np.cumsum(new) - 1
        self.tables = np.ones(len(code))

    def seat(self, customers: np.ndarray, base: np.ndarray, rng: np.random.Generator | int) -> None:
        """Draws the number of tables of each dish, given those of the restaurant's other dishes.

        Those of the first EXACT customers from their exact distribution; further customers come in groups of
        an eighth of those seated: each opens a table with the probability of the Chinese restaurant process.
        rng is the number of the sweep if the dishes have keys.
        """
        d, s = DISCOUNT[self.length], STRENGTH[self.length]
        more = np.flatnonzero(customers > 1)
        opened = np.bincount(self.at, self.tables, len(self.context))
        others = opened[self.at[more]] - self.tables[more]
        count, b = customers[more], base[more]
        draw = (lambda i, turn: rng.random(len(i))) if self.key is None else (lambda i, turn: uniform(self.key[more[i]], rng, turn))
        u = draw(np.arange(len(more)), 0)
        drawn = np.ones(len(more))
        order = np.argsort(count)
        ends = np.append(np.searchsorted(count[order], np.arange(2, EXACT + 1)), len(count))
        for n, lo, hi in zip(range(2, EXACT + 1), ends, ends[1:]):
            i, step = np.arange(n), (1 << 15) // n
            ratio = np.exp(np.diff(stirling(d)[n, 1 : n + 1], prepend=stirling(d)[n, 1]))
            for at in range(lo, hi, step):
                own = order[at : min(hi, at + step)]
                w = (s + d * (others[own, None] + i)) * b[own, None]  # of a further table, times the ratio of the numbers of seatings
                w[:, 0] = 1
                w = np.cumsum(np.cumprod(w * ratio, axis=1), axis=1)
                drawn[own] = 1 + (w[:, :-1] < u[own, None] * w[:, -1:]).sum(1)
        live, turn = order[np.searchsorted(count[order], EXACT, "right") :], 0
        seated = np.full(len(more), float(EXACT))
        while len(live):
            t, n, turn = drawn[live], seated[live], turn + 2
            group = np.minimum(n // 8, count[live] - n)
            new = (s + d * (others[live] + t)) * b[live]
            drawn[live] = t + binomial(group, new / (new + n - d * t), draw(live, turn - 1), draw(live, turn))
            seated[live] = n + group
            live = live[seated[live] < count[live]]
        self.tables = np.ones(len(customers))
        self.tables[more] = drawn

    def own(self, customers: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Predictive probabilities of the dishes that are eaten."""
        d, s = DISCOUNT[self.length], STRENGTH[self.length]
        total = np.bincount(self.at, customers, len(self.context)) + s
        share = (s + d * np.bincount(self.at, self.tables, len(self.context))) / total
        return share[self.at] * base + (customers - d * self.tables) / total[self.at]

    def left(self, customers: np.ndarray, base: np.ndarray, base_left: np.ndarray) -> np.ndarray:
        """own() without one customer of the dish, who closes a table if every table of the dish has but one.

        Then the table's own customer leaves the parents' restaurant, whose prediction without it is base_left.
        """
        d, s = DISCOUNT[self.length], STRENGTH[self.length]
        closed = customers <= self.tables
        tables = self.tables - closed
        total = np.bincount(self.at, customers, len(self.context))[self.at] - 1 + s
        opened = np.bincount(self.at, self.tables, len(self.context))[self.at] - closed
        return ((s + d * opened) * np.where(closed, base_left, base) + (customers - 1 - d * tables)) / total


class Piece:
    """Whole restaurants of the longest contexts, in few bytes: dishes of each (fan), customers and key of each dish, and its parent, dish[up] of the next level."""

    def __init__(self, length: int, fan: np.ndarray, customers: np.ndarray, up: np.ndarray, dish: np.ndarray, key: np.ndarray | None = None):
        self.length, self.key, self.dish, self.mean = length, key, dish, np.zeros(len(customers))
        self.fan, self.customers, self.up = (a.astype(np.min_scalar_type(int(a.max(initial=0)))) for a in (fan, customers, up))
        self.tables = np.ones_like(self.customers)

    def level(self) -> Level:
        level = Level(self.length, np.repeat(np.arange(len(self.fan)), self.fan), 1, self.key)
        level.tables = self.tables.astype(np.float64)
        return level


def sample(pieces, levels: list[Level], parent: list[np.ndarray], base: np.ndarray, rng: np.random.Generator | None, burn_in: int = BURN_IN, samples: int = SAMPLES, leave: bool = False) -> None:
    """gibbs() with the longest contexts in pieces, one in memory at a time, and the sums of the predictions in mean of each; levels: the shorter ones.

    What a piece has to know of the others is in the next level: its predictions go down to all pieces, the tables of all go up to it.
    """
    n = len(levels)
    count, prior = [None] * n, [base] * n
    for k in range(n - 2, -1, -1):
        prior[k] = prior[k + 1][parent[k]]
    above, without = prior[0], None
    for sweep in range(burn_in + samples + 1):
        count[0] = np.zeros(len(levels[0].code))
        for k in range(len(pieces)):
            piece = pieces[k]
            level, customers, own = piece.level(), piece.customers.astype(np.float64), above[piece.dish][piece.up]
            if sweep > burn_in:
                piece.mean += level.left(customers, own, without[piece.dish][piece.up]) if leave else level.own(customers, own)
            if sweep < burn_in + samples:
                level.seat(customers, own, rng if level.key is None else sweep)
                piece.tables = level.tables.astype(piece.tables.dtype)
                count[0][piece.dish] += np.bincount(piece.up, level.tables, len(piece.dish))
            pieces[k] = piece
        if sweep == burn_in + samples:
            return
        for k in range(n):
            levels[k].seat(count[k], prior[k], rng if levels[k].key is None else sweep)
            if k + 1 < n:
                count[k + 1] = np.bincount(parent[k], levels[k].tables, len(prior[k + 1]))
        without = base
        for k in range(n - 1, -1, -1):
            if leave and sweep >= burn_in:
                without = levels[k].left(count[k], prior[k], without)
                without = without[parent[k - 1]] if k else without
            above = levels[k].own(count[k], prior[k])
            if k:
                prior[k - 1] = above[parent[k - 1]]


def gibbs(levels: list[Level], parent: list[np.ndarray], customers: np.ndarray, base: np.ndarray, rng: np.random.Generator, burn_in: int = BURN_IN, samples: int = SAMPLES, leave: bool = False) -> np.ndarray:
    """Predictive probabilities of the dishes of the longest contexts, averaged over samples of the seating.

    With leave, of each without one of its own customers: how well the rest of the corpus predicts an occurrence.
    levels: from the longest contexts to the shortest, whose base is given; parent: the place of each dish among those
    of the next level. The tables of a level are the customers of the next, whose predictions are its base. A sweep
    reseats all levels, from the longest contexts to the shortest.
    """
    fan = np.bincount(levels[0].at, minlength=len(levels[0].context))
    pieces = [Piece(levels[0].length, fan, customers.astype(np.int64), parent[0], np.arange(len(levels[1].code)), levels[0].key)]
    sample(pieces, levels[1:], parent[1:], base, rng, burn_in, samples, leave)
    return pieces[0].mean / samples


# --- tokens -----------------------------------------------------------------


def _order(a: np.ndarray, top: int) -> np.ndarray:
    """Where the numbers of a, all of at most top, are in order: sorted with their places, which is far quicker than argsort, if both fit into 64 bits."""
    bits = max(1, len(a) - 1).bit_length()
    if top.bit_length() + bits > 63:
        return np.argsort(a)
    return np.sort((a.astype(np.int64) << bits) | np.arange(len(a))) & ((1 << bits) - 1)


def _distinct(a: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What differs, in order, where any of each is, and the place of each among them."""
    order = _order(a, top)
    new = np.append(True, a[order[1:]] != a[order[:-1]])[: len(a)]
    at = np.empty(len(a), np.int64)
    at[order] = np.cumsum(new) - 1
    return a[order[new]], order[new], at


def _distinct_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_distinct() of 64-bit hashes, in the order of their first 40 bits."""
    order = _order(h >> np.uint64(24), (1 << 40) - 1)
    if (h[order[1:]] != h[order[:-1]]).sum() != (h[order[1:]] >> np.uint64(24) != h[order[:-1]] >> np.uint64(24)).sum():
        order = np.argsort(h)  # two hashes share their first 40 bits
    new = np.append(True, h[order[1:]] != h[order[:-1]])[: len(h)]
    at = np.empty(len(h), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return h[order[new]], order[new], at


def _hashes(cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    h, live = np.zeros(len(start), np.uint64), np.arange(len(start))
    for k in range(int(size.max(initial=0))):
        live = live[size[live] > k]
        h[live] = h[live] * _NONE + cp[start[live] + k] + np.uint64(1)
    return X.mix(h)


class Tokens:
    """Tokens of a block: a run of letters and digits with the space before it, or any other character; all characters are in one.
    A run of more than LONGEST characters is cut after each LONGEST.


    word: each token's place among the distinct words; context: that of the word before, the last for none; older: that of the word before it;
    hash, start, size: of the distinct words; doc: each token's document.
    """

    def __init__(self, cp: np.ndarray, bounds: np.ndarray):
        n = len(cp)
        alone = np.zeros(n + 1, bool)
        alone[bounds] = True
        run = X.flags(cp)
        lead = np.zeros(n, bool)
        lead[:-1] = (cp[:-1] == 32) & run[1:] & ~alone[1:n]
        begin = ~run
        begin[1:] |= ~run[:-1] & ~lead[:-1]
        begin |= alone[:n]
        start = np.flatnonzero(begin)
        more = (np.diff(np.append(start, n)) - 1) // LONGEST
        if more.any():
            before = np.cumsum(more + 1) - more - 1
            start = np.repeat(start - before * LONGEST, more + 1) + np.arange(more.sum() + len(more)) * LONGEST
        ends = np.append(start[1:], n)
        size = ends - start
        self.hash, first, self.word = _distinct_hashes(_hashes(cp, start, size))
        self.start, self.size = start[first], size[first]
        self.doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(np.searchsorted(start, bounds)))
        self.context = np.concatenate((self.word[:1], self.word[:-1]))
        head = alone[start]
        self.context[head] = len(self.hash)
        self.older = np.where(head, np.int32(len(self.hash)), np.concatenate((self.context[:1], self.context[:-1])))
        tail = np.zeros(len(first), np.uint64)
        for k in range(ENDING):
            at = self.start + self.size - 1 - k
            tail = np.where(k < self.size, X.mix(tail + cp[np.maximum(at, 0)].astype(np.uint64) + np.uint64(1)), tail)
        self.ending = np.append(tail >> np.uint64(48), np.uint64(0)).astype(np.int64)

    def pairs(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _pairs(cp, self.start, self.size)


def _pairs(cp: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of adjacent characters of all words one after another, edges among them, and where each word begins."""
    more = size + 1
    at = np.concatenate(([0], np.cumsum(more)))
    place = np.arange(at[-1]) - np.repeat(at[:-1], more)
    flat = np.repeat(start, more) + place
    last = place == np.repeat(size, more)
    right = np.where(last, END, cp[np.minimum(flat, len(cp) - 1)].astype(np.int64) + 2)
    left = np.where(place == 0, EDGE, cp[np.maximum(flat - 1, 0)].astype(np.int64) + 2)
    return left << BITS | right, at[:-1]


def _blocks(batches, block):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for lo, hi, cp, bounds in X.chunks(texts, block):
            yield batch, lo, hi, cp, bounds


def _statistics(batches, block):
    """Rows of COUNTS: how many tokens follow each class of endings, and the distinct words of each block, by hash."""
    for _, _, _, cp, bounds in _blocks(batches, block):
        if len(cp):
            yield _counted(cp, bounds)


def _counted(cp: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    w = Tokens(cp, bounds)
    times = np.bincount(w.context, minlength=len(w.hash) + 1)
    ending = np.bincount(w.ending, times, CLASSES).astype(np.int64)
    used = np.flatnonzero(ending)
    cut = np.searchsorted(w.hash, np.arange(SHARES, dtype=np.uint64) << np.uint64(56))  # the words' hashes are in order
    words = []
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(w.hash)]):
        size = w.size[lo:hi]
        flat = np.repeat(w.start[lo:hi] - np.cumsum(size) + size, size) + np.arange(size.sum())
        words.append(_pack(size, cp[flat]) if hi > lo else None)
    full = [k for k, x in enumerate(words) if x]
    none = len(full)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((used % SHARES, full)).astype(np.int32)), pa.array([*used.tolist(), *[None] * none], pa.int64()),
        pa.array([*ending[used].tolist(), *[None] * none], pa.int64()), pa.array([*[None] * len(used), *(words[k] for k in full)], pa.binary())],
        names=["share", "key", "n", "words"])


def _summed(rows: pa.Table) -> pa.Table:
    """(kind, key, n): tokens after each class of endings, and pairs of characters of the words, each of which counts once in the corpus."""
    counted = rows.filter(rows.column("key").is_valid()).select(["key", "n"]).group_by("key").aggregate([("n", "sum")])
    key, n = counted.column("key").to_numpy(), counted.column("n_sum").to_numpy()
    parts = [_unpack(x) for x in rows.column("words").drop_null().to_pylist()]
    pair, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if parts:
        size, cp = _joined(parts, 0), np.concatenate([p[1] for p in parts]).astype(np.uint32)
        start = np.cumsum(size) - size
        first = _distinct_hashes(_hashes(cp, start, size))[1]
        pair, times = np.unique(_pairs(cp, start[first], size[first])[0], return_counts=True)
    return pa.table({"kind": pa.array(np.repeat([0, 1], [len(key), len(pair)]), pa.int32()), "key": np.concatenate((key, pair)).astype(np.int64), "n": np.concatenate((n, times)).astype(np.int64)})


class Plan:
    """What all tasks must agree on: the model of spelling, and to which bucket a context's restaurant belongs.

    A bucket holds whole classes of endings, up to so many tokens; a larger class is a bucket of its own, in pieces of
    about so many tokens, each with whole restaurants of two words.
    """

    def __init__(self, kind: np.ndarray, key: np.ndarray, n: np.ndarray, bucket: int = BUCKET):
        after = np.zeros(CLASSES, np.int64)
        after[key[kind == 0]] = n[kind == 0]
        self.slices = np.maximum(1, -(-after // bucket))
        small = np.where(self.slices == 1, after, 0)
        self.first = np.cumsum(small) // bucket
        large = np.flatnonzero(self.slices > 1)
        self.first[large] = self.first[-1] + 1 + np.cumsum(self.slices[large]) - self.slices[large]
        self.pair, self.log = self.spelling(key[kind == 1], n[kind == 1], np.random.default_rng(SEED))

    @staticmethod
    def spelling(pair: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(pair)
        pair, n = pair[order], n[order].astype(np.float64)
        alone, to_alone = np.unique(pair % (1 << BITS), return_inverse=True)
        p = gibbs([Level(1, pair), Level(0, alone)], [to_alone], n, np.full(len(alone), 1 / max(1, len(alone))), rng)
        return pair, np.log(p)

    def spelled(self, w: Tokens, cp: np.ndarray) -> np.ndarray:
        pair, begin = w.pairs(cp)
        return np.add.reduceat(self.log[np.searchsorted(self.pair, pair)], begin) if len(begin) else np.zeros(0)


def _pack(*arrays: np.ndarray) -> bytes:
    """Integers in as few bytes as they need, first byte by first byte; of hashes 40 bits, which tell apart what is in one bucket."""
    out = []
    for a in arrays:
        kind = a.dtype.str
        if a.dtype == np.uint64:
            kind, planes = "u5", a.view(np.uint8).reshape(-1, 8)[:, :5]
        else:
            if a.dtype.kind in "iu":
                a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
                kind = a.dtype.str
            planes = a.view(np.uint8).reshape(len(a), a.itemsize)
        out += [kind.ljust(4).encode(), len(a).to_bytes(8, "little"), planes.T.tobytes()]
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    out, at = [], 0
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True) if packed else b""
    while at < len(raw):
        kind, n = raw[at : at + 4].decode().strip(), int.from_bytes(raw[at + 4 : at + 12], "little")
        size = 5 if kind == "u5" else np.dtype(kind).itemsize
        whole = np.zeros((n, 8 if kind == "u5" else size), np.uint8)
        whole[:, :size] = np.frombuffer(raw, np.uint8, n * size, at + 12).reshape(size, n).T
        out.append(whole.view(np.uint64 if kind == "u5" else kind).ravel())
        at += 12 + n * size
    return out


def _deal(batches, held, chars_of_block):
    """A row for each block, bucket and piece: contexts, words and n-grams of the block, and in which of its documents each n-gram is."""
    for nth, (batch, lo, hi, cp, bounds) in enumerate(_blocks(batches, chars_of_block)):
        ids, chars = batch.column("doc_id")[lo:hi].cast(pa.int64()).to_pylist(), np.diff(bounds).tolist()
        block, rows = _dealt(held.value, (TaskContext.get().partitionId() << 20) + nth, cp, bounds)
        none = [None] * (len(rows) - 1)
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary()),
            pa.array([ids, *none], pa.list_(pa.int64())), pa.array([chars, *none], pa.list_(pa.int64())), pa.array([len(rows)] * len(rows), pa.int32())],
            names=["bucket", "piece", "block", "parts", "ids", "chars", "n_parts"])


def _dealt(plan: Plan, nth: int, cp: np.ndarray, bounds: np.ndarray) -> tuple[int, list[tuple[int, int, bytes]]]:
    """A name of the block, which tells other contents, and its buckets and their pieces with what they get."""
    w = Tokens(cp, bounds)
    block = int(X.mix(np.array([nth], np.uint64) + w.hash.sum(dtype=np.uint64) + np.uint64(len(w.word)))[0].view(np.int64))
    return block, list(_parts(plan, w, plan.spelled(w, cp).astype(np.float16))) if len(w.word) else [(0, 0, b"")]


def _parts(plan: Plan, w: Tokens, spelled: np.ndarray):
    place, size = np.append(w.hash, _NONE), len(w.hash)
    pairs, _, pair = _distinct(w.context.astype(np.int64) * (size + 1) + w.older, (size + 1) ** 2)
    of, older = np.divmod(pairs, size + 1)
    mixed = X.mix(place)[older]
    bucket, tag = plan.first[w.ending[of]], (mixed >> np.uint64(32)).astype(np.uint32)
    piece = ((mixed & np.uint64(0xFFFFFFFF)).astype(np.int64) * plan.slices[w.ending[of]]) >> 32
    order = np.argsort(bucket + piece, kind="stable")  # pairs by bucket and piece, then by context
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pair = rank[pair]
    gram = pair * size + w.word
    del pair, rank, mixed
    turn = _order(gram, len(pairs) * size)
    gram, doc = gram[turn], w.doc[turn]
    begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    ends = np.append(begin, len(gram))
    pair, dish = gram[begin] // size, gram[begin] % size
    new = np.append(True, pair[1:] != pair[:-1])
    pair = order[pair]
    of, tag, bucket, piece = of[pair], tag[pair], bucket[pair], piece[pair]
    to = bucket + piece
    del gram, turn, pair
    cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(to)]):
        long = np.flatnonzero(new[s:e])
        step = np.flatnonzero(np.append(True, np.diff(of[s:e][long]) != 0))
        u = of[s:e][long][step]
        used, local = np.unique(dish[s:e], return_inverse=True)
        fans = np.diff(np.append(step, len(long))), np.diff(np.append(long, e - s))
        yield (int(bucket[s]), int(piece[s]), _pack(place[u], w.ending[u], fans[0], tag[s:e][long], fans[1], w.hash[used], spelled[used], local, np.diff(ends[s : e + 1]), doc[ends[s] : ends[e]]))


def predict(two: np.ndarray, one: np.ndarray, ending: np.ndarray, word: np.ndarray, spelled: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Log probability of each distinct n-gram, places of its context of two words and of its word, in order, that occurs n times.

    one: the context of one word of each of two; ending: the parent of each of one; spelled: log base of each word.
    """
    width = len(spelled)
    code1, _, up1 = _distinct(one[two] * width + word, len(ending) * width)
    code0, _, up0 = _distinct(ending[code1 // width] * width + code1 % width, (int(ending.max()) + 1) * width)
    levels = [Level(4, two * width + word, width), Level(3, code1, width), Level(2, code0, width)]
    return np.log(gibbs(levels, [up1, up0], n, np.exp(spelled[code0 % width]), rng, leave=True))


def _joined(parts: list, k: int) -> np.ndarray:
    return np.concatenate([p[k] for p in parts]).astype(np.int64)


class Shelf:
    """A list of objects that stay as large as they are: in memory up to so many bytes, others in a temporary file, each written again in its place."""

    def __init__(self, held: int):
        self.left, self.kept, self.where, self.file, self.end = held, [], [], None, 0

    def append(self, x, size: int) -> None:
        self.left -= size
        self.kept.append(x if self.left >= 0 else None)
        self.where.append(None)
        if self.left < 0:
            if self.file is None:
                folders = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
                self.file = tempfile.TemporaryFile(dir=next((d for d in folders if os.path.isdir(d)), None))
            raw = pickle.dumps(x, 5)
            self.where[-1] = (self.end, len(raw))
            self._write(raw, self.end)
            self.end += len(raw)

    def _write(self, raw: bytes, at: int) -> None:
        self.file.seek(at)
        self.file.write(raw)

    def __len__(self) -> int:
        return len(self.kept)

    def __getitem__(self, k: int):
        if self.where[k] is None:
            return self.kept[k]
        self.file.seek(self.where[k][0])
        return pickle.loads(self.file.read(self.where[k][1]))

    def __setitem__(self, k: int, x) -> None:
        if self.where[k] is None:
            self.kept[k] = x
            return
        raw = pickle.dumps(x, 5)
        if len(raw) != self.where[k][1]:
            raise ValueError("an object on file has another size than before")
        self._write(raw, self.where[k][0])


class Union:
    """Distinct numbers of all that is added, in order, with a value for each; merged when what is new exceeds what is there."""

    def __init__(self, kind):
        self.key, self.value, self.more, self.size = np.zeros(0, kind), np.zeros(0), [], 0

    def add(self, key: np.ndarray, value: np.ndarray | None = None) -> None:
        self.more.append((key, np.zeros(len(key)) if value is None else value.astype(np.float64)))
        self.size += len(key)
        if self.size > len(self.key) + BUCKET:
            self.merge()

    def merge(self) -> None:
        self.key, first = np.unique(np.concatenate([self.key, *(k for k, _ in self.more)]), return_index=True)
        self.value = np.concatenate([self.value, *(v for _, v in self.more)])[first]
        self.more, self.size = [], 0


def _keys(*arrays: np.ndarray) -> np.ndarray:
    """What draws of a dish depend on: 32 bits of a hash of its names."""
    h = np.full(1, len(arrays), np.uint64)
    for a in arrays:
        h = X.mix(h * _NONE + a.astype(np.uint64) + np.uint64(1))
    return (h >> np.uint64(32)).astype(np.uint32)


def _piece(full: list) -> tuple[Piece, np.ndarray, tuple]:
    """The restaurants that the blocks' parts of a piece make, where each part's n-grams are among their dishes, and names of contexts and words."""
    u, of_u = np.unique(np.concatenate([p[0] for p in full]), return_inverse=True)
    w, of_w = np.unique(np.concatenate([p[5] for p in full]), return_inverse=True)
    ending, spelled = np.zeros(len(u), np.int64), np.zeros(len(w))
    ending[of_u] = _joined(full, 1)
    spelled[of_w] = np.concatenate([p[6] for p in full])
    long, _, of_long = _distinct(np.repeat(of_u, _joined(full, 2)) << 32 | _joined(full, 3), len(u) << 32)
    w0 = np.concatenate(([0], np.cumsum([len(p[5]) for p in full])))
    word = of_w[np.repeat(w0[:-1], [len(p[7]) for p in full]) + _joined(full, 7)]
    gram, _, at = _distinct(np.repeat(of_long, _joined(full, 4)) * len(w) + word, len(long) * len(w))
    two, word = np.divmod(gram, len(w))
    of = long[two] >> 32
    dish, _, up = _distinct(of * len(w) + word, len(u) * len(w))
    customers = np.bincount(at, _joined(full, 8)).astype(np.int64)
    return Piece(4, np.bincount(two), customers, up, dish, _keys(u[of], long[two] & 0xFFFFFFFF, w[word])), at, (u, ending, w, spelled)


def _pieces(batches):
    """Rows of a bucket, piece by piece, as (piece, block, parts, ids, chars, n_parts)."""
    rows = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("piece", "block", "parts", "ids", "chars", "n_parts"))):
            if rows and row[0] != rows[0][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _seat(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seats the restaurants of a bucket, whole, and sums up the log probabilities for each block's documents."""
    return _seated(_pieces(batches), HELD)


def _seated(of_pieces, held: int):
    shelf, rows_of = Shelf(held), Shelf(held)
    contexts, words, dishes = Union(np.uint64), Union(np.uint64), Union(np.int64)
    names = Shelf(held // 4)
    for rows in of_pieces:
        parts = [_unpack(r[2]) for r in rows]
        full = [p for p in parts if p]
        if full:
            piece, at, own = _piece(full)
            contexts.add(own[0], own[1])
            words.add(own[2], own[3])
            shelf.append(piece, 32 * len(piece.customers) + 8 * len(piece.dish))
            names.append((own[0], own[2]), 8 * (len(own[0]) + len(own[2])))
            at = at.astype(np.min_scalar_type(int(at.max(initial=0))))
        rows_of.append((rows, at if full else None), sum(len(r[2]) for r in rows) + (at.nbytes if full else 0))
    del rows
    if len(shelf):
        contexts.merge()
        words.merge()
        width = len(words.key)
        for k in range(len(shelf)):
            piece, (u, w) = shelf[k], names[k]
            of, word = np.divmod(piece.dish, len(w))
            piece.dish = np.searchsorted(contexts.key, u)[of] * width + np.searchsorted(words.key, w)[word]
            dishes.add(piece.dish)
            shelf[k] = piece
        dishes.merge()
        for k in range(len(shelf)):
            piece = shelf[k]
            piece.dish = np.searchsorted(dishes.key, piece.dish)
            shelf[k] = piece
        of, word = np.divmod(dishes.key, width)
        ending = contexts.value.astype(np.int64)
        parents, _, up = _distinct(ending[of] * width + word, (int(ending.max()) + 1) * width)
        levels = [Level(3, dishes.key, width, _keys(contexts.key[of], words.key[word])), Level(2, parents, width, _keys(parents // width, words.key[parents % width], np.zeros(1)))]
        sample(shelf, levels, [up], np.exp(words.value[parents % width]), None, leave=True)
    done = 0
    for k in range(len(rows_of)):
        rows, at = rows_of[k]
        out = [(b"", b"")] * len(rows)
        if at is not None:
            log, done, start = np.log(shelf[done].mean / SAMPLES)[at], done + 1, 0
            for j, r in enumerate(rows):
                if p := _unpack(r[2]):
                    own = np.repeat(log[start : start + len(p[7])], p[8])
                    start += len(p[7])
                    total = np.bincount(p[9], own)
                    docs = np.flatnonzero(total)
                    out[j] = (_pack(np.diff(docs, prepend=0)), total[docs].tobytes())
        yield pa.RecordBatch.from_arrays([
            pa.array([r[1] for r in rows], pa.int64()), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary()),
            pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.list_(pa.int64())), pa.array([r[5] for r in rows], pa.int32())],
            names=["block", "doc", "total", "ids", "chars", "n_parts"])


def _total(rows: pa.Table) -> pa.Table:
    n_parts = rows.column("n_parts").to_pylist()
    if len(n_parts) != n_parts[0]:
        raise ValueError("the parts of a block aren't those that were dealt: docs came in another order when a task was run again")
    lists = zip(rows.column("ids").to_pylist(), rows.column("chars").to_pylist())
    ids, chars = next((i, c) for i, c in lists if i is not None)
    total, n = np.zeros(len(ids)), np.array(chars, np.int64)
    for doc, part in zip(rows.column("doc").to_pylist(), rows.column("total").to_pylist()):
        if doc:
            total[np.cumsum(_unpack(doc)[0], dtype=np.int64)] += np.frombuffer(part)
    perplexity = np.exp(np.minimum(-total / np.maximum(n, 1), 700)).round(6)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_scored": pa.array(n), "log_prob": pa.array(total.round(6)), "perplexity": pa.array(perplexity, mask=n == 0)})


def score(docs: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_scored, log_prob, perplexity (of a character): one row for each row of docs.

    Every character of every text is in one token (a run of letters and digits with the space before it, cut after each 32 characters, or a
    single other character), and every token counts for the model and is scored by it without its own occurrence. The restaurant of the two words before
    has that of the last one as its parent, this that of the word's last letters, whose base is a Pitman-Yor model of the words' spelling
    (the character before, none, uniform), for which each distinct word counts once. Each block of documents is dealt to the buckets
    of the restaurants, which are seated whole in one task, those of a large class of endings in pieces, and return a sum for each
    document. What is drawn depends on the names of a restaurant and a dish only: block and bucket, and the size of the input, change
    how the work is dealt, but not the model or its draws. All that is gathered grows with the corpus,
    but for a row for each pair of adjacent characters and each class of endings, which go to the driver.
    A null or empty text has n_scored and log_prob 0 and a null perplexity; repeated rows count
    and are scored each on its own, a null doc_id is kept, an empty table has no row. docs must come in the same order if a
    task is run again, as a table that is read does; else the job fails.
    """
    spark = docs.sparkSession
    rows = X.need(docs, "doc_id", "text")
    counts = rows.where("text <> ''").mapInArrow(lambda b: _statistics(b, block), COUNTS)
    found = counts.groupBy("share").applyInArrow(_summed, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    held = spark.sparkContext.broadcast(Plan(*(found.column(c).to_numpy() for c in ("kind", "key", "n")), bucket))
    dealt = rows.mapInArrow(lambda b: _deal(b, held, block), PARTS).repartition("bucket").sortWithinPartitions("bucket", "piece", "block")
    return dealt.groupBy("bucket").applyInArrow(_seat, SUMS).groupBy("block").applyInArrow(_total, "doc_id long, n_scored long, log_prob double, perplexity double")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
