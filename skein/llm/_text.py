"""Vectorised text primitives: code points, word boundaries, rolling hashes.

Texts are handled in chunks of about half a million characters, so that the
memory of a worker does not depend on the Arrow batch it was handed, and a very
long text simply becomes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

TABLE = 0x20000
CHUNK_CHARS = 1 << 19
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def _table(kind: str) -> np.ndarray:
    if kind not in _tables:
        chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(TABLE)]
        if kind == "lower":
            low = ((c.lower(), c) for c in chars)
            out = np.array([ord(x) if len(x) == 1 else ord(c) for x, c in low], np.uint32)
        elif kind == "word":
            out = np.array([c.isalnum() for c in chars], bool)
        else:
            out = np.array([c.isalpha() for c in chars], bool)
        _tables[kind] = out
    return _tables[kind]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash multiplier and of its inverse modulo 2**64, n + 1 of each."""
    if "pow" not in _tables or len(_tables["pow"]) < n + 1:
        size = max(n + 1, CHUNK_CHARS + 2)
        for name, base in (("pow", _MULT), ("inv", _INV)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _tables[name] = np.cumprod(factors, dtype=np.uint64)
    return _tables["pow"], _tables["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, code points, bounds); a null text is an empty one."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit or i + 1 == len(texts):
            part = [t or "" for t in texts[lo : i + 1]]
            cp = np.frombuffer("".join(part).encode("utf-32-le", "replace"), "<u4")
            yield lo, i + 1, cp, np.concatenate(([0], np.cumsum([len(t) for t in part]))).astype(np.int64)
            lo, size = i + 1, 0


def lower(cp: np.ndarray) -> np.ndarray:
    """Lower case, character by character: offsets stay those of the text."""
    if len(cp) and cp.max() >= TABLE:
        return np.where(cp < TABLE, _table("lower")[np.minimum(cp, TABLE - 1)], cp)
    return _table("lower")[cp]


def flags(cp: np.ndarray, kind: str = "word") -> np.ndarray:
    if len(cp) and cp.max() >= TABLE:
        return (cp >= TABLE) | _table(kind)[np.minimum(cp, TABLE - 1)]
    return _table(kind)[cp]


class Words:
    """Words (runs of letters and digits, in lower case) of a chunk of documents.

    start, end: character offsets in the chunk; hash: 64 bits; bounds: the words
    of document d are bounds[d]:bounds[d + 1].
    """

    def __init__(self, cp: np.ndarray, bounds: np.ndarray):
        n = len(cp)
        self.low, self.doc_bounds = lower(cp), bounds
        word = flags(self.low)
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        before = np.concatenate(([False], word[:-1])) if n else word
        after = np.concatenate((word[1:], [False])) if n else word
        self.start = np.flatnonzero(word & (~before | first[:n]))
        self.end = np.flatnonzero(word & (~after | first[1:])) + 1
        pw, inv = powers(n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * pw[:n], dtype=np.uint64)))
        self.hash = mix((total[self.end] - total[self.start]) * inv[self.start])
        self.bounds = np.searchsorted(self.start, bounds)

    def __len__(self) -> int:
        return len(self.start)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that begin an n-gram within their document, and the n-grams' hashes."""
        w = len(self)
        if w < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pw, inv = powers(w)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * pw[:w], dtype=np.uint64)))
        room = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(w)
        at = np.flatnonzero(room >= n)
        return at, mix((total[at + n] - total[at]) * inv[at] + np.uint64(n))


def checkpoint_dir(spark) -> None:
    """Checkpoints go to the shared folder that the session names; a local one is set only where none is named, and only for a local session."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="skein-checkpoint-")
        sc.setCheckpointDir(named)


def need(df, *names: str):
    """The named columns, and no others, of a table that may have more."""
    return df.select(*[df[f"`{n}`"] for n in names])


def fresh(df, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def map_rows(df, run):
    """df.mapInArrow(run) with df's own columns, whatever their names."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
