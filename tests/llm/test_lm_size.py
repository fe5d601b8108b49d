"""What op10 returns must not depend on how its work is dealt, nor on where its pieces are held."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import _text as X
from skein.llm import lm


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("thernaedionis", k=rng.randrange(1, 7))) for _ in range(300)]
    return [(i, ". ".join(" ".join(rng.choices(words, range(300, 0, -1), k=rng.randrange(2, 9))) for _ in range(20))) for i in range(60)]


def test_blocks_and_buckets_change_nothing(spark, rows):
    """In one piece, and with classes of endings, words and documents that exceed buckets and blocks many times."""
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.log_prob for r in lm.score(d.coalesce(1)).collect()}
    for parts, block, bucket in ((1, 1 << 20, 200), (3, 5_000, 1_000)):
        got = {r.doc_id: r.log_prob for r in lm.score(d.repartition(parts, "doc_id").sortWithinPartitions("doc_id"), block, bucket).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-4


def test_pieces_in_a_file_are_those_in_memory(rows):
    chunks = [c[2:] for c in X.chunks([t for _, t in rows], 10_000)]
    found = lm._summed(pa.Table.from_batches([lm._counted(*c) for c in chunks]))
    plan = lm.Plan(*(found.column(c).to_numpy() for c in ("kind", "key", "n")), 300)
    buckets = {}
    for k, c in enumerate(chunks):
        for bucket, piece, part in lm._dealt(plan, k, *c)[1]:
            buckets.setdefault(bucket, {}).setdefault(piece, []).append((piece, k, part, None, None, 1))
    pieces = max(buckets.values(), key=len)
    assert len(pieces) > 3
    of = lambda held: [b.to_pydict() for b in lm._seated([pieces[k] for k in sorted(pieces)], held)]
    assert of(0) == of(1 << 30)


def test_words_count_once_for_spelling(rows):
    """However many blocks a word is in."""
    count = lambda limit: lm._summed(pa.Table.from_batches([lm._counted(*c[2:]) for c in X.chunks([t for _, t in rows], limit)])).sort_by([("kind", "ascending"), ("key", "ascending")])
    assert count(1_000) == count(1 << 30)


def test_binomial_numbers():
    rng = np.random.default_rng(2)
    for n, p in ((4, 0.3), (5, 0.9), (60, 0.2), (200, 0.4), (5000, 0.97)):
        x = lm.binomial(np.full(40_000, float(n)), np.full(40_000, p), rng.random(40_000), rng.random(40_000))
        assert x.min() >= 0 and x.max() <= n and abs(x.mean() - n * p) < 0.03 * np.sqrt(n * p * (1 - p)) and abs(x.var() / (n * p * (1 - p)) - 1) < 0.05
