"""Classes, links and best matches of recordings, against the pairs."""

import numpy as np

from skein.llm import media


def test_classes_and_links_are_those_of_the_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(4):
        a = rng.integers(1, 1 << 31, 40).astype(np.int32)
        rows.append((10 * k, a.tolist()))
        for j in range(1, 1 + k):
            b = a.copy()
            b[6 * j :] ^= 0x00FF0000 >> j
            rows.append((10 * k + j, b[j:].tolist()))
    prints = spark.createDataFrame([*rows, (99, []), (98, None), (None, rows[0][1])], "rec_id long, words array<int>")
    pairs = media.align(prints).collect()
    root, links, best = {k: k for k, _ in [*rows, (99, 0), (98, 0)]}, {}, {}
    for p in pairs:
        for a, b, o in ((p.rec_a, p.rec_b, p.offset), (p.rec_b, p.rec_a, -p.offset)):
            links[a] = links.get(a, 0) + 1
            best[a] = min(best.get(a, (2,)), (p.bit_error, -p.n_overlap, b, o))
        x, y = root[p.rec_a], root[p.rec_b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r.rec_id: r for r in media.classes(spark, prints).collect()}
    assert {k: (r.class_id, r.n_links) for k, r in got.items()} == {k: (v, links.get(k, 0)) for k, v in root.items()} and len(pairs) >= 6
    assert {k: (r.bit_error, -r.n_overlap, r.best_id, r.offset) for k, r in got.items() if r.n_links} == best
    assert all(r.best_id is None and r.bit_error is None for r in got.values() if not r.n_links)
    assert media.classes(spark, prints.where("false")).collect() == []
