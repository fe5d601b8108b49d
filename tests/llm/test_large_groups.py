"""Large groups of near copies, classes and links, each against all pairs."""

import numpy as np
import pyarrow as pa

from skein.llm import jaccard


def _group(sets, lead=0, leads=None, doc=None):
    packed = [np.ascontiguousarray(np.array(sorted(x), np.uint64).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes() for x in sets]
    n = len(sets)
    return pa.table({"lead": [lead] * n, "doc": pa.array(doc or list(range(n)), pa.int64()), "leads": leads or [[lead]] * n, "elements": pa.array(packed, pa.binary()), "tile": [0] * n, "tile_a": [0] * n, "tile_b": [0] * n})


def _near_copies(rng, n, base, size, changes):
    centres = [rng.integers(0, 1 << 40, size) for _ in range(base)]
    out = []
    for k in range(n):
        x = centres[k % base].copy()
        at = rng.integers(0, size, rng.integers(0, changes))
        x[at] = rng.integers(0, 1 << 40, len(at))
        out.append({int(y) for y in x})
    return out


def test_a_large_group_of_near_copies_needs_few_comparisons(monkeypatch):
    sets = _near_copies(np.random.default_rng(0), 3_000, 3, 80, 12)
    compared = []
    real = jaccard.Group.jaccards
    monkeypatch.setattr(jaccard.Group, "jaccards", lambda self, x, y: compared.append(len(y)) or real(self, x, y))
    got = jaccard._linked(_group(sets), 0.6, False).to_pylist()
    assert {(r["a"], r["b"]) for r in got} == {(k, k % 3) for k in range(3, 3_000)}
    assert sum(compared) < 20 * 3_000  # of 4.5 million pairs


def test_no_link_of_a_group_is_lost():
    rng = np.random.default_rng(1)
    sets = _near_copies(rng, 300, 7, 60, 40) + _near_copies(rng, 60, 3, 900, 500) + _near_copies(rng, 40, 2, 5, 4)
    leads = [[x for x in (3, 5) if rng.random() < 0.3] + [9] for _ in sets]
    want = {}
    for b in range(len(sets)):
        for a in range(b):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if j >= 0.6 - 1e-9 and not set(leads[a]) & set(leads[b]) - {9}:
                want[a, b] = round(j, 6)
    rows = _group(sets, 9, leads)
    assert {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in jaccard._pairs(rows, 0.6).to_pylist()} == want and len(want) > 500
    links = {k: sum(k in p for p in want) for k in range(len(sets))}
    got = {r["a"]: r["links"] for r in jaccard._linked(rows, 0.6, True).to_pylist()}
    assert got == {k: v for k, v in links.items() if v}


def test_classes_and_links_are_those_of_the_pairs(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id % 7 = 0").selectExpr("doc_id + 5000", "text")).union(docs.where("doc_id % 11 = 0").selectExpr("doc_id", "concat(text, ' and a few more words')"))
    docs = docs.union(spark.createDataFrame([(9_000, None), (None, "x y z"), (9_001, "")], "doc_id long, text string")).localCheckpoint()
    pairs = [(r.doc_a, r.doc_b) for r in jaccard.similar(docs).collect()]
    root, links = {r.doc_id: r.doc_id for r in docs.collect() if r.doc_id is not None}, {}
    for a, b in pairs:
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    want = sorted((k, v, links.get(k, 0)) for k, v in root.items())
    plain = lambda: sorted(tuple(r) for r in jaccard.classes(spark, docs).collect())
    assert plain() == want and len(pairs) > 20
    monkeypatch.setattr(jaccard, "ELEMENTS", 1 << 9)
    monkeypatch.setattr(jaccard, "TILE", 3)
    assert plain() == want
    assert jaccard.classes(spark, docs.where("false")).collect() == []
