"""What keeps the queries bounded: texts stay where they are, and nothing is gathered that grows with the input."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import vectors
from skein.operators import calibration, chunking, control, filters, graph, hierarchy, lexical, metrics, rerank, serving
from skein.plans import questions
from skein.queries import QUERIES
from skein.sources import tables

PLACES = [(i, "birds" if i < 4 else "boats", t) for i, t in enumerate(["crow nest", "heron pond", "swan lake", "owl night", "sail wind", "hull water", "anchor rope"])]


def _q(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _spied(monkeypatch, module, name):
    """The arguments of each call."""
    real, calls = getattr(module, name), []
    monkeypatch.setattr(module, name, lambda *a, **k: calls.append((a, k)) or real(*a, **k))
    return calls


TALES = [(i, f"A {w} sat there. It saw {w} and more! The end of {w}?\n\nAnother {w} came by.") for i, w in enumerate(["crow", "heron", "swan", "owl", "gull", "wren"])]


@pytest.fixture
def no_roots(monkeypatch):
    """Fails where the text of a whole collection is put together."""
    monkeypatch.setattr(hierarchy, "nodes", lambda *a, **k: pytest.fail("a collection's text was joined"))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(PLACES, "doc_id long, collection string, text string")


def test_route_needs_no_text_of_a_collection(spark, docs, no_roots):
    got = {(x.query_id, x.collection): x.score for x in hierarchy.route(docs, _q(spark, "owl across birds", "rope", "collection")).collect()}
    roots = spark.createDataFrame([(c, " ".join(["collection", c] + [t for _, k, t in PLACES if k == c])) for c in ("birds", "boats")], "collection string, text string")
    want = {(x.query_id, x.collection): x.score for x in lexical.bm25(roots, _q(spark, "owl across birds", "rope", "collection"), 2, doc="collection").collect()}
    assert got == pytest.approx(want) and len(got) == 4


def test_summary_search_needs_no_text_of_a_collection(spark, docs, no_roots):
    got = hierarchy.search(docs, _q(spark, "owl across birds", "rope")).collect()
    assert sorted((x.query_id, x.doc_id) for x in got if x["rank"] == 1) == [(0, 3), (1, 6)]


def test_summary_stats_need_no_text_of_a_collection(spark, docs, no_roots):
    assert hierarchy.stats(docs).first().asDict() == {"leaf_documents": 7, "summary_nodes": 5, "summary_words": 32}
    odd = spark.createDataFrame([(0, None, "a b"), (1, "x", None), (2, "x", "  ")], "doc_id long, collection string, text string")
    assert hierarchy.stats(odd).first().asDict() == {"leaf_documents": 3, "summary_nodes": 4, "summary_words": 4}


def test_digests_are_those_of_the_nodes(spark, docs):
    want = hierarchy.nodes(docs).select("node_id", "level", F.md5("text").alias("text_md5"), F.size("doc_ids").alias("n_documents")).collect()
    assert sorted(hierarchy.digests(docs).collect()) == sorted(want)


def test_index_holds_lists_of_postings(spark, tmp_path):
    docs = spark.createDataFrame([(i, "the cat" if i % 2 else "the dog the") for i in range(200)], "doc_id long, text string").coalesce(1)
    index = lexical.Index(docs, str(tmp_path / "i"), 4)
    assert index.read("segments").count() == 3 and index.posting_entries() == 400  # not a row for each posting
    got = index.bm25(_q(spark, "cat the"), 3).orderBy("rank").collect()
    want = lexical.bm25(docs, _q(spark, "cat the"), 3).orderBy("rank").collect()
    assert [x.doc_id for x in got] == [x.doc_id for x in want] == [1, 3, 5]


def test_binary_rank_shuffles_no_terms(spark):
    docs = spark.createDataFrame([(0, "a b c"), (1, "a b"), (2, "b b"), (3, None)], "doc_id long, text string")
    best = lexical.binary_rank(docs, _q(spark, "a b", "b", "a zzz"), 2, require_all_terms=True)
    assert "(term" not in _plan(best) and "SortMergeJoin" not in _plan(best)
    assert sorted((x.query_id, x.doc_id) for x in best.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_guarded_search_ranks_only_what_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "binary_rank", lambda *a, **k: pytest.fail("the whole index was ranked"))
    docs = spark.createDataFrame([(i, "a b" if i < 6 else "c", i % 2 == 0) for i in range(9)], "doc_id long, text string, ok boolean")
    got = filters.guarded_search(docs, _q(spark, "a"), F.col("ok"), F.lit(True), F.lit(True), 2).collect()
    assert [x.doc_id for x in got] == [0, 2]
    assert got[0].score == pytest.approx(__import__("math").log(1 + 10 / 7))  # weights are those of all


def test_served_queries_rank_only_what_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "binary_rank", lambda *a, **k: pytest.fail("the whole index was ranked"))
    docs = spark.createDataFrame([(0, "new crow", ["u"], True), (1, "new crow", [], True), (2, "new owl", ["u"], True)], "doc_id long, text string, roles array<string>, trusted boolean").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    g = serving.Guarded(docs, "2024-01-02", 9)
    assert g.query("crow", ["u"]).returned == (0,) and g.query("owl", ["x"]).returned == ()


def test_vector_rag_cuts_only_the_documents_found_again(spark, monkeypatch):
    cut = _spied(monkeypatch, chunking, "fixed")
    docs = spark.createDataFrame(TALES, "doc_id long, text string")
    got = control.naive_rag(docs, _q(spark, "a heron sat there"), 6, 1, 64, 2).orderBy("rank").collect()
    assert got[0].text.startswith("A heron sat") and [c[0][0].count() for c in cut] == [len({x.doc_id for x in got})]


def test_parent_child_search_links_only_the_documents_found(spark, monkeypatch):
    cut = _spied(monkeypatch, chunking, "paragraph")
    docs = spark.createDataFrame(TALES, "doc_id long, text string")
    got = chunking.parent_child_search(docs, _q(spark, "heron"), child_words=5, parent_words=9).collect()
    assert [x.parent_id for x in got][0].startswith("1::paragraph-") and cut[0][0][0].count() == 1


def test_hierarchical_search_scores_only_leaves_of_routed_documents(spark, monkeypatch):
    scored = _spied(monkeypatch, lexical, "bm25_scores")
    docs = spark.createDataFrame(TALES, "doc_id long, text string")
    got = chunking.hierarchical_search(docs, _q(spark, "heron"), route_k=1, leaf_words=5).collect()
    among = [k["among"] for _, k in scored if k.get("among") is not None]
    assert {x.chunk_id.split("::")[0] for x in got} == {"1"} and len(among) == 1 and {x.doc_id for x in among[0].collect()} == {1}


def test_semantic_chunks_shuffle_nothing(spark):
    docs = spark.createDataFrame([*TALES, (9, None), (10, "  ")], "doc_id long, text string")
    c = chunking.semantic(docs, 100, 0.1, 64)
    assert "Exchange" not in _plan(c) and "Window" not in _plan(c)
    got = [x.text for x in c.where("doc_id = 1").orderBy("start_word").collect()]
    s = ["A heron sat there.", "It saw heron and more!", "The end of heron?", "Another heron came by."]
    v = [np.array(x.v) for x in spark.createDataFrame([(x,) for x in s], "t string").select(vectors.hashing_embed("t", 64).alias("v")).collect()]
    want = [s[0]]
    for i in range(1, 4):
        want = [*want, s[i]] if v[i - 1] @ v[i] < 0.1 else [*want[:-1], want[-1] + " " + s[i]]
    assert got == want


def test_equal_rows_are_fitted_once(spark, monkeypatch):
    rows = spark.createDataFrame([(float(i % 2), i % 2 if i % 5 else 1 - i % 2) for i in range(50)], "x double, y int")
    whole = calibration.LogisticCalibrator(["x"]).fit(rows, "y")
    monkeypatch.setattr(calibration.LogisticCalibrator, "COLLECT", 3)
    many = calibration.LogisticCalibrator(["x"], epochs=3).fit(rows, "y")
    monkeypatch.setattr(calibration.LogisticCalibrator, "COLLECT", 4)
    monkeypatch.setattr(calibration.LogisticCalibrator, "predict", lambda self: pytest.fail("a job for each step"))
    few, again = calibration.LogisticCalibrator(["x"], epochs=3).fit(rows, "y"), calibration.LogisticCalibrator(["x"]).fit(rows, "y")
    assert few.weights == pytest.approx(many.weights) and again.weights == pytest.approx(whole.weights) and again.weights[0] > 0


def test_hashed_vectors_get_texts_not_features(spark):
    texts = ["Crow nest CROW", "", None, "a", "owl " * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vectors.hashing_embed("t", 16).alias("v"))
    assert "regexp_extract_all" not in _plan(df)
    for x in df.collect():
        t = (x.t or "").lower().split()
        want = np.zeros(16)
        for f in t + [f"{a}_{b}" for a, b in zip(t, t[1:])]:
            n = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            want[n % 16] += -1 if n >> 8 & 1 else 1
        assert x.v == (want / (np.sqrt(want @ want) or 1)).tolist()


def test_percentiles_gather_no_values(spark):
    v = np.concatenate((np.random.default_rng(1).normal(size=301).round(2), [-0.0, 0.0, 1e300, -1e300, 5e-324])).tolist()
    df = metrics.percentile(spark.createDataFrame([(x,) for x in [*v, None]], "x double"), "x", 0.0, 0.5, 0.95, 0.333, 1.0)
    assert "percentile(" not in _plan(df)
    assert list(df.first()) == pytest.approx([np.percentile(v, q) for q in (0, 50, 95, 33.3, 100)])
    assert list(metrics.percentile(spark.createDataFrame([], "x double"), "x", 0.5).first()) == [None]


@pytest.mark.parametrize("name", ["rrf", "weighted_fusion"])
def test_fusion_reads_one_stored_index(spark, monkeypatch, name):
    monkeypatch.setattr(lexical, "tfidf", lambda *a, **k: pytest.fail("an index of its own"))
    monkeypatch.setattr(lexical, "bm25", lambda *a, **k: pytest.fail("the documents were counted again"))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_features_are_those_of_the_candidates_only(spark, monkeypatch):
    docs, q = spark.createDataFrame(TALES, "doc_id long, text string"), _q(spark, "heron there")
    scored = _spied(monkeypatch, lexical, "bm25_scores")
    got = rerank.features(lexical.bm25(docs, q, 2), docs, q).collect()
    assert len(got) == 2 and [k["among"].count() for _, k in scored if k.get("among") is not None] == [2]
    assert all(x.bm25 == pytest.approx(x.dense) for x in got)


def test_norms_are_stored_when_they_are_needed(spark, tmp_path):
    index = lexical.Index(spark.createDataFrame(TALES, "doc_id long, text string"), str(tmp_path / "i"), 4)
    index.bm25(_q(spark, "crow"), 3).collect()
    assert not os.path.exists(tmp_path / "i" / "norms")
    assert [x.doc_id for x in index.tfidf(_q(spark, "crow"), 3).collect()] == [0] and index.read("norms").count() == 6


def test_upsert_moves_no_texts(spark):
    docs = spark.createDataFrame([(0, "crow", ["u"], True), (1, "owl", ["u"], True)], "doc_id long, text string, roles array<string>, trusted boolean").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    g = serving.Guarded(docs, "2024-01-02", 9)
    g.upsert(docs.where("doc_id = 0").withColumn("text", F.lit("gull")))
    assert "SortMergeJoin" not in _plan(g.docs) and g.query("gull", ["u"]).returned == (0,) and g.query("crow", ["u"]).returned == ()


def test_bigram_counts_are_dealt_by_the_size_of_the_input(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "A b a B"), (1, None), (2, "b a c"), (3, "x")], "doc_id long, text string")
    monkeypatch.setattr(lexical, "GRAM_BYTES", 1)
    monkeypatch.setattr(lexical, "HELD_GRAMS", 1)
    n = lexical.bigram_counts(docs)
    assert {x.gram: x.n for x in n.collect()} == {"a_b": 2, "b_a": 2, "a_c": 1}
    assert n.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_walks_advance_in_columns(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "r", "b", 1), ("b", "r", "c", 2), ("b", "r", "d", 3), ("e", "r", "f", 4)], "subject string, relation string, object string, doc_id long")
    seeds = spark.createDataFrame([("x", "a"), ("y", "e"), ("z", "a"), ("z", "f")], "seed string, node string")
    monkeypatch.setattr(graph, "WALKS", 2)
    got = {(x.seed, x.node): x.score for x in graph.pagerank_by_seed(edges, seeds).collect()}
    for seed, nodes in (("x", ["a"]), ("y", ["e"]), ("z", ["a", "f"])):
        want = {x.node: x.score for x in graph.pagerank(edges, spark.createDataFrame([(n,) for n in nodes], "node string")).collect() if x.score}
        assert {n: s for (w, n), s in got.items() if w == seed} == pytest.approx(want)


def test_evidence_is_dealt_by_size_and_asks_for_no_answers(spark, monkeypatch):
    monkeypatch.setattr(tables, "SPREAD_BYTES", 1 << 10)
    monkeypatch.setattr(questions, "format_answer", lambda rows: pytest.fail("an answer was made"))
    e = questions.evidence(spark, "/root/testdata/sf0.001", (questions.QUESTIONS[6],))
    assert "REPARTITION_BY_NUM" in _plan(e) and e.count() > 0


def test_sentence_chunks_are_packed_in_slices(spark):
    docs = spark.createDataFrame([*TALES, (9, None), (10, " \n "), (11, "One. Two!Three? ...  Four")], "doc_id long, text string")
    c = chunking.sentence(docs, 3)
    assert "MapInArrow" in _plan(c) and "EvalPython" not in _plan(c)
    assert [(x.start_word, x.end_word, x.text) for x in c.where("doc_id = 11").orderBy("start_word").collect()] == [(0, 3, "One. Two!Three? ..."), (3, 4, "Four")]
    assert {x.doc_id for x in c.collect()} == {0, 1, 2, 3, 4, 5, 11}


def test_adaptive_search_reads_only_the_texts_found(spark):
    docs = spark.createDataFrame(TALES, "doc_id long, text string")
    graph.use_checkpoints(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hit = control._best(docs, _q(spark, "heron"), "primary")
        assert "LeftSemi, BuildRight" in _plan(hit) and [x.doc_id for x in hit.collect()] == [1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
