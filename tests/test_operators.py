"""Hand-computed results of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import calibration, chunking, filters, fusion, graph, lexical, memory, metrics, routing
from skein.sources import tables
from skein.streaming import serving


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat"), (2, "the dog sat"), (3, "a bird"), (4, None)], "doc_id long, text string")


def test_text(spark):
    s = F.lit
    r = one(spark, T.tokens(s("Été 2 cats-X")), T.word_count(s("  a b\n c ")), T.sentences(s("One.  Two? three! ")), T.paragraphs(s("a b\n \nc")), T.jaccard(F.array(), F.array()), T.canonical_url(s("HTTPS://www.A.org/x/?q=1#z")), T.normalize_answer(s("  A  b ")))
    assert list(r) == [["t", "2", "cats", "x"], 3, ["One.", "Two?", "three!"], ["a b", "c"], 1.0, "a.org/x", "a b"]
    assert one(spark, T.tokens(F.lit(None).cast("string")))[0] == []
    assert list(one(spark, T.support_token(s("cats")), T.support_token(s("bus")))) == ["cat", "bus"]


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, V.cosine(a(1.0, 0.0), a(1.0, 1.0)), V.cosine(a(0.0, 0.0), a(1.0, 1.0)), V.maxsim(F.array(a(1.0, 0.0), a(0.0, 1.0)), F.array(a(1.0, 0.0), a(0.0, 0.5))))
    assert r[0] == pytest.approx(math.sqrt(0.5)) and r[1] == 0 and r[2] == 1.5
    with pytest.raises(Exception):
        one(spark, V.cosine(a(1.0), a(1.0, 2.0)))
    v = spark.createDataFrame([("a b",), ("",)], "t string").select(V.hashing_embed("t", 32)).collect()
    assert sum(x * x for x in v[0][0]) == pytest.approx(1) and not any(v[1][0])


def test_bm25(spark, docs):
    q = spark.createDataFrame([(0, "cat"), (1, "zebra"), (2, "the the")], "query_id int, text string")
    r = {(x.query_id, x.doc_id): x for x in lexical.bm25(docs, q, 5).collect()}
    n, df, avg = 4, 1, 11 / 4
    want = math.log((n + 1) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 6 / avg))
    assert r[0, 1].score == pytest.approx(want) and not any(k[0] == 1 for k in r) and r[2, 1].rank == 1
    assert lexical.bm25(docs, q, 0).collect() == []
    with pytest.raises(ValueError):
        lexical.bm25(docs, q, 1, b=2)


def test_binary_rank_and_changes(spark, docs):
    q = spark.createDataFrame([(0, "the sat dog")], "query_id int, text string")
    assert [x.doc_id for x in lexical.binary_rank(docs, q, 5, require_all_terms=True).collect()] == [2]
    ch = spark.createDataFrame([(1, "x", "delete", 5), (1, "y", "upsert", 9), (9, "z", "delete", 3), (3, "w", "delete", 4)], "doc_id long, text string, op string, generation long")
    assert {(x.doc_id, x.text) for x in lexical.apply_changes(docs, ch).collect()} == {(1, "y"), (2, "the dog sat"), (4, None)}
    assert lexical.generation_count(docs, ch).first()[0] == 3


@pytest.mark.parametrize("n,size,overlap", [(1, 3, 0), (7, 3, 1), (6, 3, 0), (10, 4, 3)])
def test_fixed_chunks(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    want, at = [], 0
    while True:
        want.append((at, min(n, at + size)))
        if at + size >= n:
            break
        at += size - overlap
    d = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "doc_id long, text string")
    got = chunking.fixed(d, size, overlap).orderBy("start_word").collect()
    assert [(r.start_word, r.end_word) for r in got] == want and all(r.text == " ".join(words[r.start_word : r.end_word]) for r in got)


def test_packing(spark):
    assert chunking.pack([3, 3, 3, 9, 1], 6) == [(0, 2), (2, 3), (3, 4), (4, 5)]
    assert chunking.pack([2, 2, 2, 2], 4, 1) == [(0, 2), (1, 3), (2, 4)]
    assert chunking.pack([2, 2, 2], 10, 0, [False, True, False]) == [(0, 1), (1, 3)]
    d = spark.createDataFrame([(1, "One two. Three four five. Six.")], "doc_id long, text string")
    assert [(r.text, r.start_word, r.end_word) for r in chunking.sentence(d, 4).orderBy("start_word").collect()] == [("One two.", 0, 2), ("Three four five. Six.", 2, 6)]


def test_fusion_and_selection(spark):
    r = spark.createDataFrame([(0, "a", 1, 1), (0, "a", 2, 2), (0, "b", 2, 1), (0, "b", 2, 3)], "query_id int, list string, doc_id int, rank int")
    got = {x.doc_id: x.score for x in fusion.reciprocal_rank_fusion(r).collect()}
    assert got[2] == pytest.approx(1 / 62 + 1 / 61) and got[1] == pytest.approx(1 / 61)
    s = spark.createDataFrame([(0, "a", 1, 5.0), (0, "a", 2, 5.0), (0, "b", 1, 1.0), (0, "b", 2, 3.0)], "query_id int, list string, doc_id int, score double")
    assert {x.doc_id: x.score for x in fusion.weighted_fusion(s, {"a": 1, "b": 1}).collect()} == {1: 0.0, 2: 0.5}
    c = spark.createDataFrame([(0, 1, "a b c", 3.0), (0, 2, "a b c", 2.9), (0, 3, "x y", 1.0)], "query_id int, doc_id int, text string, score double")
    assert [x.doc_id for x in fusion.mmr(c, 2, 0.5).orderBy("position").collect()] == [1, 3]
    p = spark.createDataFrame([(0, 1, 1, 5), (0, 2, 2, 9), (0, 3, 3, 4)], "query_id int, doc_id int, rank int, words int")
    assert sorted(x.doc_id for x in fusion.pack_context(p, 9).collect()) == [1, 3]  # the second doesn't fit, the third does
    e = spark.createDataFrame([(0, i, i) for i in range(1, 6)], "query_id int, doc_id int, rank int")
    assert [x.doc_id for x in fusion.edge_biased(e).orderBy("position").collect()] == [1, 3, 5, 4, 2]
    u = spark.createDataFrame([(0, 1, 0, 10, 10), (0, 1, 5, 15, 10)], "query_id int, doc_id int, start_word int, end_word int, words int")
    assert fusion.utilization(u).first().utilization == 0.75


def test_metrics(spark):
    rank = spark.createDataFrame([(0, 5, 1), (0, 7, 2), (0, 9, 3)], "query_id int, doc_id int, rank int")
    rel = spark.createDataFrame([(0, 7, 1.0), (0, 9, 2.0), (1, 1, 1.0)], "query_id int, doc_id int, grade double")
    m = {r.query_id: r for r in metrics.ranking_metrics(rank, rel).collect()}
    assert m[0].rr == 0.5 and m[0].ap == pytest.approx((1 / 2 + 2 / 3) / 2) and m[0].precision_5 == 0.4 and m[0].recall_1 == 0 and m[1].rr == 0 and m[0].complete_3 == 1
    dcg = 1 / math.log2(3) + 3 / math.log2(4)
    assert m[0].ndcg_3 == pytest.approx(dcg / (3 + 1 / math.log2(3)))
    r = one(spark, metrics.token_f1(F.lit("a a b"), F.lit("a b b")), metrics.token_f1(F.lit(""), F.lit("")), metrics.grounded_recall(F.lit("a z"), F.lit("a b")))
    assert r[0] == pytest.approx(2 / 3) and r[1] == 1 and r[2] == 0.5
    c = spark.createDataFrame([(1, 1.0, 1), (2, 0.0, 0), (3, 0.6, 0)], "id int, confidence double, correct int")
    k = metrics.calibration_metrics(c).first()
    assert k.brier == pytest.approx(0.12) and k.ece == pytest.approx(0.2) and k.aurc == pytest.approx((0 + 1 / 2 + 2 / 3) / 3)


def test_filters(spark):
    ok = lambda *a: filters.read_only(*a)[0]
    assert ok("select 1 from t", {"t"}, {"t"}) and not ok("drop table t", set(), set()) and not ok("select 1; select 2", set(), set()) and not ok("", set(), set()) and not ok("select 1", {"u"}, {"t"})
    t = spark.createDataFrame([("shared", ["a"]), ("x", []), ("x", ["b"]), ("y", ["a"])], "tenant string, roles array<string>")
    assert t.where(filters.tenant_allowed(F.col("tenant"), F.col("roles"), F.lit("x"), F.lit("a"))).count() == 2


def test_graph(spark):
    e = spark.createDataFrame([("a", "r", "b", 1), ("b", "r", "c", 2), ("c", "s", "d", 3), ("a", "q", "x", 4), ("x", "q", "c", 5)], "subject string, relation string, object string, doc_id long")
    p = graph.bfs(e, spark.createDataFrame([("a", "d"), ("a", "a")], "start string, goal string")).collect()
    assert len(p) == 1 and [x.node for x in p[0].path] == ["b", "c", "d"]
    assert {r.doc_id for r in graph.k_hop(e, spark.createDataFrame([("a",)], "node string"), 2).collect()} == {1, 2, 4, 5}
    score = {r.node: r.score for r in graph.pagerank(e, spark.createDataFrame([("a",)], "node string")).collect()}
    want, und = {n: float(n == "a") for n in score}, {}
    for s, _, o, _ in e.collect():
        und.setdefault(s, []).append(o)
        und.setdefault(o, []).append(s)
    for _ in range(24):
        nxt = {n: 0.15 * (n == "a") for n in want}
        for n in want:
            for o in und[n]:
                nxt[o] += 0.85 * want[n] / len(und[n])
        want = nxt
    assert all(score[n] == pytest.approx(want[n]) for n in want)


def test_memory_routing_calibration(spark):
    ev = spark.createDataFrame([(1, "k", 1, "blue sky"), (2, "k", 2, "grey sky"), (3, "m", 1, "green grass")], "event_id int, memory_key string, sequence int, text string")
    q = spark.createDataFrame([(0, "sky"), (1, "sky before"), (2, "grass before")], "query_id int, text string")
    assert {r.query_id: r.event_id for r in memory.memory_search(ev, q).collect()} == {0: 2, 1: 1, 2: 3}
    assert one(spark, routing.keyword_route(F.lit("2 plus 3")))[0] == "no_retrieval"
    assert one(spark, routing.assess(F.lit("red car"), F.lit("STALE: red car")))[0] == "incorrect"
    assert one(spark, routing.bridge_query(F.lit("who runs the lab"), F.lit("The lab is run by Kestrel")))[0] == "Kestrel runs"
    t = spark.createDataFrame([("one two", "a"), ("three four", "b")], "text string, label string")
    assert routing.NaiveBayes(t).classify(spark.createDataFrame([(0, "four"), (1, "zzz")], "query_id int, text string"), ("a", "b")).orderBy("query_id").collect()[0].label == "b"
    rows = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, y int")
    model = calibration.LogisticCalibrator(["x"]).fit(rows, "y")
    assert model.weights[0] > 0 and rows.select(model.predict()).first()[0] < 0.5


def test_as_of(spark):
    f = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9)], "id int, k string, t int")
    e = spark.createDataFrame([("k", 2, "old"), ("k", 5, "new")], "k string, t int, v string")
    assert {r.id: r.v for r in memory.as_of_last(f, e, "k", "t", "t", "v").collect()} == {1: "new", 2: None, 3: None}


def test_tables_and_streams(spark):
    assert tables.format_answer([]) == "NO_ROWS" and tables.format_answer([(3.0,)]) == "3" and tables.format_answer([("a", 1), ("b", 2)]) == "a=1; b=2"
    t = tables.Tables(spark, "/root/testdata/sf0.001")
    assert t.execute("SELECT count(*) AS n FROM nation WHERE n_regionkey = ?", ("nation",), [1]).first().n == 5
    with pytest.raises(ValueError):
        t.execute("DELETE FROM nation", ("nation",))
    base = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    at = serving.scratch(spark)
    spark.createDataFrame([(1, "c", "upsert", 1), (2, "b", "delete", 2)], "doc_id long, text string, op string, generation long").write.parquet(f"{at}/in")
    serving.upsert_stream(spark.readStream.schema("doc_id long, text string, op string, generation long").parquet(f"{at}/in"), base, f"{at}/t")
    assert [tuple(r) for r in serving.current(spark, f"{at}/t").collect()] == [(1, "c")]
