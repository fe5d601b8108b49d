"""Graph operators over edges (subject, relation, object, doc_id): hops are joins, and lineage is cut by checkpoints."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import lexical as L

ALIASES = {
    "currency": ["currency", "currencies"],
    "country": ["country", "countries"],
    "located_in": ["located", "location", "where", "host", "hosts"],
    "studies": ["study", "studies", "topic", "topics", "research"],
    "includes": ["include", "includes", "lab", "labs", "site", "sites", "network"],
}


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names; where none is named, to a local one, which only a local session can read: elsewhere that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoint-"))


def undirected(edges: DataFrame) -> DataFrame:
    """src, dst, relation, doc_id: each edge both ways, parallel ones kept."""
    a = edges.select(F.col("subject").alias("src"), F.col("object").alias("dst"), "relation", "doc_id")
    return a.union(edges.select(F.col("object").alias("src"), F.col("subject").alias("dst"), "relation", "doc_id"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("subject").alias("node")).union(edges.select(F.col("object").alias("node"))).distinct()


def match_entities(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, node, position: nodes all of whose tokens the query has, those with more tokens first, then by name.

    A node is found through its first token, so no query meets a node that it shares nothing with.
    """
    n = nodes(edges).withColumn("t", T.token_set("node")).where("size(t) > 0").withColumn("key", F.element_at("t", 1)).withColumn("size", F.size(T.tokens("node")))
    q = queries.select("query_id", T.token_set("text").alias("q")).withColumn("key", F.explode("q"))
    m = q.join(n, "key").where(F.size(F.array_except("t", "q")) == 0)
    return m.select("query_id", "node", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("size"), "node")).alias("position"))


def target_relation(text: Column | str) -> Column:
    """The first relation, in a fixed order of preference, one of whose names the query has; null if none."""
    t = T.tokens(text)
    out = F.lit(None).cast("string")
    for relation, names in reversed(ALIASES.items()):
        out = F.when(F.arrays_overlap(t, F.array(*map(F.lit, names))), relation).otherwise(out)
    return out


def k_hop(edges: DataFrame, roots: DataFrame, hops: int = 4) -> DataFrame:
    """root, subject, relation, object, doc_id: the edges that begin fewer than hops steps from a root (column node), along their direction."""
    use_checkpoints(edges.sparkSession)
    reached = roots.select(F.col("node").alias("root"), "node").distinct()
    frontier, parts = reached, None
    step = edges.select(F.col("subject").alias("node"), "relation", "object", "doc_id")
    for _ in range(hops):
        out = frontier.join(step, "node").select("root", F.col("node").alias("subject"), "relation", "object", "doc_id").distinct().checkpoint()
        parts = out if parts is None else parts.union(out)
        frontier = out.select("root", F.col("object").alias("node")).distinct().join(reached, ["root", "node"], "left_anti").checkpoint()
        reached = reached.union(frontier)
        if frontier.isEmpty():
            break
    return parts.distinct()


def bfs(edges: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    """start, goal, path: the shortest undirected path of edges between nodes, the first by (node, relation, doc_id) among equals.

    All searches advance together, a hop a join; a node that a search has reached isn't
    entered again. The path of nodes and documents travels with the frontier.
    """
    use_checkpoints(edges.sparkSession)
    hop = undirected(edges)
    empty = F.array().cast("array<struct<node:string,relation:string,doc_id:bigint>>")
    front = pairs.where("start <> goal").select("start", "goal", F.col("start").alias("node"), empty.alias("path")).distinct()
    seen, found = front.select("start", "goal", "node"), None
    for _ in range(max_hops):
        nxt = front.join(hop, front["node"] == hop["src"]).select("start", "goal", F.col("dst").alias("node"), F.concat("path", F.array(F.struct(F.col("dst").alias("node"), "relation", F.col("doc_id").cast("bigint").alias("doc_id")))).alias("path"))
        nxt = nxt.join(seen, ["start", "goal", "node"], "left_anti").groupBy("start", "goal", "node").agg(F.min("path").alias("path")).checkpoint()
        done = nxt.where("node = goal").select("start", "goal", "path")
        found = done if found is None else found.union(done)
        front = nxt.join(done.select("start", "goal"), ["start", "goal"], "left_anti")
        seen = seen.union(front.select("start", "goal", "node"))
        if front.isEmpty():
            break
    return found


def path_documents(paths: DataFrame, k: int = 5) -> DataFrame:
    """start, goal, doc_id, score: the distinct documents of a path, 1 for the first, 1/2 for the second and so on."""
    p = paths.select("start", "goal", F.posexplode("path").alias("i", "e")).groupBy("start", "goal", F.col("e.doc_id").alias("doc_id")).agg(F.min("i").alias("i"))
    r = p.withColumn("n", F.row_number().over(Window.partitionBy("start", "goal").orderBy("i")))
    return r.where(F.col("n") <= k).select("start", "goal", "doc_id", (1.0 / F.col("n")).alias("score"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 24, cut_every: int = 6) -> DataFrame:
    """node, score: personalised PageRank, an exact number of rounds from the seeds (column node; all nodes if there is none).

    Parallel edges count each, and the mass of a node without neighbours is lost. The edges
    are partitioned by source once and reused; every cut_every rounds the scores are checkpointed.
    """
    use_checkpoints(edges.sparkSession)
    hop = undirected(edges).groupBy("src", "dst").agg(F.count("*").alias("m"))
    hop = hop.withColumn("share", F.col("m") / F.sum("m").over(Window.partitionBy("src"))).select("src", "dst", "share").checkpoint()
    all_nodes = nodes(edges)
    start = all_nodes.join(seeds.select("node").distinct(), "node", "left_semi")
    if start.isEmpty():
        start = all_nodes
    teleport = all_nodes.join(start.withColumn("is_seed", F.lit(True)), "node", "left").withColumn("seeded", F.coalesce("is_seed", F.lit(False)).cast("double"))
    teleport = teleport.crossJoin(start.agg(F.count("*").alias("n"))).select("node", (F.col("seeded") / F.col("n")).alias("score")).checkpoint()
    score = teleport
    for i in range(iterations):
        moved = score.join(hop, score["node"] == hop["src"]).select(F.col("dst").alias("node"), (damping * F.col("score") * F.col("share")).alias("score"))
        score = moved.union(teleport.select("node", ((1 - damping) * F.col("score")).alias("score"))).groupBy("node").agg(F.sum("score").alias("score"))
        if (i + 1) % cut_every == 0:
            score = score.checkpoint()
    return score


def path_to_relation(edges: DataFrame, asks: DataFrame, max_hops: int = 6) -> DataFrame:
    """start, relation, path: the first directed path from start whose last edge has the relation asked for, by (relation, object, doc_id) among equally short ones."""
    use_checkpoints(edges.sparkSession)
    step = edges.select(F.col("subject").alias("at"), F.struct(F.col("relation"), F.col("object").alias("node"), F.col("doc_id").cast("bigint").alias("doc_id")).alias("edge"))
    empty = F.array().cast("array<struct<relation:string,node:string,doc_id:bigint>>")
    front = asks.select("start", "relation", F.col("start").alias("node"), empty.alias("path")).distinct()
    seen, found = front.select("start", "relation", "node"), None
    for _ in range(max_hops):
        nxt = front.join(step, front["node"] == step["at"]).select("start", "relation", F.col("edge.node").alias("node"), (F.col("edge.relation") == F.col("relation")).alias("done"), F.concat("path", F.array("edge")).alias("path")).checkpoint()
        done = nxt.where("done").groupBy("start", "relation").agg(F.min("path").alias("path"))
        found = done if found is None else found.union(done)
        front = nxt.join(done.select("start", "relation"), ["start", "relation"], "left_anti").join(seen, ["start", "relation", "node"], "left_anti")
        front = front.groupBy("start", "relation", "node").agg(F.min("path").alias("path")).checkpoint()
        seen = seen.union(front.select("start", "relation", "node"))
        if front.isEmpty():
            break
    return found


def network_roots(edges: DataFrame) -> DataFrame:
    """node: what includes others and is called a network."""
    return edges.where((F.col("relation") == "includes") & F.endswith(F.lower("subject"), F.lit("network"))).select(F.col("subject").alias("node")).distinct()


def path_search(edges: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, doc_id, score, rank: the documents along the shortest path between a query's first two entities, or from its only one to the relation it asks for."""
    seeds = match_entities(queries, edges).where("position <= 2").groupBy("query_id").agg(F.max(F.when(F.col("position") == 1, F.col("node"))).alias("start"), F.max(F.when(F.col("position") == 2, F.col("node"))).alias("goal"))
    asked = seeds.join(queries.select("query_id", target_relation("text").alias("relation")), "query_id")
    two = asked.where("goal is not null")
    one = asked.where("goal is null and relation is not null")
    a = bfs(edges, two.select("start", "goal").distinct(), 64).join(two.select("query_id", "start", "goal"), ["start", "goal"]).select("query_id", F.col("path.doc_id").alias("docs"))
    b = path_to_relation(edges, one.select("start", "relation").distinct()).join(one.select("query_id", "start", "relation"), ["start", "relation"]).select("query_id", F.col("path.doc_id").alias("docs"))
    d = a.union(b).select("query_id", F.posexplode(F.array_distinct("docs")).alias("i", "doc_id")).where(F.col("i") < k)
    return d.select("query_id", "doc_id", (1.0 / (F.col("i") + 1)).alias("score"), (F.col("i") + 1).alias("rank"))


_ALLOWED = {"country": ("country", "includes", "located_in"), "currency": ("country", "currency", "includes", "located_in"), "studies": ("includes", "studies")}


def community_search(edges: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10, hops: int = 5, roots: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank of the edges that a query's networks reach, all networks if it names none.

    3 for the relation asked for, else 1, plus .25 and .5 for each of the query's tokens in the document and in the
    relation's name; a relation that a question of this kind has no use for doesn't count. roots: the networks (column node).
    """
    roots = network_roots(edges) if roots is None else roots
    asked = queries.select("query_id", T.token_set("text").alias("q"), target_relation("text").alias("target"))
    named = match_entities(queries, edges).join(roots, "node", "left_semi").select("query_id", F.col("node").alias("root"))
    free = asked.join(named, "query_id", "left_anti").select("query_id").crossJoin(roots.select(F.col("node").alias("root")))  # a row for each network
    reached = k_hop(edges, roots, hops).select("root", "relation", "doc_id").distinct()
    hits = named.union(free).join(reached, "root").select("query_id", "relation", "doc_id").distinct().join(asked, "query_id")
    fits = F.lit(True)
    for target, allowed in _ALLOWED.items():
        fits = fits & ((F.coalesce("target", F.lit("")) != target) | F.col("relation").isin(*allowed))
    text = hits.where(fits).join(docs.select("doc_id", T.token_set("text").alias("t")), "doc_id")
    named_by = T.token_set(F.replace(F.col("relation"), F.lit("_"), F.lit(" ")))
    score = F.when(F.col("relation") == F.col("target"), 3.0).otherwise(1.0) + 0.25 * F.size(F.array_intersect("t", "q")) + 0.5 * F.size(F.array_intersect(named_by, F.col("q")))
    return L.top_k(text.groupBy("query_id", "doc_id").agg(F.max(score).alias("score")), k)


GLOBAL_CUES = ("across", "all", "most", "overall")


def route_level(edges: DataFrame, queries: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """query_id, level: high for a query without entities, with a word for the whole, or that asks a network for countries; else low."""
    roots = network_roots(edges) if roots is None else roots
    seeds = match_entities(queries, edges).join(roots.withColumn("is_root", F.lit(True)), "node", "left").groupBy("query_id").agg(F.count("*").alias("n"), F.coalesce(F.bool_or("is_root"), F.lit(False)).alias("network"))
    j = queries.select("query_id", F.arrays_overlap(T.tokens("text"), F.array(*map(F.lit, GLOBAL_CUES))).alias("whole"), target_relation("text").alias("target")).join(seeds, "query_id", "left")
    high = F.col("n").isNull() | F.col("whole") | (F.col("network") & (F.coalesce("target", F.lit("")) == "country"))
    return j.select("query_id", F.when(high, "high").otherwise("low").alias("level"))


def dual_level_search(edges: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, level, doc_id, score, rank: path_search() for low, community_search() for high queries."""
    level = route_level(edges, queries).checkpoint()
    part = lambda x: queries.join(level.where(F.col("level") == x), "query_id", "left_semi")
    low, high = path_search(edges, part("low"), k), community_search(edges, docs, part("high"), k)
    return low.select("query_id", F.lit("low").alias("level"), "doc_id", "score", "rank").union(high.select("query_id", F.lit("high").alias("level"), "doc_id", "score", "rank"))


#: Walks that advance together, a column each.
WALKS = 16


def pagerank_by_seed(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 24, cut_every: int = 6) -> DataFrame:
    """seed, node, score: one personalised PageRank for each value of column seed, over the nodes (column node) it starts from; WALKS of them advance in one join a round.

    The edges are partitioned and sorted by source once and kept; a round shuffles a row for each node that a walk has reached.
    """
    spark = edges.sparkSession
    use_checkpoints(spark)
    hop = undirected(edges).groupBy("src", "dst").agg(F.count("*").alias("m"))
    hop = hop.withColumn("share", F.col("m") / F.sum("m").over(Window.partitionBy("src"))).select("src", "dst", "share").checkpoint()
    hop = hop.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src").sortWithinPartitions("src").persist()
    s = seeds.select("seed", "node").distinct()
    start = s.withColumn("score", 1.0 / F.count("*").over(Window.partitionBy("seed"))).checkpoint()
    names, out = sorted(r["seed"] for r in start.select("seed").distinct().collect()), []
    try:
        for lo in range(0, len(names), WALKS):
            walks = {f"w{i}": name for i, name in enumerate(names[lo : lo + WALKS])}
            teleport = start.where(F.col("seed").isin(*walks.values())).groupBy("node").agg(*[F.sum(F.when(F.col("seed") == name, F.col("score"))).alias(w) for w, name in walks.items()]).checkpoint()
            score = teleport
            for i in range(iterations):
                moved = score.join(hop, score["node"] == hop["src"]).select(F.col("dst").alias("node"), *[(damping * F.col(w) * F.col("share")).alias(w) for w in walks])
                score = moved.union(teleport.select("node", *[((1 - damping) * F.col(w)).alias(w) for w in walks])).groupBy("node").agg(*[F.sum(w).alias(w) for w in walks])
                if (i + 1) % cut_every == 0 or i + 1 == iterations:
                    score = score.checkpoint()
            each = F.explode(F.array(*[F.struct(F.lit(name).alias("seed"), F.col(w).alias("score")) for w, name in walks.items()]))
            out.append(score.select("node", each.alias("e")).select("e.seed", "node", "e.score").where("score is not null"))
    finally:
        hop.unpersist()
    return reduce(DataFrame.union, out) if out else start.select("seed", "node", "score")


def associative_search(edges: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 5, damping: float = 0.85, iterations: int = 24) -> DataFrame:
    """query_id, doc_id, score, rank by PageRank from a query's entities.

    A document has the score of its best edge, the sum of its ends' scores. Several entities walk each on its own, and an edge has the
    geometric mean (an edge that a walk doesn't reach counts 1e-12 in it); with one, or with none, from which all nodes
    are seeds, .05 of the lexical score over the query's best is added. Edges that no walk reaches aren't ranked.
    """
    found = match_entities(queries, edges).select("query_id", "node")
    n = queries.select("query_id").join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").fillna(0, "n")
    seeds = found.select(F.col("node").alias("seed"), "node").distinct().union(nodes(edges).select(F.lit("").alias("seed"), "node"))
    score = pagerank_by_seed(edges, seeds, damping, iterations).checkpoint()
    ends = edges.select("subject", "object", "doc_id").withColumn("edge", F.monotonically_increasing_id()).checkpoint()
    half = ends.select("edge", "doc_id", F.explode(F.array("subject", "object")).alias("node"))
    by_edge = half.join(score, "node").groupBy("seed", "edge", "doc_id").agg(F.sum("score").alias("s"))
    of = found.select("query_id", F.col("node").alias("seed")).union(n.where("n = 0").select("query_id", F.lit("").alias("seed")))
    logs = of.join(by_edge, "seed").groupBy("query_id", "edge", "doc_id").agg(F.sum(F.log(F.greatest("s", F.lit(1e-12)))).alias("logs"), F.count("*").alias("walks"))
    each = F.greatest("n", F.lit(1))
    best = logs.join(n, "query_id").withColumn("score", F.exp((F.col("logs") + (each - F.col("walks")) * F.log(F.lit(1e-12))) / each)).groupBy("query_id", "doc_id", "n").agg(F.max("score").alias("score"))
    lex = L.bm25_merged(docs, queries)
    lex = lex.select("query_id", "doc_id", (F.col("score") / F.max("score").over(Window.partitionBy("query_id"))).alias("lex"))
    s = best.join(lex, ["query_id", "doc_id"], "left").withColumn("score", F.col("score") + F.when(F.col("n") >= 2, 0.0).otherwise(0.05 * F.coalesce("lex", F.lit(0.0))))
    return L.top_k(s.select("query_id", "doc_id", "score"), k, positive=False)


def stats(edges: DataFrame) -> DataFrame:
    """One row: graph_nodes, graph_edges."""
    return nodes(edges).agg(F.count("*").alias("graph_nodes")).crossJoin(edges.agg(F.count("*").alias("graph_edges")))
