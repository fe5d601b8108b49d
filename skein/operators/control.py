"""Adaptive retrieval in batches: routes, correction, follow-up questions, prompts, generation with reflection, and answers by extraction."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import vectors as V
from skein.functions.batches import SLICE_ROWS, slices
from skein.operators import chunking as K
from skein.operators import fusion as X
from skein.operators import lexical as L
from skein.operators import routing as R
from skein.operators import vectorsearch as S
from skein.operators.graph import use_checkpoints

#: From (query_id, prompt) to (query_id, answer, confidence); a model runs in it as mapInPandas.
Generator = Callable[[DataFrame], DataFrame]
UNKNOWN = "I do not know."


def _best(docs: DataFrame, asks: DataFrame, source: str) -> DataFrame:
    best = L.bm25(docs, asks, 1).checkpoint()
    hit = best.join(docs.select("doc_id", F.col("text").alias("body")).join(F.broadcast(best.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id")
    return asks.join(hit, "query_id").select("query_id", F.lit(source).alias("source"), "doc_id", "score", R.assess(F.col("text"), F.col("body")).alias("assessment"), "body")


def adaptive_search(queries: DataFrame, primary: DataFrame, fallback: DataFrame | None = None, route: Column | None = None, max_steps: int = 2) -> DataFrame:
    """query_id, route, step, source, query, doc_id, score, assessment, selected: every retrieval of every query.

    A query that needs none has no row. Others search primary; where that isn't judged correct, fallback, whose document then counts. An iterative
    query goes on, max_steps times in all, with a question about the name that its document brought up, until there is none, or nothing new is found.
    """
    if max_steps < 1:
        raise ValueError("max_steps must be positive")
    use_checkpoints(queries.sparkSession)
    routed = queries.select("query_id", "text", (route if route is not None else R.keyword_route("text")).alias("route")).where("route <> 'no_retrieval'").checkpoint()
    asks, taken, out = routed.select("query_id", "text"), None, None
    for step in range(max_steps):
        first = _best(primary, asks, "primary").checkpoint()
        wrong = first.where("assessment <> 'correct'").select("query_id")
        second = _best(fallback, asks.join(wrong, "query_id", "left_semi"), "fallback").checkpoint() if fallback is not None else first.where("false")
        chosen = first.join(second.select("query_id"), "query_id", "left_anti").unionByName(second)
        new = chosen if taken is None else chosen.join(taken, ["query_id", "doc_id"], "left_anti")
        new = new.select("query_id", "source", "doc_id", "body").checkpoint()
        rows = first.unionByName(second).join(asks.withColumnRenamed("text", "query"), "query_id").join(new.select("query_id", "source", F.lit(True).alias("selected")), ["query_id", "source"], "left")
        rows = rows.join(routed.select("query_id", "route"), "query_id").select("query_id", "route", F.lit(step).alias("step"), "source", "query", "doc_id", "score", "assessment", F.coalesce("selected", F.lit(False)).alias("selected"))
        out = rows if out is None else out.unionByName(rows)
        pair = new.select("query_id", "doc_id")
        taken = pair if taken is None else taken.union(pair)
        follow = new.join(routed.where("route = 'iterative'"), "query_id").select("query_id", R.bridge_query(F.col("text"), F.col("body")).alias("text"))
        asks = follow.where("text is not null and text <> ''").checkpoint()
        if asks.isEmpty():
            break
    return out


def traces(queries: DataFrame, steps: DataFrame, route: Column | None = None) -> DataFrame:
    """query_id, route, doc_ids (in the order found), corrected, retrieval_calls of adaptive_search()."""
    got = steps.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("selected"), F.struct("step", "doc_id")))), lambda x: x["doc_id"]).alias("doc_ids"), F.bool_or(F.col("source") == "fallback").alias("corrected"), F.count("*").alias("retrieval_calls"))
    q = queries.select("query_id", (route if route is not None else R.keyword_route("text")).alias("route")).join(got, "query_id", "left")
    kind = got.schema["doc_ids"].dataType
    return q.select("query_id", "route", F.coalesce("doc_ids", F.array().cast(kind)).alias("doc_ids"), F.coalesce("corrected", F.lit(False)).alias("corrected"), F.coalesce("retrieval_calls", F.lit(0)).alias("retrieval_calls"))


# --- prompts and generation -------------------------------------------------


def context_block(contexts: Column) -> Column:
    """Contexts, an array of struct(id, text), as "[id] text" with an empty line between."""
    return F.array_join(F.transform(contexts, lambda c: F.concat(F.lit("["), c["id"].cast("string"), F.lit("] "), c["text"])), "\n\n")


def grounded_prompt(question: Column, contexts: Column) -> Column:
    return F.concat(F.lit(f"Use the passages below and nothing else. If they don't tell, write: {UNKNOWN}\nBe brief.\n\n"), context_block(contexts), F.lit("\n\nQ: "), question, F.lit("\nA:"))


def direct_prompt(question: Column) -> Column:
    return F.concat(F.lit("Do what is asked, in the form that is asked for.\nQ: "), question, F.lit("\nA:"))


def relevance_prompt(question: Column, passage: Column) -> Column:
    return F.concat(F.lit("Does the passage help with the question? yes or no.\nQ: "), question, F.lit("\nPassage: "), passage, F.lit("\nA:"))


def yes_no_rerank(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, doc_id, score, rank of candidates (query_id, doc_id, question, text) by scorer's p_yes for (query_id, doc_id, prompt); nothing is added to them."""
    asked = candidates.select("query_id", "doc_id", relevance_prompt(F.col("question"), F.col("text")).alias("prompt"))
    s = scorer(asked).select("query_id", "doc_id", F.col("p_yes").alias("score"))
    return L.top_k(s, 1 << 30, positive=False)


def generate_adaptively(queries: DataFrame, primary: DataFrame, fallback: DataFrame, generator: Generator, utility: float = 0.65, reflect: bool = True) -> DataFrame:
    """query_id, route, answer, doc_ids, attempts, active_calls, refused.

    A first answer from what adaptive_search() selected is reflected upon; where it isn't confident, relevant, supported and useful enough, one more
    document is searched with question and answer, and answered from again. What still isn't supported and useful enough is refused.
    """
    use_checkpoints(queries.sparkSession)
    bodies = primary.select("doc_id", "text").union(fallback.select("doc_id", "text").join(primary.select("doc_id"), "doc_id", "left_anti"))
    steps = adaptive_search(queries, primary, fallback).checkpoint()
    kept = steps.where("selected").select("query_id", "doc_id", F.col("step").alias("place")).checkpoint()

    def contexts(of: DataFrame) -> DataFrame:
        c = of.join(bodies, "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", F.col("doc_id").alias("id"), "text"))).alias("c"))
        return c.select("query_id", F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("contexts"))

    def attempt(c: DataFrame) -> DataFrame:
        asked = queries.select("query_id", "text").join(c, "query_id")
        got = generator(asked.select("query_id", grounded_prompt(F.col("text"), F.col("contexts")).alias("prompt")))
        return asked.join(got, "query_id").withColumn("r", R.reflect(F.col("text"), F.col("answer"), F.transform("contexts", lambda x: x["text"]), F.col("confidence"))).checkpoint()

    first = attempt(contexts(kept))
    weak = F.col("r.retrieve") | ~F.col("r.relevant") | ~F.col("r.supported") | (F.col("r.utility") < utility)
    retry = first.where(weak) if reflect else first.where("false")
    again = retry.select("query_id", F.trim(F.concat_ws(" ", "text", "answer")).alias("text"))
    # one document that isn't there yet: of primary if it has any, else of fallback
    deep = L.bm25(primary, again, 16).select("query_id", "doc_id", F.lit(0).alias("tier"), "rank").union(L.bm25(fallback, again, 16).select("query_id", "doc_id", F.lit(1).alias("tier"), "rank"))
    fresh = deep.join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank"))).where("n = 1").select("query_id", "doc_id", F.lit(1 << 20).alias("place")).checkpoint()
    more = attempt(contexts(kept.join(fresh.select("query_id"), "query_id", "left_semi").unionByName(fresh)))
    final = first.join(more.select("query_id"), "query_id", "left_anti").withColumn("attempts", F.lit(1)).unionByName(more.withColumn("attempts", F.lit(2)))
    refused = (~F.col("r.supported") | (F.col("r.utility") < utility)) if reflect else F.lit(False)
    route = queries.select("query_id", R.keyword_route("text").alias("route"))
    with_context = final.join(route, "query_id").select("query_id", "route", F.when(refused, F.lit(UNKNOWN)).otherwise(F.col("answer")).alias("answer"), F.transform("contexts", lambda x: x["id"]).alias("doc_ids"), "attempts", (F.col("attempts") - 1).alias("active_calls"), refused.alias("refused"))
    direct = queries.join(route.where("route = 'no_retrieval'"), "query_id")
    plain = direct.select("query_id", "route").join(generator(direct.select("query_id", direct_prompt(F.col("text")).alias("prompt"))), "query_id")
    kind = with_context.schema["doc_ids"].dataType
    return with_context.unionByName(plain.select("query_id", "route", "answer", F.array().cast(kind).alias("doc_ids"), F.lit(1).alias("attempts"), F.lit(0).alias("active_calls"), F.lit(False).alias("refused")))


def clean_lines(text: Column, most: int) -> Column:
    """Lines without list marks, spaces and quotes around them; empty and repeated ones go."""
    bare = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.trim(F.regexp_replace(x, r"^\s*(?:[-*]|\d+[.)])\s*", "")), F.lit('"')))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: x != "")), 1, max(most, 0)) if most > 0 else F.array().cast("array<string>")


TRANSFORMS = {
    "rewrite": "Turn this into search keywords, one line: ",
    "multi_query": "Ask this in several other ways, a line each: ",
    "query2doc": "Write some lines that a page about this would have: ",
    "hyde": "Answer this as an encyclopedia would, in some lines: ",
    "decompose": "Split this into simpler questions, a line each: ",
}


def transform_queries(queries: DataFrame, generator: Generator, kind: str, most: int = 3) -> DataFrame:
    """query_id, n, text: the texts to search with in place of each query's, by one of TRANSFORMS; the query itself where nothing is generated."""
    asked = queries.select("query_id", F.concat(F.lit(TRANSFORMS[kind]), "text").alias("prompt"))
    j = queries.select("query_id", "text").join(generator(asked).select("query_id", F.trim("answer").alias("answer")), "query_id")
    if kind in ("rewrite", "hyde"):
        out = F.array(F.when(F.col("answer") != "", F.col("answer")).otherwise(F.col("text")))
    elif kind == "query2doc":
        out = F.array(F.trim(F.concat_ws(" ", "text", "answer")))
    elif kind == "multi_query":
        out = F.array_distinct(F.concat(F.array("text"), clean_lines(F.col("answer"), most)))
    else:
        parts = clean_lines(F.col("answer"), most)
        out = F.when(F.size(parts) > 0, parts).otherwise(F.array("text"))
    return j.select("query_id", F.posexplode(out).alias("n", "text"))


# --- answers without a model ------------------------------------------------


def extract_answer(queries: DataFrame, contexts: DataFrame, most: int = 2) -> DataFrame:
    """query_id, answer, cited: the sentences of contexts (query_id, position, doc_id, text) that share most of the question's words, in the order they stand."""
    if most < 1:
        raise ValueError("most must be positive")
    s = contexts.select("query_id", "position", "doc_id", F.posexplode(T.sentences("text")).alias("nth", "sentence")).join(queries.select("query_id", T.token_set("text").alias("q")), "query_id")
    s = s.withColumn("score", T.overlap(F.col("q"), T.tokens("sentence"))).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "position", "nth", "doc_id")
    best = s.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "nth", "sentence", "doc_id"))).alias("b"))
    kind = contexts.schema["doc_id"].dataType.simpleString()
    out = queries.select("query_id").join(best, "query_id", "left")
    return out.select("query_id", F.coalesce(F.array_join("b.sentence", " "), F.lit("")).alias("answer"), F.coalesce(F.array_distinct("b.doc_id"), F.array().cast(f"array<{kind}>")).alias("cited"))


def naive_rag(docs: DataFrame, queries: DataFrame, size: int = 80, overlap: int = 10, dimensions: int = 256, k: int = 3) -> DataFrame:
    """query_id, chunk_id, doc_id, text, score, rank: chunks by the cosine of hashed features; the answer is the text of rank 1, which cites its document."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, overlap less than size")
    use_checkpoints(docs.sparkSession)
    held: list[V.Hashes] = []

    def rows(batch: pa.RecordBatch):
        if not held:
            held.append(V.Hashes(dimensions))
        names = batch.column("doc").to_pylist()
        for lo, texts in slices(batch.column("text")):
            ids, cut = [], []
            for name, text in zip(names[lo:], texts):
                w = [" ".join(x) for x in K.windows(text, size, overlap)]
                ids += [f"{name}::chunk-{i}" for i in range(len(w))]
                cut += [x.lower() for x in w]
            for at in range(0, len(cut), SLICE_ROWS):
                yield pa.array(ids[at : at + SLICE_ROWS]), held[0].vectors(cut[at : at + SLICE_ROWS])

    asked = queries.select("query_id", V.hashing_embed("text", dimensions).alias("vector"))
    hits = S.top_k(docs.select(F.col("doc_id").cast("string").alias("doc"), "text"), asked, k, doc="chunk_id", rows=rows, kind="string").checkpoint()
    found = docs.join(F.broadcast(hits.select(K.document_of("chunk_id", docs).alias("doc_id")).distinct()), "doc_id", "left_semi")
    return hits.join(K.fixed(found, size, overlap).select("chunk_id", "doc_id", "text"), "chunk_id").select("query_id", "chunk_id", "doc_id", "text", "score", "rank")


def web_records(pages: DataFrame) -> DataFrame:
    """doc_id, locator, title, text, canonical of pages (page_id, url, html)."""
    title = T.clean_space(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("locator"), title.alias("title"), T.strip_html("html").alias("text"), T.canonical_url("url").alias("canonical"))


def web_search(records: DataFrame, queries: DataFrame, k: int = 8) -> DataFrame:
    """query_id, doc_id, score, rank over title and text of web_records()."""
    return L.bm25(records.select("doc_id", F.concat_ws(" ", "title", "text").alias("text")), queries, k)


def web_answer(records: DataFrame, queries: DataFrame, policy: DataFrame | None = None, as_of: Column | None = None, candidates: int = 8, k: int = 3) -> DataFrame:
    """query_id, answer, citation, doc_ids: the best page's text, verbatim. policy (doc_id, authority, updated_at) reranks the candidates."""
    if not 0 < k <= candidates:
        raise ValueError("k must be positive and not more than candidates")
    hits = web_search(records, queries, candidates)
    if policy is not None:
        h = hits.join(policy, "doc_id").join(records.select("doc_id", "canonical"), "doc_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        hits = X.web_rerank(h.select("query_id", "query", "doc_id", F.col("score").alias("lexical"), "authority", "updated_at", "canonical"), as_of, k)
    top = hits.where(F.col("rank") <= k).join(records.select("doc_id", "locator", "text"), "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "locator", "text"))).alias("h"))
    out = queries.select("query_id").join(top, "query_id", "left")
    first = F.element_at("h", 1)
    return out.select("query_id", F.coalesce(first["text"], F.lit("")).alias("answer"), first["locator"].alias("citation"), F.col("h.doc_id").alias("doc_ids"))


def select_context(sections: DataFrame, queries: DataFrame, threshold: int, markers: tuple[str, ...], k: int = 3) -> DataFrame:
    """query_id, route, section_id, place, score of sections (bundle_id, section_id, position, text) for queries (query_id, bundle_id, text).

    Short bundles, and questions about the whole of one, get all sections in order; others the k best, ranked among those of their bundle.
    """
    words = sections.groupBy("bundle_id").agg(F.sum(F.size(T.tokens("text"))).alias("words"))
    q = queries.join(words, "bundle_id").withColumn("route", R.long_context_route(F.col("text"), F.col("words"), threshold, markers))
    whole = q.where("route = 'direct'").join(sections.select("bundle_id", "section_id", "position"), "bundle_id").select("query_id", "route", "section_id", F.col("position").cast("int").alias("place"), F.lit(0.0).alias("score"))
    hits = L.bm25_within(sections.select("bundle_id", "section_id", "text"), q.where("route = 'retrieve'").select("bundle_id", "query_id", "text"), "bundle_id", doc="section_id")
    best = L.top_k(hits.select("query_id", "section_id", "score"), k, doc="section_id").select("query_id", F.lit("retrieve").alias("route"), "section_id", F.col("rank").alias("place"), "score")
    return whole.union(best)


def read_evidence(question: Column, context: Column, rules: tuple[tuple[str, str], ...], abstain: str = "ABSTAIN") -> Column:
    """What the pattern of the first rule (cue, pattern with one group) finds whose cue is in the question; values of several places are joined by "; "."""
    out = F.lit(abstain)
    for cue, pattern in reversed(rules):
        found = F.array_join(F.transform(F.regexp_extract_all(context, F.lit(pattern), F.lit(1)), lambda x: F.trim(x)), "; ")
        out = F.when(F.contains(F.lower(question), F.lit(cue)), F.when(found != "", found).otherwise(F.lit(abstain))).otherwise(out)
    return out
