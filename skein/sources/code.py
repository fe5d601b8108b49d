"""Python source as a table of symbols and a call graph."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import lexical as L

_SYMBOL = pa.schema([("symbol_id", pa.string()), ("path", pa.string()), ("name", pa.string()), ("qualname", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("docstring", pa.string()), ("source", pa.string()), ("calls", pa.list_(pa.string())), ("imports", pa.map_(pa.string(), pa.string()))])


def read(spark: SparkSession, root: str) -> DataFrame:
    """path, text of all .py files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").load(root)
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def _call_name(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _symbols(path: str, text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    lines, imports = text.splitlines(), {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports |= {a.asname or a.name.split(".")[0]: a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            imports |= {a.asname or a.name: f"{node.module or ''}.{a.name}".lstrip(".") for a in node.names}

    def visit(body, prefix, inside_class):
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                qual, first, last = f"{prefix}{node.name}", node.lineno - 1, node.end_lineno
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if inside_class else "function"
                calls = sorted({c for n in ast.walk(node) if isinstance(n, ast.Call) and (c := _call_name(n.func))}) if kind != "class" else []
                yield {"symbol_id": f"{path}::{qual}", "path": path, "name": node.name, "qualname": qual, "kind": kind, "line": node.lineno, "end_line": node.end_lineno, "docstring": ast.get_docstring(node) or "", "source": "\n".join(lines[first:last]), "calls": calls, "imports": list(imports.items())}
                if kind == "class":
                    yield from visit(node.body, qual + ".", True)

    yield from visit(tree.body, "", False)


def symbols(files: DataFrame) -> DataFrame:
    """One row a function, class or method of files (path, text), with its span, source, docstring, calls and the file's imports; a file that doesn't parse has none."""

    def run(batches):
        for batch in batches:
            rows = [s for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) if t for s in _symbols(p, t)]
            yield pa.RecordBatch.from_pylist(rows, schema=_SYMBOL)

    return files.select("path", "text").mapInArrow(run, "symbol_id string, path string, name string, qualname string, kind string, line int, end_line int, docstring string, source string, calls array<string>, imports map<string,string>")


def call_graph(found: DataFrame) -> DataFrame:
    """caller, callee: calls that name a symbol beyond doubt.

    self.x is a method of the same class's file and class, a name of the same file comes next, then an imported name by the
    last part of what it stands for, then a name that only one symbol has.
    """
    calls = found.select(F.col("symbol_id").alias("caller"), "path", "qualname", "imports", F.explode("calls").alias("call"))
    head, last = F.element_at(F.split("call", r"\."), 1), F.element_at(F.split("call", r"\."), -1)
    owner = F.regexp_replace("qualname", r"\.[^.]*$", "")
    calls = calls.withColumn("target", F.when(head == "self", F.concat_ws(".", owner, last)).otherwise(F.col("call"))).withColumn("last", F.element_at(F.split(F.coalesce(F.try_element_at("imports", head), F.col("call")), r"\."), -1)).withColumn("imported", F.array_contains(F.map_keys("imports"), head))
    own = found.select(F.col("path").alias("p"), F.col("qualname").alias("q"), F.col("symbol_id").alias("own"))
    only = found.where("kind <> 'method'").groupBy("name").agg(F.count("*").alias("n"), F.first("symbol_id").alias("only")).where("n = 1")
    j = calls.join(own, (F.col("path") == F.col("p")) & (F.col("target") == F.col("q")), "left")
    j = j.withColumn("key", F.when(F.col("imported") & F.contains("call", F.lit(".")), last).otherwise(F.col("last"))).join(only, F.col("key") == F.col("name"), "left")
    return j.select("caller", F.coalesce("own", F.when(F.col("imported") | ~F.contains("call", F.lit(".")), F.col("only"))).alias("callee")).where("callee is not null and callee <> caller").distinct()


def search(found: DataFrame, queries: DataFrame, k: int = 4, graph: DataFrame | None = None) -> DataFrame:
    """query_id, symbol_id, score, rank: BM25 over path, names, docstring and source, 25 more for a symbol named in full and 5 for one named by its last part.

    With a call graph, symbols one call away from the query's best are ranked just behind it: .2 less, with a tenth of their own score.
    """
    text = found.select("symbol_id", "name", "qualname", F.concat_ws(" ", "path", "qualname", "name", "kind", "docstring", "source").alias("text"))
    s = L.bm25_scores(text, queries, doc="symbol_id").join(text.select("symbol_id", "name", "qualname"), "symbol_id").join(queries.withColumnRenamed("text", "query"), "query_id")
    word = lambda c: F.regexp_like(F.lower("query"), F.concat(F.lit(r"(^|[^a-z0-9_.])"), F.regexp_replace(F.lower(c), r"\.", r"\\."), F.lit(r"([^a-z0-9_]|$)")))
    s = s.select("query_id", "symbol_id", (F.col("score") + F.when(F.contains("qualname", F.lit(".")) & word("qualname"), 25.0).when(word("name"), 5.0).otherwise(0.0)).alias("score"))
    if graph is not None:
        best = L.top_k(s, 1, doc="symbol_id").select("query_id", F.col("symbol_id").alias("top"), F.col("score").alias("top_score"))
        near = graph.select(F.col("caller").alias("top"), F.col("callee").alias("symbol_id")).union(graph.select("callee", "caller")).distinct()
        extra = best.join(near, "top").join(s, ["query_id", "symbol_id"], "left").select("query_id", "symbol_id", (F.col("top_score") - 0.2 + 0.1 * F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0))).alias("score"))
        s = s.union(extra).groupBy("query_id", "symbol_id").agg(F.max("score").alias("score"))
    return L.top_k(s, k, doc="symbol_id")
