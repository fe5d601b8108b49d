"""Every query of the library against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from skein.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def show(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.7g}"
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(show, r)) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(con.execute(ORACLE_SQL[name]).fetchdf())


def test_entry_without_the_corpus_operators(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as e

    real = builtins.__import__
    for m in [m for m in sys.modules if m.startswith("skein.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)

    def gone(name, *a, **k):
        if name.startswith("skein.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLE_SQL)


def test_entry_doesnt_hide_other_missing_modules(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as e

    real = builtins.__import__
    monkeypatch.delitem(sys.modules, "corpus_pipeline", raising=False)

    def gone(name, *a, **k):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'regex'", name="regex")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    with pytest.raises(ImportError):
        e.queries()
