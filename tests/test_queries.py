"""Every registered query that has SQL against DuckDB, and the entry file's contract."""

import importlib
import os
import sys

import pytest
from latticore import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v != v:
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(cell(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, duck, sf, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) > 0
    if a != b:  # a rounded last digit may differ where sums ran in another order
        for x, y in zip(a, b):
            assert [u if not is_number(u) else pytest.approx(float(u), rel=1e-5, abs=2e-4) for u in x] == [v if not is_number(v) else float(v) for v in y]


def is_number(text):
    try:
        float(text)
    except ValueError:
        return False
    return True


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_folder(monkeypatch):
    """The entry file imports and offers the other queries where the corpus operators are gone."""
    import importlib.util as util

    import __spark_entry__

    real = util.find_spec
    for m in [m for m in sys.modules if m.startswith("latticore.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "latticore.llm", None)
    monkeypatch.setattr(util, "find_spec", lambda n, *a: None if n.startswith(("latticore.llm", "corpus_pipeline")) else real(n, *a))
    try:
        again = importlib.reload(__spark_entry__)
        assert set(again.queries()) == set(registry.QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_library_does_not_import_the_corpus_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(registry.__file__)))
    for d, _, names in os.walk(os.path.join(root, "latticore")):
        for n in names:
            if n.endswith(".py") and f"{os.sep}llm" not in d:
                with open(os.path.join(d, n)) as f:
                    assert "latticore.llm" not in f.read()
