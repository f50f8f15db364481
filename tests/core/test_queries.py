"""Queries against their SQL on the smallest tables, all in one DuckDB session."""

import os

import duckdb
import pytest

from quillmark import catalog

@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in os.listdir(small):
        c.execute(f"create view {t[:-8]} as select * from '{small}/{t}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    whole = lambda v: int(v) if float(v).is_integer() else round(float(v), 6)  # noqa: E731  integers of a column with nulls come as floats
    plain = lambda v: whole(v) if isinstance(v, float) or hasattr(v, "item") and not isinstance(v, bool) else v
    return sorted(repr([plain(v) for v in r]) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, small, con, name):
    got, want = catalog.queries()[name](spark, small).toPandas(), con.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_without_the_optional_part_its_queries_are_left_out(monkeypatch):
    """Also where the part is there but can't be imported."""
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m == "quillmark.llm" or m.startswith("quillmark.llm.")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    monkeypatch.setitem(sys.modules, "quillmark.llm", None)
    alone = importlib.reload(__spark_entry__)
    assert set(alone.queries()) == set(catalog.queries()) and set(alone.oracle_sql()) == set(catalog.oracle_sql())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and len(catalog.queries()) > 100


def test_library_imports_nothing_of_the_optional_part():
    from pathlib import Path

    root = Path(catalog.__file__).parent
    files = [f for f in root.rglob("*.py") if root / "llm" not in f.parents]
    assert files and not any("quillmark.llm" in f.read_text() or "corpus_pipeline" in f.read_text() for f in files)
