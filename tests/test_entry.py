"""The driver's contract, with and without the optional subpackage."""

import importlib
import sys

import __spark_entry__ as entry
from docloom.plans import catalog


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_library_stands_alone(monkeypatch):
    for name in ("corpus_pipeline", "docloom.llm", "docloom.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    fresh = importlib.reload(entry)
    assert set(fresh.queries()) == set(catalog.QUERIES)
    assert set(fresh.oracle_sql()) == set(catalog.ORACLE_SQL)
    monkeypatch.undo()
    importlib.reload(entry)


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
