"""The entry works with and without the training-data subpackage."""

import sys

import __spark_entry__ as entry


def test_queries_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tracewarden.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "tracewarden.llm", None)
    names, oracles = entry.queries(), entry.oracle_sql()
    assert "win02_rate_limit" in names and "pipeline" not in names
    assert not [n for n in (*names, *oracles) if n.startswith("op")]


def test_every_oracle_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
