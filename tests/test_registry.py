import importlib
import sys

import pytest

from loregraph.plans import registry


@pytest.mark.parametrize("gone", ["corpus_pipeline", "loregraph.llm", "loregraph.llm.common"])
def test_entry_without_the_optional_part(monkeypatch, gone):
    """The entry file works if the pipeline, the subpackage or a part of it is not there."""
    for name in [m for m in sys.modules if m.startswith("loregraph.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(registry.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_names():
    assert registry.FLAGSHIP in registry.QUERIES and set(registry.SQL) == set(registry.QUERIES)
