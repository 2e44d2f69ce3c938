"""The entry works without the training-data operators, whatever the reason why they can't be imported."""

import sys
import types

import pytest

import __spark_entry__ as entry


@pytest.fixture
def forgotten(monkeypatch):
    """As if nothing of the optional parts had been imported yet."""
    for name in [n for n in sys.modules if n.startswith("tidemark.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import tidemark

    monkeypatch.delattr(tidemark, "llm", raising=False)
    return monkeypatch


def core_only():
    names = set(entry.queries())
    assert len(names) > 90 and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= names and len(entry.oracle_sql()) > 80


def test_a_library_is_missing(forgotten):
    forgotten.setitem(sys.modules, "tiktoken", None)
    core_only()


def test_an_empty_folder_is_left(forgotten, tmp_path):
    package = types.ModuleType("tidemark.llm")
    package.__path__ = [str(tmp_path)]
    forgotten.setitem(sys.modules, "tidemark.llm", package)
    core_only()


def test_only_the_pipeline_is_missing(forgotten):
    pytest.importorskip("tidemark.llm.queries")
    forgotten.setitem(sys.modules, "corpus_pipeline", None)
    names = set(entry.queries())
    assert "pipeline" not in names and sum(n.startswith("op") for n in names) == 13
