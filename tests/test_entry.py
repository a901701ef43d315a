"""The driver contract without the optional parts."""

import builtins
import sys

import __spark_entry__


def test_queries_without_a_library_of_the_optional_part(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name == "ahocorasick" or name.startswith("corpusloom.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    before = __spark_entry__.queries()
    for name in [n for n in sys.modules if n.startswith(("corpusloom.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    after = __spark_entry__.queries()
    assert "bm25_search" in after and not any(n.startswith("op") and n[2].isdigit() for n in after)
    assert set(after) <= set(before) and set(__spark_entry__.oracle_sql()) <= set(after)
