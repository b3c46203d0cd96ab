import builtins
import sys

import __spark_entry__ as entry
from rowloom.plans import registry


def test_core_queries_stay_without_the_subpackage(monkeypatch):
    real = builtins.__import__

    def no_tokenizers(name, *rest, **more):
        if name.split(".")[0] in ("public_tokenizers", "corpus_pipeline"):
            raise ModuleNotFoundError(name)
        return real(name, *rest, **more)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("rowloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", no_tokenizers)
    assert entry.queries() == registry.QUERIES and entry.oracle_sql() == registry.ORACLE_SQL


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
