import importlib

import __spark_entry__


def test_queries_and_sql_have_matching_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {"hybrid_rrf", "standings", "segment_summary"} <= queries.keys() and sql.keys() <= queries.keys()


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["q_id", "doc_id", "score", "rank"] and df.count() > 0


def test_core_queries_without_the_corpus_operators(monkeypatch):
    """A missing library or a missing subpackage costs its queries only."""
    real = importlib.import_module

    def missing(name, *a):
        if name.startswith(("braidwork.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", missing)
    queries = __spark_entry__.queries()
    assert "standings" in queries and not any(q.startswith("op") or q == "pipeline" for q in queries)
    assert __spark_entry__.oracle_sql().keys() <= queries.keys()
