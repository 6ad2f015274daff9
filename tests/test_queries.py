import pytest
from conftest import SF
from oracle import duck_rows, rows

from weftline.plans.oracles import ORACLES
from weftline.plans.queries import QUERIES


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    assert rows(QUERIES[name](spark, SF)) == duck_rows(SF, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("lacking", [("weftline.llm", "corpus_pipeline"), ("zstandard",)])
def test_queries_without_the_training_data_package(monkeypatch, lacking):
    import builtins
    import sys

    import __spark_entry__

    real = builtins.__import__

    def block(name, *a, **k):
        if name.startswith(lacking):
            raise ModuleNotFoundError(name=name)
        return real(name, *a, **k)

    for m in [m for m in sys.modules if m.startswith(("weftline.llm", "corpus_pipeline", "zstandard"))]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", block)
    assert set(__spark_entry__.queries()) == set(QUERIES)
