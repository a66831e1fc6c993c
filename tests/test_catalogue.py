"""Every query of the reference inventory against its SQL; those without SQL return rows."""

import pytest

from helper import same_rows
from folioframe.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck, data):
    df = catalogue.QUERIES[name](spark, data)
    if name in catalogue.ORACLES:
        same_rows(df, duck.sql(catalogue.ORACLES[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["parent", "missing", "lo", "hi"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_llm():
    from helper import ROOT

    for p in (ROOT / "folioframe").rglob("*.py"):
        if "llm" not in p.parts:
            assert "folioframe.llm" not in p.read_text(), p
