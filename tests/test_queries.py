import pytest

import __spark_entry__ as entry
from charta.plans import queries as plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, same):
    same(plans.queries()[name], SQL[name])


def test_entry_gives_cited_passages(spark):
    out = entry.entry(spark)
    assert out.columns == ["source", "doc_id", "line_no", "score", "snippet"]
    assert 0 < out.count() <= 10


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.queries()) <= set(entry.queries())
