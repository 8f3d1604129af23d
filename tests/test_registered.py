"""Every registered query against its SQL on the given tables."""

import pytest

import __spark_entry__ as entry_points
from docloom.plans.registry import ORACLE as SQL
from docloom.plans.registry import QUERIES
from oracle_check import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result_as_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert compare(df, sf_dir, SQL[name]) is None


def test_entry_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["rank", "doc_id", "score", "file_name"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())
