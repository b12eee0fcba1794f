"""Every query against its DuckDB twin over the smallest tables."""

import pytest

import __spark_entry__
from conftest import twin
from leafwork.plans.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(name, spark, sf_dir):
    twin(QUERIES[name], ORACLE[name], spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["book_id", "key", "y", "margin", "first", "pages"]
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
