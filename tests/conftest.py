import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def twin(query, sql: str, spark, sf_dir: str) -> None:
    """Holds a query's rows against DuckDB's."""
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got, want = query(spark, sf_dir), con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = sorted(map(repr, ([_plain(r[c]) for c in columns] for r in got.collect())))
    twins = sorted(map(repr, ([_plain(r[i]) for i in order] for r in want.fetchall())))
    assert rows == twins


def _plain(x):
    import decimal

    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return float(f"{x:.10g}")
    return x
