"""Every query that has SQL against DuckDB, at the smallest scale and shuffled into few or many partitions."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from sessionloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(map(tuple, df[sorted(df.columns)].apply(lambda c: c.map(text)).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_partitions_do_not_matter(spark, duck, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for name in ("flow_ngrams_top", "winning_path", "struggle_fix", "even_sample"):
            assert rows(registry.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df()), name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
