import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        name = f.removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    k = sorted(a.columns)
    a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    same(registry.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(registry.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_batches_of_queries_are_bounded(spark, tmp_path):
    """Texts of 12 MB in one task come to Python in batches of about 2 MB, in a session without a bound of its own."""
    session = spark.newSession()
    session.range(0, 12000, 1, 1).selectExpr("id AS doc_id", "repeat('text', 256) AS text").write.parquet(f"{tmp_path}/documents.parquet")

    @F.pandas_udf("long")
    def held(text: pd.Series) -> pd.Series:
        return pd.Series([int(text.str.len().sum())] * len(text))

    sizes = registry.table(session, str(tmp_path), "documents").coalesce(1).select(held("text").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] < 3 << 20
