import os

import duckdb
import pytest

import __spark_entry__ as entry
from geoweft import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(df):
    """Rows as sorted text, columns in order of name; both sides come as pandas frames."""
    rows = df[sorted(df.columns)].astype(object).values.tolist()
    return sorted(repr([None if x is None or x != x else x for x in row]) for row in rows)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, sf_dir, duck, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() == 8 * 500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, sf_dir, tmp_path):
    from geoweft.sources import tables
    from geoweft.streaming.neighbors import knn_stream

    asked = tables.points(spark, sf_dir, first=3, key="qid")
    asked.limit(20).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    knn_stream(tables.points(spark, sf_dir), stream, 4, lambda df, _: got.append(df.count())).trigger(availableNow=True).start().awaitTermination()
    assert sum(got) == 80
