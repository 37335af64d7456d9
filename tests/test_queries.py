"""Every query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from cadenza.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = rows(QUERIES[name](spark, sf).toPandas())
    assert got[1]
    if name in SQL:
        assert got == rows(duck.sql(SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, engine_dir, sf):
    from cadenza.engine import Engine
    from cadenza.streaming import lines

    engine = Engine(spark)
    schema = spark.read.parquet(f"{sf}/conversations.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{engine_dir}/in")
    got = []
    q = lines.scan_stream(stream, engine, ["conv_id", "turn"], lambda df, epoch: got.extend(df.collect()), f"{engine_dir}/checkpoint")
    q.awaitTermination(120)
    want = engine.scan(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    assert sorted((r.conv_id, r.turn, r.bits) for r in got) == sorted((r.conv_id, r.turn, r.bits) for r in want.collect())


@pytest.fixture
def engine_dir(tmp_path, sf):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.parquet").symlink_to(f"{sf}/conversations.parquet")
    return tmp_path
