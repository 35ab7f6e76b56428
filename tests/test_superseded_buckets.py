"""States of a stream by buckets of paths: few calls and states, and each path as if it were alone."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetgrade.streaming import superseded as SU

SCHEMA = "path string, generation bigint, modified timestamp, size bigint"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, SU.ROCKS)
    yield
    spark.conf.set(name, before)


def run(spark, tmp_path, rows, schema=SCHEMA, **how):
    df = rows if hasattr(rows, "write") else spark.createDataFrame([(p, g, START + dt.timedelta(minutes=m), s) for p, g, m, s in rows], schema)
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = SU.drop_superseded_stream(stream, keep="60 minutes", delay="10 minutes", **how)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(str(tmp_path / "out")), query.recentProgress[-1].stateOperators[0].numRowsTotal


def test_many_paths_are_few_states(spark, tmp_path, rocks):
    paths = spark.range(20_000).select(F.col("id").cast("string").alias("path"), F.explode(F.array(F.col("id") % 3, F.lit(2).cast("bigint"))).alias("generation"), F.lit(START).alias("modified"), F.col("id").alias("size"))
    got, states = run(spark, tmp_path, paths)
    assert states <= SU.BUCKETS < 20_000
    assert got.count() == paths.filter("generation = 2").count() and got.filter("generation <> 2").isEmpty()


def test_paths_of_a_bucket_go_one_by_one(spark, tmp_path, rocks):
    run(spark, tmp_path, [("old", 5, 0, 1), ("young", 5, 55, 1), ("other", 5, 55, 1)], buckets=1)
    run(spark, tmp_path, [("new", 1, 80, 2)], buckets=1)
    # The watermark has passed the hour of "old" only: it begins anew, "young" is still known.
    run(spark, tmp_path, [("new", 1, 81, 3), ("young", 4, 80, 3)], buckets=1)
    got, states = run(spark, tmp_path, [("old", 1, 82, 4), ("young", 4, 82, 4), ("young", 6, 82, 4), ("new", 0, 82, 4)], buckets=1)
    assert states == 1
    assert sorted((r.path, r.generation, r["size"]) for r in got.collect()) == [("new", 1, 2), ("new", 1, 3), ("old", 1, 4), ("old", 5, 1), ("other", 5, 1), ("young", 5, 1), ("young", 6, 4)]
    _, states = run(spark, tmp_path, [("last", 0, 900, 5)], buckets=1)
    got, states = run(spark, tmp_path, [("other", 0, 901, 6)], buckets=1)
    assert states == 1 and got.filter("path = 'other' and generation = 0").count() == 1


def test_numbers_beside_nulls_and_keys_of_other_types(spark, tmp_path, rocks):
    big = (1 << 60) + 1
    schema = SCHEMA.replace("path string", "path bigint")
    got, _ = run(spark, tmp_path, [(big, 1, 0, big), (big + 1, 0, 0, None), (None, 3, 0, 7), (None, 2, 0, 8), (big, 0, 0, 9)], schema, buckets=1)
    assert sorted(got.select("path", "size").collect(), key=str) == sorted([(big, big), (big + 1, None), (None, 7)], key=str)
