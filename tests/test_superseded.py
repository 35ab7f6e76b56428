"""Keyed state of a stream of results: micro-batches out of order, a restart, expiry."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from fleetgrade.streaming import superseded as SU
from fleetgrade.streaming.watch import drop_superseded

SCHEMA = "path string, generation bigint, modified timestamp, result string"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, SU.ROCKS)
    yield
    spark.conf.set(name, before)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run(spark, tmp_path, rows, keep="60 minutes", delay="10 minutes"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = SU.drop_superseded_stream(stream, keep=keep, delay=delay)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    state = [s.numRowsTotal for p in query.recentProgress[-1:] for s in p.stateOperators]
    got = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out"))
    return got, (state[-1] if state else None)


def test_out_of_order_batches_and_restarts_equal_the_batch(spark, tmp_path, rocks):
    rng, every, seen = random.Random(2), [], {}
    for batch in range(3):
        rows = [(f"f{rng.randrange(6)}", rng.randrange(9), at(rng.uniform(0, 5)), f"{batch}-{i}") for i in range(12)]
        got, _ = run(spark, tmp_path, rows)
        best = {p: max([seen.get(p, -1), *(g for q, g, *_ in rows if q == p)]) for p in {r[0] for r in rows}}
        every += [(r, r[1] == best[r[0]]) for r in rows]
        seen |= best
    passed = sorted(r.result for r in got.collect())
    assert passed == sorted(r[3] for r, keep in every if keep)
    batch = drop_superseded(spark.createDataFrame([r for r, _ in every], SCHEMA))
    assert sorted(map(tuple, drop_superseded(got).select("path", "generation", "result").collect())) == sorted(map(tuple, batch.select("path", "generation", "result").collect()))


def test_state_goes_after_its_time(spark, tmp_path, rocks):
    _, many = run(spark, tmp_path, [(f"old{i}", 5, at(0), f"o{i}") for i in range(20)])
    run(spark, tmp_path, [("new", 1, at(500), "n1")])
    _, few = run(spark, tmp_path, [("new", 2, at(501), "n2")])
    got, left = run(spark, tmp_path, [("new", 1, at(502), "late"), ("old1", 9, at(1), "behind the watermark")])
    assert many and few is not None and left is not None and left < many
    assert {r.result for r in got.collect()} == {f"o{i}" for i in range(20)} | {"n1", "n2"}


def test_rows_without_generation_or_time(spark, tmp_path, rocks):
    got, _ = run(spark, tmp_path, [("a", None, at(0), "x"), ("a", 1, None, "y"), (None, 1, at(0), "z"), ("a", 1, at(0), "w")])
    assert sorted(r.result for r in got.collect()) == ["w", "z"]
