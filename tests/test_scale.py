"""What a query plans for large tables: tasks by rows, broadcasts by measured size, lines and states that stay where they are."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fleetgrade.functions import scalars as S
from fleetgrade.operators import custom as UD
from fleetgrade.operators import hosts as H
from fleetgrade.operators import rule_table as RT
from fleetgrade.session import broadcast_by_measure
from fleetgrade.streaming import superseded as SU
from fleetgrade.workload.registry import dealt

LIMITS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture
def limits(spark):
    before = {name: spark.conf.get(name, None) for name in LIMITS}
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def plan(df, stage="executedPlan"):
    return getattr(df._jdf.queryExecution(), stage)().toString()


def test_entropy_names_the_characters_once(spark):
    text = "aab" * 7000
    df = spark.createDataFrame([(text,), ("",), (None,), ("abcdefghijklmnop" * 3,)], "t string").select(S.shannon_entropy(F.col("t")).alias("e"))
    want = -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3))
    assert [None if r.e is None else round(r.e, 9) for r in df.collect()] == [round(want, 9), 0.0, None, 4.0]
    assert plan(df, "analyzed").count("split(") == 2


def test_lines_stay_where_they_are(spark, limits):
    spark.conf.set(LIMITS[0], "-1")
    rules = spark.createDataFrame([("R-A", "alpha", False), ("R-B", "beta", False), ("R-C", "gamma", True)], "id string, pattern string, absent boolean")
    for name in UD.RULE_SCHEMA.replace("\n", " ").split(","):
        column, kind = name.split()[0], " ".join(name.split()[1:])
        if column not in rules.columns:
            rules = rules.withColumn(column, F.lit({"message": "m", "severity": "low", "category": "security", "language": "any"}.get(column)).cast(kind))
    lines = spark.createDataFrame([("a", 1, "alpha beta"), ("a", 2, "gamma"), ("b", 1, "beta"), (None, 1, "gamma")], "path string, line int, raw string")
    found = RT.custom_rules(lines, rules)
    got = sorted((r.path or "", r.rule, r.line) for r in found.select("path", "rule", "line").collect())
    assert got == [("", "R-C", 0), ("a", "R-A", 1), ("a", "R-B", 1), ("b", "R-B", 1), ("b", "R-C", 0)]
    assert "SortMergeJoin [i#" not in plan(found)


def test_states_travel_with_their_rows(spark):
    rows = spark.readStream.format("rate").load().selectExpr("cast(value as string) as path", "value as generation", "timestamp as modified")
    assert "FlatMapGroupsInPandasWithState" in plan(SU.drop_superseded_stream(rows), "analyzed")


def test_tasks_by_rows(spark, limits):
    rows = dealt(spark.range(100_000).coalesce(1), per_task=10_000)
    assert rows.rdd.getNumPartitions() == 10 and rows.count() == 100_000
    assert dealt(spark.range(3)).rdd.getNumPartitions() == 1 and dealt(spark.range(0)).count() == 0


def test_broadcasts_by_measure(spark, limits):
    spark.conf.set(LIMITS[0], "1m")
    small = spark.range(1000).select(F.col("id").cast("string").alias("path"))
    long = small.withColumn("content", F.repeat("path", 5000))
    assert "BroadcastHashJoin" in plan(small.join(long, "path"))
    broadcast_by_measure(spark)
    broadcast_by_measure(spark)
    assert spark.conf.get(LIMITS[1]) in ("1m", "1048576b") and "BroadcastHashJoin" not in plan(small.join(long, "path"))


def test_nodes_of_many_files(spark):
    assert H._BATCH
    files = spark.range(3000).coalesce(1).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("a: 1\nb: [x, y]\n").alias("content"))
    nodes = H.yaml_nodes(files)
    assert nodes.count() == 15_000 and nodes.select("path").distinct().count() == 3000
