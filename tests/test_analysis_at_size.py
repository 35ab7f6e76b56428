"""The analysis at size: rows that stay where they are, settings that travel in part, files that are left out of a step."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetgrade.operators import findings as FD
from fleetgrade.operators import fixes as FX
from fleetgrade.operators import lines as LN
from fleetgrade.session import cut, gathered, parted_by_file, sorted_shuffles
from fleetgrade.settings import only, settings_of

LIMIT, FIRST, CO = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.requireAllClusterKeysForCoPartition"


@pytest.fixture
def shuffled(spark):
    before = {name: spark.conf.get(name, None) for name in (LIMIT, FIRST, "spark.sql.shuffle.partitions")}
    spark.conf.set(LIMIT, "-1")
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def found(spark, rows):
    df = spark.createDataFrame(rows, "path string, tool string, rule string, line int, position bigint, edits array<struct<line:int,column:int,end_line:int,end_column:int,replacement:string,rule:string>>")
    return FD.complete(df.withColumns({"category": F.lit("security"), "severity": F.lit("low")}))


ROWS = [("a", "builtin", "SEC002", 1, 1, []), ("a", "builtin", "MNT010", 2, 2, []), ("a", "builtin", "MNT010", 3, 3, []), ("a", "ruff", "E1", 2, 4, [(1, 1, 2, 1, "x", "E1")]),
        ("b", "builtin", "POR001", 0, 5, []), ("b", "builtin", "MNT010", 9, 6, []), (None, "builtin", "MNT010", 1, 7, [])]
LINES = [("a", 1, "key=1 "), ("a", 2, "echo  x "), ("a", 3, "echo x"), ("b", 1, "y"), ("a", 3, "echo x")]


def sorted_rows(df):
    names = sorted(df.columns)
    return sorted(map(str, df.select(*names).collect()))


@pytest.mark.parametrize("many", [[], ["a"], ["b", "c"]])
def test_one_join_gives_what_two_steps_give(spark, shuffled, many):
    findings, lines = found(spark, ROWS), spark.createDataFrame(LINES, "path string, line int, raw string")
    large = spark.createDataFrame([(m,) for m in many], "path string")
    want = FD.attach_source(FD.fingerprint(findings, lines), lines, findings)
    got = FD.print_and_show(findings, lines, findings, large)
    assert sorted_rows(got) == sorted_rows(want)


def test_findings_are_numbered_where_they_lie(spark, shuffled):
    findings, lines = found(spark, ROWS), spark.createDataFrame(LINES, "path string, line int, raw string")
    with parted_by_file(spark):
        df = FD.print_and_show(findings.repartition("path"), lines, findings.limit(0), findings.limit(0).select("path"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        before = FD.attach_source(FD.fingerprint(findings.repartition("path"), lines), lines, findings.limit(0))._jdf.queryExecution().executedPlan().toString()
    assert "_texts" in plan and plan.count("Exchange hashpartitioning") < before.count("Exchange hashpartitioning")
    assert spark.conf.get(CO) == "true"


def test_lines_at_places(spark):
    files = spark.createDataFrame([("a", "x\ny\r\nz\n"), ("b", ""), ("c", "one"), ("a", "x\ntwice"), ("d", None), (None, "n")], "path string, content string")
    places = spark.createDataFrame([("a", 2), ("a", 2), ("a", 0), ("a", 3), ("a", 9), ("b", 1), ("c", 1), ("d", 1), (None, 1)], "path string, line int")
    want = LN.to_lines(files).join(places.distinct(), ["path", "line"], "left_semi")
    got = LN.lines_at(files, places)
    assert got.dtypes == want.dtypes and sorted_rows(got) == sorted_rows(want)
    assert sorted_rows(got) == sorted(map(str, spark.createDataFrame([("a", 2, "y"), ("a", 3, "z"), ("a", 2, "twice"), ("c", 1, "one")], "path string, line int, raw string").select("line", "path", "raw").collect()))


def test_texts_that_can_hold_directives(spark):
    texts = ["x # fleetgrade disable=SEC001", "#  FLEETGRADE  disable-file = *", "a\n# fleetgrade disable-next-line=SEC002\nb", "x = 1 # NoQA", "y()  #nosec B101", "# fleetgrade", "plain", "# noqas", "x # noqa\r\ny"]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string")
    every = FD.parse_directives(LN.to_lines(files), files.select("path"))
    some = FD.parse_directives(LN.to_lines(files.filter(FD.may_direct(F.col("content")))), files.select("path"))
    assert sorted_rows(every) == sorted_rows(some) and every.count() == 6
    assert files.filter(FD.may_direct(F.col("content"))).count() == 6


def test_pairs_of_two_tools_only(spark):
    slim = spark.createDataFrame([("a", "x", "R1", 1, 1, ["R2"], 1, 1, False), ("a", "y", "R2", 1, 1, [], 2, 2, False), ("b", "x", "R1", 1, 1, ["R2"], 3, 3, False), ("b", "x", "R2", 1, 1, [], 4, 4, False)],
                                 "path string, tool string, rule string, line int, last int, eqs array<string>, id bigint, cls bigint, wide boolean")
    edges = FD._cross_tool_edges(slim)
    assert [tuple(r) for r in edges.collect()] == [(1, 2)]


def test_fixes_meet_fixable_findings_only(spark, shuffled):
    lines = LN.mask_lines(spark.createDataFrame([("a", "echo x  \necho y\n", "bash")], "path string, content string, dialect string"))
    rows = found(spark, [("a", "builtin", "MNT010", 1, 1, []), ("a", "builtin", "SEC001", 1, 2, []), ("a", "builtin", "MNT010", 2, 3, []), ("a", "ruff", "E1", 1, 4, [(1, 1, 1, 2, "z", "E1")])])
    rows = cut(rows.withColumn("snippet", F.lit("s")))
    split = FX.attach_fixes(rows.filter(FX.has_fix()), lines).unionByName(rows.filter(~FX.has_fix()))
    assert sorted_rows(split) == sorted_rows(FX.attach_fixes(rows, lines)) and rows.filter(FX.has_fix()).count() == 2
    got = {r.position: [e.replacement for e in r.edits] for r in split.collect()}
    assert got == {1: ["echo x"], 2: [], 3: [], 4: ["z"]}


def test_settings_travel_in_part(spark):
    settings = settings_of(spark.createDataFrame([("r/a",)], "path string"))
    assert only(settings, "max_line", "contexts").schema["s"].dataType.fieldNames() == ["max_line", "contexts"]


def test_unions_have_the_tasks_of_their_files(spark):
    part = cut(spark.range(0, 40, 1, 4))
    many = part.unionByName(part).unionByName(part)
    assert many.rdd.getNumPartitions() == 12
    got = gathered(many, part)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 120


def test_shuffles_write_one_file_a_task(spark, shuffled):
    sorted_shuffles(spark)
    assert spark.conf.get(FIRST, None) is None
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    sorted_shuffles(spark)
    assert int(spark.conf.get(FIRST)) > 200
