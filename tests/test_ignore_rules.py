"""Ignore rules from a table agree with the list of patterns of one folder, folder by folder."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fleetgrade.sources import files as SC

PATTERNS = ("build/", "!build/keep", "*.txt", "!a.txt", "/top", "x/**/y", "**/z", "?.sh", "[ab]c", "[!ab]d", "a/b", "!a/b/c.sh", "# no", "", "\\!odd", "\\#hash", "lib.tar.gz", "*.gz", "a*/", "/a/*.sh", "x/", "deep/er/", "!*.sh", ".", "*")


def kept(spark, paths, rules):
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in SC.ignore_by_rules(files, spark.createDataFrame(rules, SC.IGNORE_SCHEMA)).collect()}


def test_equal_to_lists(spark):
    rnd = random.Random(11)
    names = ["a", "b", "c.sh", "a.txt", "b.txt", "build", "keep", "top", "x", "y", "z", "ac", "ed", "!odd", "#hash", "lib.tar.gz", "deep", "er", "o.gz"]
    folders = [f"repo{i}" for i in range(6)]
    paths = sorted({"/".join([rnd.choice(folders), *(rnd.choice(names) for _ in range(rnd.randint(1, 5)))]) for _ in range(400)})
    lists = {f: [rnd.choice(PATTERNS[:-1] if i else PATTERNS) for _ in range(rnd.randint(1, 8))] for i, f in enumerate(folders[:-1])}
    got = kept(spark, paths, [(f, i, p) for f, ps in lists.items() for i, p in enumerate(ps)])
    want = set()
    for f in folders:
        mine = spark.createDataFrame([(p.split("/", 1)[1],) for p in paths if p.startswith(f + "/")], "path string")
        want |= {f"{f}/{r.path}" for r in (SC.ignore_paths(mine, lists[f]) if f in lists else mine).collect()}
    assert got == want


def test_nested_folders_and_the_whole_tree(spark):
    paths = ["r/a.sh", "r/in/a.sh", "r/in/b.sh", "q/b.sh", "b.sh"]
    assert kept(spark, paths, [("", 1, "b.sh"), ("r/in", 1, "a.sh"), ("r/in", 2, "!b.sh")]) == {"r/a.sh"}


def test_last_line_wins_and_excluded_folders_stay_excluded(spark):
    assert kept(spark, ["r/a/x", "r/b/x"], [("r", 1, "x"), ("r", 2, "!x"), ("r", 3, "a/"), ("r", 4, "!a/x")]) == {"r/b/x"}


def test_defined_cases(spark):
    assert kept(spark, [], [("", 1, "a")]) == set() and kept(spark, ["a"], []) == {"a"}
    assert kept(spark, [None, "", "b", "b"], [("", 1, "a"), ("", 2, None)]) == {None, "", "b"}
    files = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "path string, folder int")
    rules = spark.createDataFrame([("", 1, "a")], SC.IGNORE_SCHEMA)
    assert [tuple(r) for r in SC.ignore_by_rules(files, rules).orderBy("path").collect()] == [("b", 2), ("b", 2)]


def test_no_pattern_in_the_plan(spark):
    files = spark.range(3).select(F.concat(F.lit("f"), "id").alias("path"))
    rules = spark.range(3).select(F.lit("").alias("folder"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("f"), "id").alias("pattern"))
    plan = SC.ignore_by_rules(files, rules)._jdf.queryExecution().toString()
    assert "f1" not in plan and "CartesianProduct" not in plan
