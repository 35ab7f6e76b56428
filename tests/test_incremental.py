"""A store of results under random changes against a full count."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.streaming.incremental import RULE, ResultStore, folder_table, rule_table

RULES = ("R1", "R2", "R3")


def facts(files):
    """Facts that depend on the content alone: three rules, counts from a checksum."""
    n = F.crc32("content")
    rules = F.array(*[
        F.struct(F.lit("t").alias("tool"), F.lit(r).alias("rule"), *[F.when((n % 7 + i) % 4 == j, n % 3 + 1).otherwise(0).cast("bigint").alias(s) for j, s in enumerate(dims.SEVERITIES)])
        for i, r in enumerate(RULES)])
    rules = F.slice(rules, 1, (n % 4).cast("int")).cast(f"array<{RULE}>")
    return files.select(
        "path", F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), F.when(n % 2 == 0, "python").otherwise("bash").alias("dialect"),
        (n % 101).cast("bigint").alias("tenths"), F.element_at(F.split(F.lit("A B C D E"), " "), (n % 5 + 1).cast("int")).alias("grade"), rules.alias("rules"))


def whole(state):
    """Folder and rule tables by plain counting."""
    folders, rules = {}, {}
    for path, content in state.items():
        n = zlib.crc32(content.encode())
        found = [(r, [(n % 3 + 1) if (n % 7 + i) % 4 == j else 0 for j in range(4)]) for i, r in enumerate(RULES)][:n % 4]
        f = folders.setdefault(path.split("/")[0], {"files": 0, "python": 0, "tenths": 0, "grades": [0] * 5, "found": [0] * 4})
        f["files"] += 1
        f["python"] += n % 2 == 0
        f["tenths"] += n % 101
        f["grades"][n % 5] += 1
        for r, counts in found:
            rules.setdefault(r, []).append(counts)
            f["found"] = [a + b for a, b in zip(f["found"], counts, strict=True)]
    return folders, rules


def agree(store, state):
    folders, rules = whole(state)
    got = {r.folder: r for r in folder_table(store.view("folders")).collect()}
    assert set(got) == set(folders)
    for name, f in folders.items():
        r = got[name]
        assert (r.files, r.python_files, r.shell_files) == (f["files"], f["python"], f["files"] - f["python"])
        assert abs(r.average - f["tenths"] / 10 / f["files"]) <= 0.05 + 1e-6
        assert [r[f"grade_{g}"] for g in "abcde"] == f["grades"] and [r[s] for s in dims.SEVERITIES] == f["found"]
    told = {r.rule: (r.occurrences, r.affected, r.severity) for r in rule_table(store.view("rules")).collect()}
    assert told == {k: (sum(map(sum, v)), len(v), next((s for j, s in enumerate(dims.SEVERITIES) if any(c[j] for c in v)), None)) for k, v in rules.items()}
    assert {r.path for r in store.facts().select("path").collect()} == set(state)


def test_refreshes_equal_full_counts(spark, tmp_path):
    rng, store, state = random.Random(4), ResultStore(spark, str(tmp_path), buckets=16), {}
    for step in range(4):
        before = dict(state)
        for _ in range(60 if step == 0 else 5):
            state[f"f{rng.randrange(4)}/{rng.randrange(400)}.sh"] = f"text {rng.random()}"
        for path in rng.sample(sorted(before), 3 if before else 0):
            state.pop(path, None)
        done = store.refresh(spark.createDataFrame(list(state.items()), "path string, content string"), facts)
        assert done.analysed == sum(before.get(p) != c for p, c in state.items()) and done.removed == len(before.keys() - state.keys())
        assert done.version == step
        agree(store, state)
        if step:
            places = store.places()
            assert {b for b, v in places.items() if v == step} <= set(done.buckets) and len(set(places.values())) > 1
    unchanged = store.refresh(spark.createDataFrame(list(state.items()), "path string, content string"), facts)
    assert (unchanged.analysed, unchanged.removed, unchanged.buckets) == (0, 0, ())
    assert store.refresh(spark.createDataFrame(list(state.items()), "path string, content string"), facts, config="other").analysed == len(state)
    assert store.vacuum(keep=1) > 0
    agree(store, state)
    store.refresh(spark.createDataFrame([], "path string, content string"), facts)
    assert store.view("folders").count() == store.view("rules").count() == store.facts().count() == 0


def test_a_refresh_that_dies_leaves_the_version_before(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path), buckets=4)
    state = {"a/1.sh": "x", "b/2.sh": "y"}
    store.refresh(spark.createDataFrame(list(state.items()), "path string, content string"), facts)
    spark.createDataFrame([("junk",)], "path string").write.parquet(f"{tmp_path}/facts/version=1/bucket=0")
    agree(store, state)
    state["a/1.sh"] = "z"
    store.refresh(spark.createDataFrame(list(state.items()), "path string, content string"), facts)
    agree(store, state)


def test_stream_of_changes(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"), buckets=4)
    schema = "path string, content string, state string, modified bigint"

    def send(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        store.follow(stream, facts, str(tmp_path / "progress")).awaitTermination()

    send([("a/1.sh", "x", "A", 1), ("a/2.sh", "y", "A", 1), ("a/1.sh", "z", "M", 2)])
    agree(store, {"a/1.sh": "z", "a/2.sh": "y"})
    send([("a/2.sh", None, "D", 3), ("b/3.sh", "w", "A", 3), ("b/9.sh", None, "D", 3)])
    agree(store, {"a/1.sh": "z", "b/3.sh": "w"})
    now = store.version()
    send([("b/3.sh", "w", "M", 4)])
    assert store.version() == now
