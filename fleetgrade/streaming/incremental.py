"""Results of a fleet kept current by signed changes.

A store holds one row of facts per file, in buckets of the path. A refresh analyses the files that changed, reads the buckets they
lie in, and writes those buckets anew under the next version; a manifest says in which version each bucket lies and is
written last, so a refresh that dies leaves the version before it whole. Every aggregate is a sum over facts: the facts of the old
version count with minus one, those of the new with plus one, and the sums of the signed rows are added to the
stored ones. What a refresh reads, analyses and writes follows the change, not the fleet.

Maxima do not add up, so the worst severity of a rule is stored as four counts, and a mean as a sum of tenths and a number of files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.functions import scalars as S
from fleetgrade.session import cut

RULE = "struct<tool:string,rule:string,critical:bigint,high:bigint,medium:bigint,low:bigint>"
FACTS = f"path string, key string, folder string, dialect string, tenths bigint, grade string, rules array<{RULE}>"
COLUMNS = ("path", "key", "folder", "dialect", "tenths", "grade", "rules")
GRADES = "ABCDE"
ALIVE = {"folders": "files", "rules": "affected"}


def facts_of(files: DataFrame, findings: DataFrame, scores: DataFrame, folder: Column) -> DataFrame:
    """Facts without their key, from ``files(path, dialect)``, findings and scores; files without findings have no rules."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES]
    by_rule = findings.groupBy("path", "tool", "rule").agg(*counts)
    rules = by_rule.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("tool", "rule", *dims.SEVERITIES))).alias("rules"))
    out = files.select("path", folder.alias("folder"), "dialect").join(scores.select("path", "global", "grade"), "path").join(rules, "path", "left")
    return out.select("path", "folder", "dialect", F.round(F.col("global") * 10).cast("bigint").alias("tenths"), "grade", F.coalesce("rules", F.array()).cast(f"array<{RULE}>").alias("rules"))


def folder_sums(signed: DataFrame) -> DataFrame:
    """Signed sums per folder: files, kinds, tenths, grades, findings by severity."""
    one = lambda when, name: F.sum(F.when(when, F.col("sign")).otherwise(0)).alias(name)
    found = [F.sum(F.col("sign") * F.aggregate(F.col(f"rules.{s}"), F.lit(0).cast("bigint"), lambda a, n: a + n)).alias(s) for s in dims.SEVERITIES]
    return signed.groupBy("folder").agg(
        F.sum("sign").alias("files"), one(F.col("dialect") == "python", "python_files"), F.sum(F.col("sign") * F.col("tenths")).alias("tenths"),
        *[one(F.col("grade") == g, f"grade_{g.lower()}") for g in GRADES], *found)


def rule_sums(signed: DataFrame) -> DataFrame:
    """Signed sums per rule: files affected, findings by severity."""
    each = signed.select("sign", F.explode("rules").alias("r"))
    return each.groupBy("r.tool", "r.rule").agg(F.sum("sign").alias("affected"), *[F.sum(F.col("sign") * F.col(f"r.{s}")).alias(s) for s in dims.SEVERITIES])


VIEWS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {"folders": (("folder",), folder_sums), "rules": (("tool", "rule"), rule_sums)}


def added(stored: DataFrame | None, change: DataFrame, keys: tuple[str, ...], alive: str) -> DataFrame:
    """Stored sums plus the change; a group that nothing is left of disappears."""
    both = change if stored is None else stored.unionByName(change)
    rest = [c for c in change.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rest]).filter(F.col(alive) != 0)


def folder_table(sums: DataFrame) -> DataFrame:
    """The folder summary of the sums: the same columns as :func:`fleetgrade.operators.scoring.folder_summary`."""
    return sums.select(
        "folder", "files", "python_files", (F.col("files") - F.col("python_files")).alias("shell_files"),
        S.round1(F.round(F.col("tenths") / 10 / F.col("files"), 6)).alias("average"), *[f"grade_{g.lower()}" for g in GRADES], *dims.SEVERITIES)


def rule_table(sums: DataFrame) -> DataFrame:
    """Occurrences, files affected and worst severity of each rule."""
    worst = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in dims.SEVERITIES])
    total = sum((F.col(s) for s in dims.SEVERITIES[1:]), F.col(dims.SEVERITIES[0]))
    return sums.select("tool", "rule", total.alias("occurrences"), "affected", worst.alias("severity"))


@dataclass(frozen=True)
class Refreshed:
    version: int
    analysed: int
    removed: int
    buckets: tuple[int, ...]


class ResultStore:
    """Facts in buckets and views of their sums, by version, under one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 1024):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _names(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def version(self) -> int:
        """Number of the latest whole version; -1 for an empty store."""
        done = [int(n.split("=")[1]) for n in self._names(f"{self.root}/manifest") if n.startswith("version=") and "_SUCCESS" in self._names(f"{self.root}/manifest/{n}")]
        return max(done, default=-1)

    def places(self) -> dict[int, int]:
        """Bucket to the version in which it lies: as many entries as buckets at most."""
        now = self.version()
        return {} if now < 0 else {r.bucket: r.written for r in self.spark.read.parquet(f"{self.root}/manifest/version={now}").collect()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int")

    def facts(self, buckets: list[int] | None = None) -> DataFrame:
        """The facts, of some buckets only if told; other buckets are not read."""
        found = [f"{self.root}/facts/version={v}/bucket={b}" for b, v in sorted(self.places().items()) if buckets is None or b in set(buckets)]
        if not found:
            return self.spark.createDataFrame([], FACTS)
        return self.spark.read.schema(FACTS).parquet(*found).select(*COLUMNS)

    def view(self, name: str) -> DataFrame | None:
        now = self.version()
        return None if now < 0 else self.spark.read.parquet(f"{self.root}/views/version={now}/{name}")

    def apply(self, todo: DataFrame, touched: DataFrame, analyze: Callable[[DataFrame], DataFrame]) -> Refreshed:
        """Analyse ``todo(path, content, key)``; ``touched(path)`` also names the files that are gone.

        ``analyze`` gives the facts of the files it is handed, without the key.
        """
        touched = cut(touched.select("path").distinct())
        buckets = [r[0] for r in touched.select(self.bucket()).distinct().collect()]
        places, number = self.places(), self.version() + 1
        fresh = cut(analyze(todo.drop("key")).join(todo.select("path", "key"), "path").select(*COLUMNS))
        stored = self.facts(buckets)
        old = cut(stored.join(touched, "path", "left_semi"))
        signed = old.withColumn("sign", F.lit(-1).cast("bigint")).unionByName(fresh.withColumn("sign", F.lit(1).cast("bigint")))
        for name, (keys, sums) in VIEWS.items():
            added(self.view(name), sums(signed), keys, ALIVE[name]).write.mode("overwrite").parquet(f"{self.root}/views/version={number}/{name}")
        rest = stored.join(touched, "path", "left_anti").unionByName(fresh)
        rest = rest.withColumn("bucket", self.bucket()).repartition("bucket")
        rest.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/facts/version={number}")
        written = [int(n.split("=")[1]) for n in self._names(f"{self.root}/facts/version={number}") if n.startswith("bucket=")]
        kept = {b: v for b, v in places.items() if b not in set(buckets)} | dict.fromkeys(written, number)
        rows = self.spark.createDataFrame(list(kept.items()), "bucket int, written int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={number}")
        analysed = fresh.count()
        return Refreshed(number, analysed, touched.count() - analysed, tuple(sorted(buckets)))

    def refresh(self, files: DataFrame, analyze: Callable[[DataFrame], DataFrame], config: str = "") -> Refreshed:
        """Bring the store to ``files(path, content)``: only files whose content or ``config`` differs are analysed, missing ones go.

        Paths and hashes are compared; the contents of unchanged files are read for their hash and not moved.
        """
        keyed = files.select("path", "content", F.sha2(F.concat_ws("\u0000", F.lit(config), F.sha2("content", 256)), 256).alias("key"))
        known = self.facts().select("path", F.col("key").alias("known"))
        both = keyed.select("path", "key").join(known, "path", "full_outer").filter(~F.col("key").eqNullSafe(F.col("known")))
        touched = cut(both.select("path", F.col("key").isNull().alias("gone")))
        todo = cut(keyed.join(touched.filter("not gone"), "path", "left_semi"))
        return self.apply(todo, touched, analyze)

    def follow(self, changes: DataFrame, analyze: Callable[[DataFrame], DataFrame], checkpoint: str, config: str = "", **trigger):
        """Apply a stream of ``changes(path, content, state, modified)``: the newest of each path in a batch counts, state D removes it.

        A batch that runs again finds equal keys and changes nothing.
        """

        def merge(batch: DataFrame, _: int) -> None:
            last = batch.groupBy("path").agg(F.max_by(F.struct("content", "state"), "modified").alias("v")).select("path", "v.*")
            last = cut(last.withColumn("key", F.sha2(F.concat_ws("\u0000", F.lit(config), F.sha2("content", 256)), 256)))
            buckets = [r[0] for r in last.select(self.bucket()).distinct().collect()]
            known = self.facts(buckets).select("path", F.col("key").alias("known"))
            met = last.join(known, "path", "left")
            gone = met.filter("state = 'D' and known is not null")
            todo = cut(met.filter("state <> 'D'").filter(~F.col("key").eqNullSafe(F.col("known"))).select("path", "content", "key"))
            touched = cut(todo.select("path").unionByName(gone.select("path")))
            if not touched.isEmpty():
                self.apply(todo, touched, analyze)

        return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def vacuum(self, keep: int = 2) -> int:
        """Drop versions that the newest ``keep`` manifests do not name; the number of folders dropped."""
        numbers = sorted(int(n.split("=")[1]) for n in self._names(f"{self.root}/manifest") if n.startswith("version="))
        recent, used = numbers[-keep:] if keep else [], set()
        for n in recent:
            used |= {r.written for r in self.spark.read.parquet(f"{self.root}/manifest/version={n}").collect()}
        dropped = 0
        for kind, wanted in (("facts", used), ("views", set(recent)), ("manifest", set(recent))):
            for name in self._names(f"{self.root}/{kind}"):
                if name.startswith("version=") and int(name.split("=")[1]) not in wanted:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/{name}")
                    dropped += bool(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
        return dropped
