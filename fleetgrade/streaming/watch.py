"""Streams of changed files and incremental refresh of stored results.

The file source reads a file once, so every version of a script lands as a new row of a
change table or under a new name; the logical path is a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetgrade.operators.findings import deduplicate, with_priority
from fleetgrade.session import work_folder
from fleetgrade.sources.files import drop_hidden_vendor, ignored, keep_scripts

CHANGES = "repo string, path string, content string, state string, modified timestamp"


def watch_files(spark: SparkSession, landing: str, ignore: Iterable[str] = (), **options: str) -> DataFrame:
    """Stream of changed scripts from a landing folder of change rows.

    Deleted files, hidden and vendor folders and ignored paths are left out; a new folder
    needs no registration, since paths are data.
    """
    changes = spark.readStream.schema(CHANGES).options(**options).parquet(landing)
    return changed_scripts(changes, ignore)


def changed_scripts(changes: DataFrame, ignore: Iterable[str] = ()) -> DataFrame:
    kept = drop_hidden_vendor(changes.filter("state <> 'D'"))
    patterns = list(ignore)
    if patterns:
        kept = kept.filter(~ignored(F.col("path"), patterns))
    return keep_scripts(kept)


def debounce(changes: DataFrame, gap: str = "400 milliseconds", delay: str = "400 milliseconds") -> DataFrame:
    """Bursts of changes per repository: a burst closes after ``gap`` without an event.

    Files of a burst are not gathered in the state: it holds counts and times only.
    """
    return (
        changes.withWatermark("modified", delay)
        .groupBy("repo", F.session_window("modified", gap).alias("w"))
        .agg(F.count("*").alias("changes"), F.max("modified").alias("last"))
        .select("repo", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes", "last")
    )


def upsert(current: DataFrame, batch: DataFrame, key: str = "path") -> DataFrame:
    """Rows of re-analysed files replace theirs, others stay."""
    kept = current.join(batch.select(key).distinct(), key, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def _versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Complete version folders by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return {int(n.split("=")[1].split(".")[0]): n for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))}


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete version of a stored table, or none."""
    done = _versions(spark, root)
    return spark.read.parquet(f"{root}/{done[max(done)]}") if done else None


def _merged(stored: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of each key by its latest ``order``; of equal ones the fresh rows."""
    known = stored.groupBy(key).agg(F.max(order).alias("_known"))
    newer = fresh.join(known, key, "left").filter(F.col("_known").isNull() | (F.col(order) >= F.col("_known"))).drop("_known")
    return upsert(stored, newer, key)


def upsert_stream(
    changes: DataFrame, analyze: Callable[[DataFrame], DataFrame], root: str, checkpoint: str, key: str = "path", order: str = "modified", keep: int = 2, **trigger
) -> StreamingQuery:
    """Analyse each micro-batch and store the merged table as a new version.

    ``analyze`` hands the ``order`` of a file on to its rows: what arrives late never replaces
    what is newer. Versions are numbered on, and named by the run (a checkpoint folder is one) and its
    batch: a batch that runs again finds its version done, and a new checkpoint goes on from the
    latest version. The newest ``keep`` versions stay, for readers of the one before.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        done, mine = _versions(spark, root), f"{run}-{batch_id}"
        if any(n.split(".", 1)[1] == mine for n in done.values()):
            return
        fresh = drop_superseded(analyze(newest(batch, key, order)), key, order)
        stored = read_latest(spark, root)
        out = fresh if stored is None else _merged(stored, fresh, key, order)
        out.write.mode("overwrite").parquet(f"{root}/version={max(done, default=-1) + 1}.{mine}")
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for number in sorted(done)[: max(0, len(done) + 1 - keep)]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{done[number]}"), True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest(versions: DataFrame, key: str = "path", order: str = "modified") -> DataFrame:
    """The last version of each file of a batch; late older versions fall away."""
    others = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("v")).select(key, "v.*")


def drop_superseded(results: DataFrame, key: str = "path", generation: str = "generation") -> DataFrame:
    """Results of an older generation of a file are discarded."""
    last = results.groupBy(key).agg(F.max(generation).alias(generation))
    return results.join(last, [key, generation], "left_semi")


def drop_repeats(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Stream without repeated deliveries of one version inside the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def overlay_refresh(quick: DataFrame, earlier: DataFrame, old_lines: DataFrame, new_lines: DataFrame, max_span: int | None = None) -> DataFrame:
    """Fresh findings of the cheap rules plus earlier tool findings on lines that did not change.

    ``quick`` holds findings on the new text; edits of earlier findings are dropped.
    """
    same = old_lines.select("path", "line", "raw").join(new_lines.select("path", "line", "raw"), ["path", "line", "raw"]).select("path", "line").distinct()
    tools = earlier.filter(F.col("tool") != "builtin").withColumn("edits", F.slice("edits", 1, 0))
    kept = tools.filter("line = 0").unionByName(tools.filter("line > 0").join(same, ["path", "line"], "left_semi").select(*tools.columns))
    return deduplicate(with_priority(quick.unionByName(kept, allowMissingColumns=True)), max_span)


def result_key(config: str, rule_set: str, tools: str) -> F.Column:
    """Key of a stored result: content, path, dialect, configuration, rule set, tool versions."""
    return F.sha2(F.concat_ws("\u0000", "path", "dialect", F.sha2("content", 256), F.lit(config), F.lit(rule_set), F.lit(tools)), 256)


def skip_unchanged(files: DataFrame, stored: DataFrame, config: str = "", rule_set: str = "", tools: str = "") -> tuple[DataFrame, DataFrame]:
    """(files to analyse, stored rows to reuse). Stored rows of a run with a failed tool are not reused."""
    keyed = files.withColumn("key", result_key(config, rule_set, tools))
    usable = stored.filter(~F.coalesce("failed", F.lit(False)))
    todo = keyed.join(usable.select("key").distinct(), "key", "left_anti")
    return todo, usable.join(keyed.select("key").distinct(), "key", "left_semi")


# Fixed value: days after which an unread stored result is dropped.
CACHE_DAYS = 30


def prune_cache(stored: DataFrame, now: F.Column, days: int = CACHE_DAYS) -> DataFrame:
    return stored.filter(F.col("last_used") >= now - F.make_dt_interval(days=F.lit(days)))


def score_history(history: DataFrame) -> DataFrame:
    """Each scan with its change to the one before and to the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("folder").orderBy("ts")
    step = F.round(F.col("average") - F.lag("average").over(w), 1)
    return history.withColumn("change", step).withColumn("since_first", F.round(F.col("average") - F.first("average").over(w), 1))


def history_windows(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """Mean score per folder and time window of a stream of scores (folder, ts, global)."""
    return (
        stream.withWatermark("ts", delay).groupBy("folder", F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("scripts"), F.sum("global").alias("total"))
        .select("folder", F.col("w.start").alias("start"), "scripts", F.round(F.col("total") / F.col("scripts"), 4).alias("average"))
    )


def watch_rerun_scope(targets: DataFrame, changed: DataFrame, reports_written: bool) -> DataFrame:
    """What a change runs again: the changed files, or all targets when report files are written."""
    return targets if reports_written else targets.join(changed.select("path").distinct(), "path", "left_semi")


def run_to_folder(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a written table and return the table."""
    spark = stream.sparkSession
    root = work_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/data").option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")
