"""Queries over streams and incremental refresh, fed from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.operators import lines as LN
from fleetgrade.streaming import superseded as SU
from fleetgrade.streaming import watch as SS
from fleetgrade.session import work_folder
from fleetgrade.workload import event_views as V
from fleetgrade.workload import finding_queries as FQ
from fleetgrade.workload import script_queries as SQ
from fleetgrade.workload.registry import query, table
from fleetgrade.workload.source_queries import HISTORY_SQL, history_log

w = V.with_findings


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return event_stream(spark, sf).select(
        F.concat(F.lit("r"), F.col("user_id") % 12).alias("repo"),
        F.concat(F.lit("r"), F.col("user_id") % 12, F.when(F.col("event_id") % 9 == 0, "/.cache").when(F.col("event_id") % 9 == 1, "/build").otherwise(""), F.lit("/s"), F.col("user_id"), F.when(F.col("event_id") % 4 == 0, ".txt").otherwise(".sh")).alias("path"),
        F.col("props").alias("content"), F.when(F.col("event_id") % 5 == 0, "D").otherwise("M").alias("state"), F.col("ts").cast("timestamp").alias("modified"), "event_id")


@query("watch_files", "SELECT event_id FROM events WHERE event_id % 9 NOT IN (0, 1) AND event_id % 4 <> 0 AND event_id % 5 <> 0")
def watch_files(spark: SparkSession, sf: str) -> DataFrame:
    return SS.run_to_folder(SS.changed_scripts(_changes(spark, sf), ("build/",)), "watch").select("event_id")


@query("debounce", """WITH e AS (SELECT 'r' || (user_id % 12) AS repo, ts FROM events), g AS (SELECT repo, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY repo ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e),
 s AS (SELECT repo, ts, sum(fresh) OVER (PARTITION BY repo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g), w AS (SELECT repo, n, min(ts) AS a, max(ts) AS b, count(*) AS changes FROM s GROUP BY ALL)
 SELECT repo, epoch_us(a) AS start_us, changes FROM w WHERE b + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE""")
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    out = SS.run_to_folder(SS.debounce(_changes(spark, sf), "30 minutes", "10 minutes"), "debounce")
    return out.select("repo", F.unix_micros("start").alias("start_us"), "changes")


@query("history_windows", """SELECT 'r' || (user_id % 12) AS folder, epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms, count(*) AS scripts, round(sum(value % 10) / count(*), 4) AS average FROM events
 GROUP BY ALL HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def history_windows(spark: SparkSession, sf: str) -> DataFrame:
    scores = event_stream(spark, sf).select(F.concat(F.lit("r"), F.col("user_id") % 12).alias("folder"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") % 10).alias("global"))
    out = SS.run_to_folder(SS.history_windows(scores, "1 day", "1 hour"), "history")
    return out.select("folder", F.unix_millis("start").alias("start_ms"), "scripts", "average")


@query("drop_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def drop_repeats(spark: SparkSession, sf: str) -> DataFrame:
    s = event_stream(spark, sf).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return SS.run_to_folder(SS.drop_repeats(s, ["user_id", "event_type"], "ts", "3650 days"), "repeats").select("user_id", "event_type")


@query("upsert_stream", "SELECT 'u' || user_id AS path, arg_max(event_type, event_id) AS kind, max(event_id) AS modified FROM events GROUP BY user_id")
def upsert_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The changes arrive in several batches, newest first, and a second run with a new checkpoint reads all of them again."""
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_type").alias("kind"), F.col("event_id").alias("modified"))
    root = work_folder(spark, "upsert")
    late = F.when(F.pmod(F.col("modified"), F.lit(3)) == 0, 2).when(F.pmod(F.col("modified"), F.lit(3)) == 1, 1).otherwise(0)
    for k in (2, 0, 1):
        e.filter(late == k).coalesce(1).write.mode("append").parquet(f"{root}/changes")
    for run in ("first", "second"):
        s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", "1").parquet(f"{root}/changes")
        SS.upsert_stream(s, lambda b: b, f"{root}/table", f"{root}/{run}").awaitTermination()
    return SS.read_latest(spark, f"{root}/table")


@query("upsert_reports", w("SELECT path, position FROM fnd WHERE position % 2 = 0 AND path NOT IN (SELECT path FROM fnd WHERE position % 2 = 1 AND line = 3) UNION ALL SELECT path, position FROM fnd WHERE position % 2 = 1 AND line = 3"))
def upsert_reports(spark: SparkSession, sf: str) -> DataFrame:
    f = V.findings(spark, sf)
    return SS.upsert(f.filter("position % 2 = 0"), f.filter("position % 2 = 1 and line = 3")).select("path", "position")


@query("drop_superseded", w("SELECT f.path, f.position FROM fnd f JOIN (SELECT path, max(k % 3) AS g FROM fnd GROUP BY path) m ON m.path = f.path AND m.g = f.k % 3"))
def drop_superseded(spark: SparkSession, sf: str) -> DataFrame:
    f = V.findings(spark, sf)
    k = table(spark, sf, "events").select(F.col("event_id").alias("position"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("generation"))
    return SS.drop_superseded(f.join(k, "position")).select("path", "position")


@query("superseded_stream", w("SELECT f.path, f.position FROM fnd f JOIN (SELECT path, max(k % 3) AS g FROM fnd GROUP BY path) m ON m.path = f.path AND m.g = f.k % 3"))
def superseded_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same from a stream of micro-batches that mix the generations, with keyed state and a restart between them."""
    k = table(spark, sf, "events").select(F.col("event_id").alias("position"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("bigint").alias("generation"))
    rows = V.findings(spark, sf).select("path", "position").join(k, "position").withColumn("modified", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    root, name = work_folder(spark, "superseded"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, SU.ROCKS)
    try:
        for half in (0, 1):
            rows.filter(F.col("position") % 2 == half).repartition(2).write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
            out = SU.drop_superseded_stream(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress")
            out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return SS.drop_superseded(spark.read.schema(rows.schema).parquet(f"{root}/out")).select("path", "position")


_OVERLAY = FQ.DEDUP_SQL.replace(" FROM fnd),", " FROM ovl),", 1)


@query("overlay_refresh", w("SELECT path, tool, rule, line, position FROM ded",
  "ovl AS (SELECT * FROM fnd WHERE tool = 'builtin' OR line = 0 OR EXISTS (SELECT 1 FROM lns l WHERE l.path = fnd.path AND l.line = fnd.line AND l.line % 4 <> 1))", _OVERLAY))
def overlay_refresh(spark: SparkSession, sf: str) -> DataFrame:
    f = V.findings(spark, sf).drop("ts", "repo")
    old = V.lines(spark, sf)
    new = old.withColumn("raw", F.when(F.col("line") % 4 == 1, "changed").otherwise(F.col("raw")))
    return SS.overlay_refresh(f.filter("tool = 'builtin'"), f, old, new, 6).select("path", "tool", "rule", "line", "position")


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Results of the documents; a third were edited since, some runs had a failed tool."""
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit("unknown").alias("dialect"), "doc_id")
    old = d.withColumn("key", SS.result_key("c", "r", "t")).select("key", "doc_id", (F.col("doc_id") % 5 == 0).alias("failed"))
    return d.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))), old


@query("skip_unchanged", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def skip_unchanged(spark: SparkSession, sf: str) -> DataFrame:
    return SS.skip_unchanged(*_stored(spark, sf), "c", "r", "t")[0].select("doc_id")


@query("reuse_results", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def reuse_results(spark: SparkSession, sf: str) -> DataFrame:
    return SS.skip_unchanged(*_stored(spark, sf), "c", "r", "t")[1].select("doc_id")


@query("prune_cache", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 30 DAY")
def prune_cache(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("last_used"))
    return SS.prune_cache(stored, F.lit("1998-06-01").cast("timestamp_ntz")).select("o_orderkey")


@query("score_history", f"""WITH {HISTORY_SQL} SELECT folder, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(average - lag(average) OVER w, 1) AS change, round(average - first_value(average) OVER w, 1) AS since_first FROM hst WINDOW w AS (PARTITION BY folder ORDER BY ts)""")
def score_history(spark: SparkSession, sf: str) -> DataFrame:
    from fleetgrade.sources.reports import parse_history

    out = SS.score_history(parse_history(history_log(spark, sf)))
    return out.select("folder", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "change", "since_first")


@query("watch_rerun_scope", "SELECT 'changed' AS scope, count(*) AS files FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 4 = 0) UNION ALL SELECT 'all', count(*) FROM documents")
def watch_rerun_scope(spark: SparkSession, sf: str) -> DataFrame:
    files = SQ.documents(spark, sf).select("path")
    changed = table(spark, sf, "documents").filter("doc_id % 4 = 0").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    count = lambda df, name: df.agg(F.count("*").alias("files")).select(F.lit(name).alias("scope"), "files")
    return count(SS.watch_rerun_scope(files, changed, False), "changed").unionByName(count(SS.watch_rerun_scope(files, changed, True), "all"))
