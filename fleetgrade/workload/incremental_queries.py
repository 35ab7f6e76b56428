"""A fleet of scripts that changes: what the stored sums hold after a refresh, against a full count of the new version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.operators import lines as LN
from fleetgrade.operators import scoring as AG
from fleetgrade.operators import shell_rules as SR
from fleetgrade.session import cut, work_folder
from fleetgrade.settings import repo_of
from fleetgrade.streaming.incremental import ResultStore, facts_of, folder_table, rule_table
from fleetgrade.workload import event_views as EV
from fleetgrade.workload import script_queries as Q
from fleetgrade.workload import script_views as V
from fleetgrade.workload.registry import query, table
from fleetgrade.workload.settings_queries import _CATALOG, _GUARD, _WANT


def facts(files: DataFrame) -> DataFrame:
    """Facts of shell files by the built-in rules of the standard profile."""
    model = LN.with_model(files)
    found = cut(SR.shell_findings(LN.mask_lines(model), model))
    counts = cut(LN.content_flags(model).select("path", "dialect", "code_lines"))
    return facts_of(counts, found, AG.script_scores(counts, AG.rule_penalties(found, counts)), repo_of())


def refreshed(spark: SparkSession, sf: str) -> tuple[ResultStore, DataFrame]:
    """A store of the first version of the scripts, refreshed to the second: one in a hundred changed, one is new, one is gone."""
    k = F.col("p_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_size")
    first = parts.filter(k % 100 != 21)
    second = parts.filter(k % 100 != 13).withColumn("p_size", F.when(k % 100 == 7, F.col("p_size") + 1).otherwise(F.col("p_size")))
    store = ResultStore(spark, work_folder(spark, "results"), buckets=64)
    runs = [store.refresh(cut(V.files_of(p).select("path", "content")), facts) for p in (first, second)]
    return store, spark.createDataFrame([(i, r.analysed, r.removed) for i, r in enumerate(runs)], "run int, analysed bigint, removed bigint")


_SECOND = "prt AS (SELECT p_partkey, CASE WHEN p_partkey % 100 = 7 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 100 <> 13)"
_CTES = [
    _SECOND, V.FILES_SQL.replace("FROM part)", "FROM prt)"), V.FLAGS_SQL, Q._HEAD_SQL, Q._FILE_SQL.replace("code_lines > 20", "code_lines > 150"), Q._DEPTH_SQL,
    f"""want(raw, rule) AS (VALUES {_WANT}), cat(rule, category, severity, ctx) AS (VALUES {_CATALOG}),
hit AS (
  SELECT s.path, s.line, w.rule FROM sln s JOIN sfg f USING (path) JOIN want w ON w.raw = s.raw WHERE NOT s.in_heredoc AND CASE w.rule {_GUARD} ELSE true END
  UNION ALL SELECT path, line, rule FROM fa
  UNION ALL SELECT path, line, 'MNT001' FROM sln WHERE length(raw) > 120 AND NOT in_heredoc
  UNION ALL SELECT path, line, 'MNT003' FROM (SELECT *, coalesce(lag(depth) OVER (PARTITION BY path ORDER BY line), 0) AS before FROM ev5) WHERE top > 4 AND before <= 4
  UNION ALL SELECT path, line, 'PERF004' FROM sln WHERE raw LIKE '%$(basename %'),
fin AS (SELECT path, line, rule, 'builtin' AS tool, category, severity FROM hit JOIN cat USING (rule) WHERE len(ctx) = 0)""",
    EV.penalty_sql("fin", "pen", "sfg"), EV.score_sql("pen", "scr", "sfg"),
]


def _sql(body: str) -> str:
    return "WITH " + ", ".join(_CTES) + " " + body


@query("incremental_folders", _sql(
    f"""SELECT split_part(path, '/', 1) AS folder, count(*) AS files, 0::BIGINT AS python_files, count(*) AS shell_files, round(round(avg("global"), 6) * 10) / 10 AS average,
 {', '.join(f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in 'ABCDE')}, {', '.join(f'coalesce(sum({s}), 0)::BIGINT AS {s}' for s in dims.SEVERITIES)}
 FROM scr LEFT JOIN (SELECT path, {', '.join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in dims.SEVERITIES)} FROM fin GROUP BY path) USING (path) GROUP BY 1"""))
def incremental_folders(spark: SparkSession, sf: str) -> DataFrame:
    return folder_table(refreshed(spark, sf)[0].view("folders"))


@query("incremental_rules", _sql("""SELECT tool, rule, count(*) AS occurrences, count(DISTINCT path) AS affected,
 (['critical', 'high', 'medium', 'low'])[min(list_position(['critical', 'high', 'medium', 'low'], severity))] AS severity FROM fin GROUP BY tool, rule"""))
def incremental_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rule_table(refreshed(spark, sf)[0].view("rules"))


@query("incremental_work", """SELECT run, analysed, removed FROM (
 SELECT 0 AS run, count(*) FILTER (p_partkey % 100 <> 21) AS analysed, 0::BIGINT AS removed FROM part
 UNION ALL SELECT 1, count(*) FILTER (p_partkey % 100 IN (7, 21)), count(*) FILTER (p_partkey % 100 = 13) FROM part)""")
def incremental_work(spark: SparkSession, sf: str) -> DataFrame:
    """Files analysed and removed by the first fill and by the refresh."""
    return refreshed(spark, sf)[1]
