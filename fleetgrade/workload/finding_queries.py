"""Queries over findings: algebra, scores, explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.functions import scalars as S
from fleetgrade.operators import explain as E
from fleetgrade.operators import findings as FD
from fleetgrade.operators import scoring as AG
from fleetgrade.workload import event_views as V
from fleetgrade.workload.registry import query

w = V.with_findings
PEN, SCR = V.penalty_sql(), V.score_sql()
KEY = ["path", "tool", "rule", "line", "position"]
RANKS = {t: i for i, t in enumerate(dims.TOOL_PRIORITY)}
RANK_SQL = "CASE tool " + " ".join(f"WHEN '{t}' THEN {RANKS[t]}" for t in V.TOOLS) + " END"

_MATCH = "(CASE WHEN p LIKE '%*' THEN starts_with({r}, left(p, length(p) - 1)) ELSE p = {r} END)"
DEDUP_SQL = f"""
ord AS (SELECT *, {RANK_SQL} AS tool_rank, row_number() OVER (PARTITION BY path ORDER BY {RANK_SQL}, position) AS n,
  CASE WHEN end_line >= line AND end_line - line < 6 THEN end_line ELSE line END AS last FROM fnd),
step AS (
  SELECT path, CAST(0 AS BIGINT) AS n, [] ::STRUCT(tool VARCHAR, rule VARCHAR, line INTEGER, last INTEGER, eq VARCHAR[], n BIGINT)[] AS kept FROM (SELECT DISTINCT path FROM ord)
  UNION ALL
  SELECT s.path, o.n, CASE WHEN len(list_filter(s.kept, lambda x:
      ((len(list_filter(x.eq, lambda p: {_MATCH.format(r='o.rule')})) > 0 OR len(list_filter(o.equivalents, lambda p: {_MATCH.format(r='x.rule')})) > 0)
       AND CASE WHEN x.tool = o.tool THEN x.line = o.line ELSE
         x.line = o.line OR (x.line <= o.last AND o.line <= x.last) OR x.line = 0 OR o.line = 0 OR x.rule = 'SYNTAX' OR o.rule = 'SYNTAX' END)
      OR (x.tool = o.tool AND x.line = o.line AND x.rule = o.rule))) > 0
    THEN s.kept ELSE list_append(s.kept, {{'tool': o.tool, 'rule': o.rule, 'line': o.line, 'last': o.last, 'eq': o.equivalents, 'n': o.n}}) END
  FROM step s JOIN ord o ON o.path = s.path AND o.n = s.n + 1),
ded AS (SELECT o.* FROM ord o JOIN (SELECT path, unnest(kept).n AS n FROM (SELECT path, arg_max(kept, n) AS kept FROM step GROUP BY path)) k USING (path, n))
"""


@query("union_findings", w(f"SELECT path, tool, rule, {RANK_SQL} AS tool_rank, count(*) AS n FROM fnd GROUP BY ALL"))
def union_findings(spark: SparkSession, sf: str) -> DataFrame:
    parts = [V.findings(spark, sf, f"event_type {op} 'click'") for op in ("=", "<>")]
    return FD.union_findings(parts).groupBy("path", "tool", "rule", "tool_rank").agg(F.count("*").alias("n"))


@query("deduplicate", w("SELECT path, tool, rule, line, position FROM ded", DEDUP_SQL))
def deduplicate(spark: SparkSession, sf: str) -> DataFrame:
    return FD.deduplicate(V.findings(spark, sf), 6).select(*KEY)


@query("deduplicated_scores", w("SELECT path, \"global\", grade FROM scr", DEDUP_SQL, V.penalty_sql("ded"), SCR))
def deduplicated_scores(spark: SparkSession, sf: str) -> DataFrame:
    files = V.files(spark, sf)
    pen = AG.rule_penalties(FD.deduplicate(V.findings(spark, sf), 6), files)
    return AG.script_scores(files, pen).select("path", "global", "grade")


# Directive comments derived from the lines of the event files.
def directive_lines(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line")
    return V.lines(spark, sf).select(
        "path", "line",
        F.when(n % 11 == 3, F.lit("# fleetgrade disable=SEC002, sc20*"))
        .when(n % 11 == 4, F.lit(""))
        .when(n % 13 == 5, F.lit("run x  # fleetgrade disable=MNT001,PERF001"))
        .when((n == 7) & (F.length("path") % 2 == 0), F.lit("#fleetgrade disable-file=S1*"))
        .when(n % 17 == 8, F.lit("x # fleetgrade disable-next-line = all"))
        .when(n % 19 == 9, F.lit("call()  # noqa: S105"))
        .when(n % 19 == 10, F.lit("call()  # nosec"))
        .otherwise(F.col("raw")).alias("raw"),
    )


DIRECTIVE_SQL = r"""
dln AS (SELECT path, line, CASE WHEN line % 11 = 3 THEN '# fleetgrade disable=SEC002, sc20*' WHEN line % 11 = 4 THEN ''
  WHEN line % 13 = 5 THEN 'run x  # fleetgrade disable=MNT001,PERF001'
  WHEN line = 7 AND length(path) % 2 = 0 THEN '#fleetgrade disable-file=S1*'
  WHEN line % 17 = 8 THEN 'x # fleetgrade disable-next-line = all'
  WHEN line % 19 = 9 THEN 'call()  # noqa: S105' WHEN line % 19 = 10 THEN 'call()  # nosec' ELSE raw END AS raw FROM lns),
dcode AS (SELECT path, line FROM dln WHERE NOT regexp_matches(raw, '^\s*(#|$)')),
dir0 AS (SELECT path, line, raw, CASE WHEN raw LIKE '%disable-file%' THEN 'disable-file' WHEN raw LIKE '%disable-next-line%' THEN 'disable-next-line' ELSE 'disable' END AS kind,
  list_filter(string_split_regex(upper(trim(regexp_extract(raw, 'disable[a-z-]*\s*=\s*(.*)$', 1))), '[,\s]+'), lambda x: x <> '') AS ids
  FROM dln WHERE raw LIKE '%fleetgrade disable%'),
dir AS (SELECT path, line, kind, ids, CASE WHEN kind = 'disable-file' THEN 0
  WHEN kind = 'disable-next-line' OR raw LIKE '#%' THEN coalesce((SELECT min(c.line) FROM dcode c WHERE c.path = d.path AND c.line > d.line), -1)
  ELSE line END AS target FROM dir0 d
  UNION ALL SELECT path, line, 'noqa', ['B105','S105'], line FROM dln WHERE raw LIKE '%noqa: S105%'
  UNION ALL SELECT path, line, 'security', ['ALL'], line FROM dln WHERE raw LIKE '%# nosec'),
dirx AS (SELECT path, line AS dline, kind, target, unnest(ids) AS p FROM dir),
kpt AS (SELECT f.* FROM fnd f WHERE NOT EXISTS (SELECT 1 FROM dirx d WHERE d.path = f.path AND
   CASE WHEN d.kind = 'security' THEN f.line = d.target AND f.category = 'security'
   ELSE (d.target = 0 OR d.target = f.line) AND (d.p = 'ALL' OR d.p = f.rule OR (d.p LIKE '%*' AND starts_with(f.rule, left(d.p, length(d.p) - 1)))) END))
"""


def _directives(spark: SparkSession, sf: str) -> DataFrame:
    lines = directive_lines(spark, sf)
    return FD.parse_directives(lines, lines.select("path").distinct())


@query("parse_directives", w("SELECT path, line, kind, array_to_string(list_sort(ids), ',') AS ids, target FROM dir", DIRECTIVE_SQL))
def parse_directives(spark: SparkSession, sf: str) -> DataFrame:
    return _directives(spark, sf).withColumn("ids", F.array_join(F.array_sort("ids"), ","))


@query("suppress", w("SELECT path, tool, rule, line, position FROM kpt", DIRECTIVE_SQL))
def suppress(spark: SparkSession, sf: str) -> DataFrame:
    return FD.suppress(V.findings(spark, sf), _directives(spark, sf)).select(*KEY)


@query("suppressed_count", w("SELECT path, count(*) - count(k.position) AS suppressed FROM fnd f LEFT JOIN (SELECT position FROM kpt) k USING (position) GROUP BY path", DIRECTIVE_SQL))
def suppressed_count(spark: SparkSession, sf: str) -> DataFrame:
    raw = V.findings(spark, sf)
    return FD.suppressed_count(raw, FD.suppress(raw, _directives(spark, sf)))


_KNOWN = ("SEC002", "MNT001", "PERF001")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per file and tool; every seventh pair failed."""
    return V.findings(spark, sf).groupBy("path", "tool").agg(F.count("*").alias("findings"), F.min("position").alias("p")).select(
        "path", "tool", F.when(F.col("p") % 7 == 3, "failed").when(F.col("p") % 7 == 4, "missing").otherwise("ok").alias("status"), "findings"
    )


RUNS_SQL = "runs AS (SELECT path, tool, CASE min(position) % 7 WHEN 3 THEN 'failed' WHEN 4 THEN 'missing' ELSE 'ok' END AS status, count(*) AS findings FROM fnd GROUP BY path, tool)"


@query("stale_directives", w("""SELECT d.path, d.line, 'MNT011' AS rule, array_to_string(d.ids, ', ') AS ids FROM dir d
 JOIN (SELECT path, bool_and(status IN ('ok','disabled')) AS all_ran, bool_or(tool = 'builtin' AND status = 'ok') AS b FROM runs GROUP BY path) r USING (path)
 WHERE d.kind LIKE 'disable%' AND (all_ran OR (b AND len(list_filter(d.ids, lambda i: i NOT IN ('SEC002','MNT001','PERF001'))) = 0))
 AND NOT EXISTS (SELECT 1 FROM fnd f WHERE f.path = d.path AND (d.target = 0 OR d.target = f.line) AND len(list_filter(d.ids, lambda p:
   p = 'ALL' OR p = f.rule OR (p LIKE '%*' AND starts_with(f.rule, left(p, length(p) - 1))))) > 0)""", DIRECTIVE_SQL, RUNS_SQL))
def stale_directives(spark: SparkSession, sf: str) -> DataFrame:
    out = FD.stale_directives(_directives(spark, sf), V.findings(spark, sf), _runs(spark, sf), _KNOWN)
    return out.select("path", "line", "rule", F.regexp_extract("message", r"\((.*)\)", 1).alias("ids"))


def _map_sql(pairs: dict[str, str], col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


@query("enrich", w(f"""SELECT position, CASE tool WHEN 'gitleaks' THEN '{FD.TOOL_HINTS["gitleaks"]}' END AS hint,
 CASE WHEN tool = 'shellcheck' THEN 'https://www.shellcheck.net/wiki/' || rule ELSE {_map_sql(FD.TOOL_URLS, 'tool')} END AS url FROM fnd"""))
def enrich(spark: SparkSession, sf: str) -> DataFrame:
    return FD.enrich(V.findings(spark, sf)).select("position", "hint", "url")


_REFS = {k: v for k, v in FD.rule_reference_map().items()}
REF_SQL = "refmap AS (SELECT unnest(%s) AS rule, unnest(%s) AS rr)" % (
    V._array(_REFS), "[" + ",".join(V._array(v) for v in _REFS.values()) + "]")


@query("add_references", w("""SELECT position, string_agg(ref, '|' ORDER BY k, num, ref) AS refs FROM (
 SELECT DISTINCT position, ref, CASE WHEN ref LIKE 'CWE-%' THEN 0 WHEN ref LIKE 'OWASP%' THEN 1 ELSE 2 END AS k,
  CASE WHEN ref LIKE 'CWE-%' THEN CAST(substr(ref, 5) AS INT) ELSE 0 END AS num FROM (
  SELECT position, unnest(refs) AS ref FROM fnd
  UNION ALL SELECT position, unnest(rr) FROM fnd JOIN refmap USING (rule)
  UNION ALL SELECT position, unnest(rr) FROM (SELECT position, unnest(equivalents) AS rule FROM fnd) JOIN refmap USING (rule))) GROUP BY position""", REF_SQL))
def add_references(spark: SparkSession, sf: str) -> DataFrame:
    out = FD.add_references(V.findings(spark, sf)).filter(F.size("refs") > 0)
    return out.select("position", F.array_join("refs", "|").alias("refs"))


@query("escalate", w("""SELECT position, CASE WHEN rule = 'SEC009' AND sev > 1 THEN 'high' WHEN rule = 'ROB005' AND sev > 1 THEN 'high'
 WHEN rule = 'SC2164' THEN 'critical' ELSE severity END AS severity FROM fnd"""))
def escalate(spark: SparkSession, sf: str) -> DataFrame:
    return FD.escalate(V.findings(spark, sf), ("root", "cron")).select("position", "severity")


@query("apply_config", w("""SELECT position, rule, CASE WHEN rule = 'MNT001' THEN 'robustness' ELSE category END AS category,
 CASE WHEN rule IN ('MNT001', 'SEC022') THEN 'high' ELSE severity END AS severity FROM fnd WHERE rule NOT IN ('SC2164', 'ROB005', 'B105', 'S105')"""))
def apply_config(spark: SparkSession, sf: str) -> DataFrame:
    out = FD.apply_config(
        V.findings(spark, sf), ("rob005", "B105"), {"MNT001": ("robustness", "high"), "sec022": (None, "high")}
    )
    return out.select("position", "rule", "category", "severity")


@query("same_rule_ids", w("""SELECT r.rule, p.b AS same FROM (SELECT DISTINCT rule FROM (SELECT rule FROM fnd UNION ALL SELECT 'SC2196' || '' FROM fnd)) r JOIN (
 VALUES ('ROB005','SC2164'),('SC2164','ROB005'),('PERF001','SC2002'),('SC2002','PERF001'),('S105','B105'),('B105','S105'),
 ('SC2196','POR005'),('SC2196','SC2197')) p(a, b) ON r.rule = p.a"""))
def same_rule_ids(spark: SparkSession, sf: str) -> DataFrame:
    rules = V.findings(spark, sf).select("rule")
    return FD.same_rules(rules.unionByName(rules.select(F.lit("SC2196").alias("rule"))))


FP_SQL = """
fpt AS (SELECT f.*, coalesce(trim(regexp_replace(l.raw, '\\s+', ' ', 'g')), '') AS txt FROM fnd f LEFT JOIN lns l USING (path, line)),
fpk AS (SELECT *, tool || '|' || rule || '|' || txt || '|' || row_number() OVER (PARTITION BY path, tool, rule, txt ORDER BY position) AS key FROM fpt),
fph AS (SELECT *, printf('%016x', CAST(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::HUGEINT)),
   lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::HUGEINT * 1099511628211) % 18446744073709551616) AS UBIGINT)) AS fingerprint FROM fpk)"""


@query("fingerprint", w("SELECT position, fingerprint FROM fph", FP_SQL))
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return FD.fingerprint(V.findings(spark, sf), V.lines(spark, sf)).select("position", "fingerprint")


@query("attach_source", w("""SELECT f.position, CASE WHEN s.path IS NULL THEN rtrim(l.raw) END AS snippet,
 f.fixable AND NOT EXISTS (SELECT 1 FROM sec WHERE sec.path = f.path AND sec.line BETWEEN f.line AND f.line + f.edit_extra) AS fixable
 FROM fnd f LEFT JOIN lns l USING (path, line) LEFT JOIN sec s ON s.path = f.path AND s.line = f.line""",
 """sec AS (SELECT DISTINCT path, line FROM fnd WHERE tool = 'gitleaks' OR (tool = 'builtin' AND rule IN ('SEC002', 'SEC022'))
  OR (tool = 'bandit' AND rule = 'B105') OR (tool = 'ruff' AND rule = 'S105'))"""))
def attach_source(spark: SparkSession, sf: str) -> DataFrame:
    f = V.findings(spark, sf).withColumn("snippet", F.lit(None).cast("string"))
    out = FD.attach_source(f, V.lines(spark, sf), f)
    return out.select("position", "snippet", (F.size("edits") > 0).alias("fixable"))


@query("sort_findings", w("""SELECT path, tool, rule, line, position, row_number() OVER (ORDER BY path,
 CASE category WHEN 'security' THEN 0 WHEN 'robustness' THEN 1 WHEN 'maintainability' THEN 2 WHEN 'portability' THEN 3 ELSE 4 END, sev, line, tool, position) AS n FROM fnd"""))
def sort_findings(spark: SparkSession, sf: str) -> DataFrame:
    return FD.number_sorted(V.findings(spark, sf)).select(*KEY, "n")


@query("filter_refs", w("SELECT position FROM fnd WHERE k % 4 = 0 AND (k = 80 OR 'CWE-' || k LIKE 'CWE-8%' OR k IS NOT NULL)"))
def filter_refs(spark: SparkSession, sf: str) -> DataFrame:
    return FD.filter_refs(V.findings(spark, sf), ("cwe-8", "A08")).select("position")


@query("filter_findings", w("SELECT position FROM fnd WHERE category IN ('security','performance') AND severity IN ('critical','high')"))
def filter_findings(spark: SparkSession, sf: str) -> DataFrame:
    return FD.filter_findings(V.findings(spark, sf), ("security", "performance"), ("critical", "high")).select("position")


@query("search_findings", w("SELECT position FROM fnd WHERE (event_type LIKE '%click%') AND contains(lower(concat_ws(' ', rule, message, tool, category, array_to_string(refs, ' '), 'l' || line)), 'l12')"))
def search_findings(spark: SparkSession, sf: str) -> DataFrame:
    return FD.search_findings(V.findings(spark, sf), "Click L12").select("position")


@query("top_details", w("SELECT path, tool, rule, line, position FROM (SELECT *, row_number() OVER (PARTITION BY path, category ORDER BY sev, line, tool, position) AS n FROM fnd) WHERE n <= 3"))
def top_details(spark: SparkSession, sf: str) -> DataFrame:
    return FD.top_details(V.findings(spark, sf), 3).select(*KEY)


# ---------------------------------------------------------------- scores


@query("severity_counts", w("SELECT path, category, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in dims.SEVERITIES) + ", count(*) AS total FROM fnd GROUP BY ALL"))
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return AG.severity_counts(V.findings(spark, sf))


def scored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    f, files = V.findings(spark, sf), V.files(spark, sf)
    pen = AG.rule_penalties(f, files)
    return f, files, pen, AG.script_scores(files, pen)


@query("rule_penalties", w("SELECT path, category, tool, rule, severity, n, round(cost, 6) AS cost FROM pen", PEN))
def rule_penalties(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf)[2].withColumn("cost", F.round("cost", 6))


@query("script_scores", w("SELECT * FROM scr", PEN, SCR))
def script_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf)[3]


@query("category_scores", w("SELECT u.path, u.category, u.score, " + ", ".join(f"coalesce(c.{s}, 0) AS {s}" for s in (*dims.SEVERITIES, "total")) +
 " FROM (UNPIVOT (SELECT path, security, robustness, maintainability, portability, performance FROM scr) ON security, robustness, maintainability, portability, performance INTO NAME category VALUE score) u LEFT JOIN (SELECT path, category, "
 + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in dims.SEVERITIES) + ", count(*) AS total FROM fnd GROUP BY ALL) c USING (path, category)", PEN, SCR))
def category_scores(spark: SparkSession, sf: str) -> DataFrame:
    f, files, pen, _ = scored(spark, sf)
    return AG.category_scores(files, f, pen)


@query("global_score", w("SELECT path, \"global\" FROM scr", PEN, SCR))
def global_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf)[3].select("path", "global")


@query("grade_distribution", w("SELECT grade, count(*) AS files FROM scr GROUP BY grade", PEN, SCR))
def grade_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf)[3].groupBy("grade").agg(F.count("*").alias("files"))


@query("folder_summary", w("""SELECT f.repo, count(*) AS files, count(*) FILTER (dialect = 'python') AS python_files, count(*) FILTER (dialect <> 'python') AS shell_files,
 round(round(avg("global"), 6) * 10) / 10 AS average, """ + ", ".join(f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in "ABCDE") + ", "
 + ", ".join(f"sum(coalesce({s}, 0))::BIGINT AS {s}" for s in dims.SEVERITIES) + " FROM fls f JOIN scr USING (path) LEFT JOIN (SELECT path, "
 + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in dims.SEVERITIES) + " FROM fnd GROUP BY path) c USING (path) GROUP BY f.repo", PEN, SCR))
def folder_summary(spark: SparkSession, sf: str) -> DataFrame:
    f, files, _, scr = scored(spark, sf)
    return AG.folder_summary(scr, f, files)


@query("script_table", w("""SELECT f.path, f.dialect, s.security, s.robustness, s.maintainability, s.portability, s.performance, s."global", s.grade,
 coalesce(c.critical, 0) AS critical, coalesce(c.high, 0) AS high FROM fls f JOIN scr s USING (path) LEFT JOIN (SELECT path,
 count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM fnd GROUP BY path) c USING (path)""", PEN, SCR))
def script_table(spark: SparkSession, sf: str) -> DataFrame:
    f, files, _, scr = scored(spark, sf)
    return AG.script_table(scr, f, files)


_SEVN = "(['critical','high','medium','low'])[min(sev) + 1] AS severity"


@query("top_rules", w(f"SELECT tool, rule, count(*) AS occurrences, count(DISTINCT path) AS affected, {_SEVN} FROM fnd GROUP BY tool, rule ORDER BY occurrences DESC, tool, rule LIMIT 20"))
def top_rules(spark: SparkSession, sf: str) -> DataFrame:
    return AG.top_rules(V.findings(spark, sf), 20)


@query("top_rules_by_repo", w(f"SELECT repo, tool, rule, occurrences, affected, severity FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY occurrences DESC, tool, rule) AS n FROM (SELECT repo, tool, rule, count(*) AS occurrences, count(DISTINCT path) AS affected, {_SEVN} FROM fnd GROUP BY ALL)) WHERE n <= 15"))
def top_rules_by_repo(spark: SparkSession, sf: str) -> DataFrame:
    return AG.top_rules(V.findings(spark, sf), 15, keys=("repo",))


@query("fleet_rules", w(f"SELECT tool, rule, count(*) AS occurrences, count(DISTINCT repo) AS affected, {_SEVN} FROM fnd GROUP BY tool, rule ORDER BY occurrences DESC, tool, rule LIMIT 15"))
def fleet_rules(spark: SparkSession, sf: str) -> DataFrame:
    return AG.top_rules(V.findings(spark, sf), 15, unit="repo")


@query("weakest_scripts", w("SELECT repo, rank, path, \"global\" FROM (SELECT f.repo, s.path, s.\"global\", row_number() OVER (PARTITION BY f.repo ORDER BY s.\"global\", s.path) AS rank FROM scr s JOIN fls f USING (path)) WHERE rank <= 5", PEN, SCR))
def weakest_scripts(spark: SparkSession, sf: str) -> DataFrame:
    _, files, _, scr = scored(spark, sf)
    return AG.weakest_scripts(scr.join(files.select("path", "repo"), "path"))


@query("compliance", w("""SELECT r.ref, CASE WHEN r.ref LIKE 'CWE%' THEN 'CWE' ELSE 'OWASP Top 10 2021' END AS family, t.title, count(*) AS count,
 count(DISTINCT r.path) AS files, (['critical','high','medium','low'])[min(r.sev) + 1] AS severity
 FROM (SELECT path, sev, unnest(refs) AS ref FROM fnd) r LEFT JOIN titles t USING (ref) GROUP BY r.ref, t.title""",
 "titles AS (SELECT * FROM (VALUES " + ",".join(f"('{k}','{v}')" for k, v in dims.REFERENCE_TITLES.items()) + ") t(ref, title))"))
def compliance(spark: SparkSession, sf: str) -> DataFrame:
    return AG.compliance(V.findings(spark, sf), dims.title_table(spark))


@query("suggest_profile", w("""SELECT f.repo, CASE WHEN round(avg("global"), 6) >= 8.5 THEN 'strict' WHEN round(avg("global"), 6) < 6 THEN 'legacy' ELSE 'standard' END AS profile
 FROM scr JOIN fls f USING (path) GROUP BY f.repo""", PEN, SCR))
def suggest_profile(spark: SparkSession, sf: str) -> DataFrame:
    _, files, _, scr = scored(spark, sf)
    return AG.suggest_profile(scr.join(files.select("path", "repo"), "path"))


@query("rule_histogram", w("SELECT path, rule || '(' || severity || ')' AS label, count(*) AS n FROM fnd GROUP BY ALL"))
def rule_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return AG.rule_histogram(V.findings(spark, sf))


@query("run_gate_outputs", w("SELECT round(round(avg(\"global\"), 6) * 10) / 10 AS score, max(grade) AS grade, count(*) AS files FROM scr", PEN, SCR))
def run_gate_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return AG.run_gate_outputs(scored(spark, sf)[3])


@query("calibrate", w("""SELECT s.path, s."global", s.grade, CASE WHEN l.q = 1 THEN s.grade IN ('A','B','C') ELSE s.grade IN ('C','D','E') END AS grade_ok,
 CAST(NOT EXISTS (SELECT 1 FROM fnd f WHERE f.path = s.path AND f.rule = 'SEC009') AS BIGINT) AS missing,
 CAST(EXISTS (SELECT 1 FROM fnd f WHERE f.path = s.path AND f.rule = 'B105') AS BIGINT) AS forbidden
 FROM scr s JOIN fls USING (path) JOIN (SELECT 's' || doc_id AS s, max(quality) AS q FROM labels GROUP BY 1) l ON regexp_extract(s.path, '(s\\d+)\\.sh', 1) = l.s""", PEN, SCR))
def calibrate(spark: SparkSession, sf: str) -> DataFrame:
    from fleetgrade.workload.registry import table

    f, files, _, scr = scored(spark, sf)
    per = table(spark, sf, "labels").groupBy(F.concat(F.lit("s"), F.col("doc_id")).alias("s")).agg(F.max("quality").alias("q"))
    labels = files.withColumn("s", F.regexp_extract("path", r"(s\d+)\.sh", 1)).join(per, "s").select(
        "path",
        F.when(F.col("q") == 1, F.array(*map(F.lit, "ABC"))).otherwise(F.array(*map(F.lit, "CDE"))).alias("grades"),
        F.array(F.lit("SEC009")).alias("must"), F.array(F.lit("B105")).alias("must_not"),
    )
    return AG.calibrate(scr, f, labels)


# ---------------------------------------------------------------- explanation

_P = {c: V.points_sql(f"t_{c}") for c in dims.CATEGORIES}
_Q = {c: V.points_sql(f"t_{c} - m_{c}") for c in dims.CATEGORIES}
IMPACT_SQL = f"""
mine AS (SELECT path, tool, rule, {", ".join(f"sum(CASE WHEN category = '{c}' THEN cost ELSE 0 END) AS m_{c}" for c in dims.CATEGORIES)} FROM pen GROUP BY ALL),
tot AS (SELECT path, {", ".join(f"sum(CASE WHEN category = '{c}' THEN cost ELSE 0 END) AS t_{c}" for c in dims.CATEGORIES)} FROM pen GROUP BY ALL),
shp AS (SELECT path, tool, rule, {_SEVN}, count(*) AS occurrences, bool_or(fixable) AS fixable, arg_min(category, position) AS category FROM fnd GROUP BY ALL),
imp AS (SELECT path, tool, rule, category, severity, occurrences, fixable, round({" + ".join(f"m_{c}" for c in dims.CATEGORIES)}, 6) AS penalty,
  round({V.global_sql(_Q)} - {V.global_sql(_P)}, 6) AS gain FROM shp JOIN mine USING (path, tool, rule) JOIN tot USING (path)),
imr AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY gain DESC, penalty DESC, tool, rule) AS rank FROM imp)"""


@query("rule_impacts", w("SELECT path, tool, rule, category, severity, occurrences, fixable, penalty, gain FROM imp", PEN, IMPACT_SQL))
def rule_impacts(spark: SparkSession, sf: str) -> DataFrame:
    f, _, pen, _ = scored(spark, sf)
    return E.rule_impacts(f, pen).drop("costs", "totals", "global")


@query("order_impacts", w("SELECT path, tool, rule, rank FROM imr", PEN, IMPACT_SQL))
def order_impacts(spark: SparkSession, sf: str) -> DataFrame:
    f, _, pen, _ = scored(spark, sf)
    return E.order_impacts(E.rule_impacts(f, pen)).select("path", "tool", "rule", "rank")


@query("grade_plan")
def grade_plan(spark: SparkSession, sf: str) -> DataFrame:
    f, _, pen, _ = scored(spark, sf)
    return E.grade_plan(E.rule_impacts(f, pen), 10)


@query("quick_wins", w("SELECT f.path, f.position, round(coalesce(i.gain * CASE WHEN i.fixable THEN 1.5 ELSE 1.0 END, 0), 6) AS worth FROM fnd f LEFT JOIN imp i USING (path, tool, rule)", PEN, IMPACT_SQL))
def quick_wins(spark: SparkSession, sf: str) -> DataFrame:
    f, _, pen, _ = scored(spark, sf)
    return E.quick_wins(f, E.rule_impacts(f, pen)).select("path", "position", F.coalesce("worth", F.lit(0.0)).alias("worth"))


@query("tool_status", w("SELECT tool, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'failed') AS failed, sum(findings)::BIGINT AS findings FROM runs GROUP BY tool", RUNS_SQL))
def tool_status(spark: SparkSession, sf: str) -> DataFrame:
    from fleetgrade.sources.tools import tool_status as status

    return status(_runs(spark, sf)).select("tool", "ok", "missing", "failed", "findings")
