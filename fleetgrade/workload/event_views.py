"""Findings, files and lines that Spark derives from the ``events`` table, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.operators.findings import EDIT
from fleetgrade.workload.registry import table

TOOLS = ("shellcheck", "bandit", "ruff", "builtin", "gitleaks")
RULES = ("SEC002", "SEC005", "SEC009", "ROB005", "MNT001", "PERF001", "SC2164", "SC2002", "S105", "B105", "SYNTAX", "SEC022")
EQUIVALENTS = ((), ("SEC*",), (), ("SC2164",), ("E501",), ("SC2002",), (), (), ("B105",), ("S105", "SEC002"), ("SYNTAX",), ("SEC002", "GL*"))


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def findings(spark: SparkSession, sf: str, where: str = "true") -> DataFrame:
    """Each event read as one finding."""
    ev = table(spark, sf, "events").filter(where)
    rules = F.array(*[F.lit(r) for r in RULES])
    eqs = F.array(*[F.array(*[F.lit(e) for e in es]).cast("array<string>") for es in EQUIVALENTS])
    line = (F.col("event_id") * 7 % 15).cast("int")
    edit = F.struct(
        line.alias("line"), F.lit(1).alias("column"), (line + F.col("event_id") % 2).cast("int").alias("end_line"),
        F.lit(3).alias("end_column"), F.lit("x").alias("replacement"), F.element_at(rules, _k() % 12 + 1).alias("rule"),
    ).cast(EDIT)
    return ev.select(
        F.concat(F.lit("r"), F.col("user_id") % 12, F.lit("/d"), F.col("user_id") % 5, F.lit("/s"), F.col("user_id") * 10 + F.col("event_id") % 7, F.lit(".sh")).alias("path"),
        F.concat(F.lit("r"), F.col("user_id") % 12).alias("repo"),
        F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.col("event_id") % 5 + 1).cast("int")).alias("tool"),
        F.element_at(rules, _k() % 12 + 1).alias("rule"),
        F.element_at(F.array(*[F.lit(c) for c in dims.CATEGORIES]), (_k() % 5 + 1).cast("int")).alias("category"),
        F.when(F.col("value") >= 95, "critical").when(F.col("value") >= 70, "high").when(F.col("value") >= 30, "medium").otherwise("low").alias("severity"),
        line.alias("line"),
        F.when(F.col("event_id") % 3 == 0, line + F.col("event_id") % 9).cast("int").alias("end_line"),
        F.concat(F.col("event_type"), F.lit(" by user "), F.col("user_id")).alias("message"),
        F.lit(None).cast("string").alias("hint"),
        F.lit(None).cast("string").alias("url"),
        F.element_at(eqs, _k() % 12 + 1).alias("equivalents"),
        F.when(_k() % 4 == 0, F.array(F.concat(F.lit("CWE-"), _k()), F.lit("OWASP A08:2021"))).otherwise(F.array().cast("array<string>")).alias("refs"),
        F.when(F.col("event_id") % 6 == 0, F.array(edit)).otherwise(F.array().cast(f"array<{EDIT}>")).alias("edits"),
        F.col("event_id").alias("position"),
        "ts",
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    return findings(spark, sf).groupBy("path", "repo").agg((F.count("*") * 3).alias("code_lines")).select(
        "path", "repo", "code_lines", F.when(F.col("code_lines") % 2 == 0, "bash").otherwise("python").alias("dialect")
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    ev = findings(spark, sf).filter("line > 0")
    word = F.regexp_extract("message", r"^(\w+)", 1)
    return ev.groupBy("path", "line").agg(
        F.concat(F.lit("  "), F.min(word), F.lit("   v"), (F.min("position") % 3).cast("string"), F.lit(" ")).alias("raw")
    )


def _array(values, kind: str = "VARCHAR") -> str:
    return "([" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + f"]::{kind}[])"


FINDINGS_SQL = f"""
ev0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(event_id * 7 % 15 AS INTEGER) AS ln FROM events),
fnd AS (SELECT 'r' || (user_id % 12) || '/d' || (user_id % 5) || '/s' || (user_id * 10 + event_id % 7) || '.sh' AS path,
  'r' || (user_id % 12) AS repo,
  {_array(TOOLS)}[event_id % 5 + 1] AS tool,
  CAST(event_id % 5 AS INTEGER) AS tool_ix,
  {_array(RULES)}[k % 12 + 1] AS rule,
  {_array(dims.CATEGORIES)}[k % 5 + 1] AS category,
  CASE WHEN value >= 95 THEN 'critical' WHEN value >= 70 THEN 'high' WHEN value >= 30 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN value >= 95 THEN 0 WHEN value >= 70 THEN 1 WHEN value >= 30 THEN 2 ELSE 3 END AS sev,
  ln AS line,
  CASE WHEN event_id % 3 = 0 THEN CAST(ln + event_id % 9 AS INTEGER) END AS end_line,
  event_type || ' by user ' || user_id AS message, event_type,
  ([{",".join(_array(e) for e in EQUIVALENTS)}])[k % 12 + 1] AS equivalents,
  CASE WHEN k % 4 = 0 THEN ['CWE-' || k, 'OWASP A08:2021'] ELSE []::VARCHAR[] END AS refs,
  event_id % 6 = 0 AS fixable, event_id % 2 AS edit_extra,
  event_id AS position, ts, k FROM ev0),
fls AS (SELECT path, repo, count(*) * 3 AS code_lines, CASE WHEN count(*) * 3 % 2 = 0 THEN 'bash' ELSE 'python' END AS dialect FROM fnd GROUP BY path, repo),
lns AS (SELECT path, line, '  ' || min(event_type) || '   v' || (min(position) % 3) || ' ' AS raw FROM fnd WHERE line > 0 GROUP BY path, line)
"""

_W = {"security": 1.5, "robustness": 1.25, "maintainability": 1.0, "portability": 0.75, "performance": 0.5}


def penalty_sql(src: str = "fnd", out: str = "pen", files_cte: str = "fls") -> str:
    return f"""{out} AS (SELECT c.path, c.category, c.tool, c.rule, c.severity, c.n,
  round((CASE c.severity WHEN 'critical' THEN 4.0 WHEN 'high' THEN 2.0 WHEN 'medium' THEN 0.75 ELSE 0.25 END)::DOUBLE * (1 + log2(c.n)) *
    CASE WHEN c.severity IN ('critical', 'high') THEN 1.0 ELSE sqrt(100.0::DOUBLE / greatest(100, coalesce(f.code_lines, 0))) END, 9) AS cost
  FROM (SELECT path, category, tool, rule, severity, count(*) AS n FROM {src} GROUP BY ALL) c LEFT JOIN {files_cte} f USING (path))"""


def points_sql(x: str) -> str:
    return f"round(greatest(0.0::DOUBLE, least(10.0::DOUBLE, 10.0 - round({x}, 6))) * 10) / 10"


def global_sql(cols: dict[str, str]) -> str:
    mean = " + ".join(f"({v}) * {_W[c]}" for c, v in cols.items())
    return f"round(round(least(({mean}) / 5.0, least({', '.join(cols.values())}) + 1.5), 6) * 10) / 10"


def score_sql(pen: str = "pen", out: str = "scr", files_cte: str = "fls") -> str:
    cats = ", ".join(
        points_sql(f"coalesce(sum(CASE WHEN p.category = '{c}' THEN p.cost END), 0)") + f" AS {c}" for c in dims.CATEGORIES
    )
    return f"""{out}0 AS (SELECT f.path, {cats} FROM {files_cte} f LEFT JOIN {pen} p USING (path) GROUP BY f.path),
{out}1 AS (SELECT *, {global_sql({c: c for c in dims.CATEGORIES})} AS "global" FROM {out}0),
{out} AS (SELECT *, CASE WHEN "global" >= 9 THEN 'A' WHEN "global" >= 7.5 THEN 'B' WHEN "global" >= 6 THEN 'C' WHEN "global" >= 4 THEN 'D' ELSE 'E' END AS grade FROM {out}1)"""


def with_findings(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([FINDINGS_SQL, *ctes]) + " " + body
