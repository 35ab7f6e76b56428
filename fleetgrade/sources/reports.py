"""Stored reports, feedback logs, history and labels as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.functions import scalars as S

_EDIT = "struct<line:string,column:string,endLine:string,endColumn:string,replacement:string,rule:string>"
_FINDING = (
    "struct<tool:string,rule:string,category:string,severity:string,line:string,endLine:string,column:string,message:string,snippet:string,"
    f"hint:string,url:string,fingerprint:string,equivalents:array<string>,refs:array<string>,edits:array<{_EDIT}>>"
)
REPORT = (
    "struct<file:string,dialect:string,lines:struct<total:string,code:string,comments:string>,date:string,profile:string,"
    "global:struct<score:string,grade:string>,categories:array<struct<category:string,score:string,total:string,critical:string,high:string,medium:string,low:string>>,"
    f"suppressed:string,findings:array<{_FINDING}>>"
)


def parse_reports(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Reports and their findings from JSON documents; documents of another shape are left out.

    A report of a huge file may come in parts: the parts share the path.
    """
    doc = F.from_json(column, f"struct<reports:array<{REPORT}>>")
    reports = raw.select(F.explode(doc["reports"]).alias("r")).filter("r.file is not null")

    def named(category: str) -> Column:
        return F.filter("r.categories", lambda x: x["category"] == category)

    score = {c: named(c) for c in dims.CATEGORIES}
    heads = reports.select(
        F.col("r.file").alias("path"), F.col("r.dialect").alias("dialect"), F.col("r.profile").alias("profile"), S.json_int(F.col("r.lines.code")).alias("code_lines"),
        F.coalesce(S.json_double(F.col("r.global.score")), F.lit(0.0)).alias("global"), F.col("r.global.grade").alias("grade"),
        *[F.coalesce(S.json_double(F.try_element_at(v, F.lit(1))["score"]), F.lit(0.0)).alias(c) for c, v in score.items()]).dropDuplicates(["path"])
    f = reports.select(F.col("r.file").alias("path"), F.posexplode("r.findings").alias("position", "f"))
    edits = F.transform("f.edits", lambda e: F.struct(*[S.json_int(e[n]).alias(m) for n, m in (("line", "line"), ("column", "column"), ("endLine", "end_line"), ("endColumn", "end_column"))],
                                                      e["replacement"].alias("replacement"), e["rule"].alias("rule")))
    findings = f.select(
        "path", *[F.col(f"f.{n}").alias(n) for n in ("tool", "rule", "category", "severity", "message", "snippet", "hint", "url", "fingerprint", "equivalents", "refs")],
        F.coalesce(S.json_int(F.col("f.line")), F.lit(0)).alias("line"), S.json_int(F.col("f.endLine")).alias("end_line"), S.json_int(F.col("f.column")).alias("column"),
        edits.alias("edits"), F.col("position").cast("bigint").alias("position"))
    return heads, findings


def rejected_reports(raw: DataFrame, column: str = "value") -> DataFrame:
    """Documents that are no report."""
    return raw.filter(F.from_json(column, f"struct<reports:array<{REPORT}>>")["reports"].isNull())


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON document per line, or one per file."""
    return parse_reports(spark.read.text(path, wholetext=False))


FALSE_POSITIVE = "struct<date:string,tool:string,rule:string,message:string,comment:string,line:string,context:array<string>>"


def parse_false_positives(raw: DataFrame, column: str = "value") -> DataFrame:
    """Feedback log, a JSON object per line; unreadable lines are left out."""
    d = raw.select(F.from_json(column, FALSE_POSITIVE).alias("d")).filter("d.tool is not null and d.rule is not null")
    return d.select(F.col("d.date").try_cast("timestamp").alias("ts"), "d.tool", "d.rule", "d.message", "d.comment", S.json_int(F.col("d.line")).alias("line"), "d.context")


def read_false_positives(spark: SparkSession, path: str) -> DataFrame:
    return parse_false_positives(spark.read.text(path))


HISTORY = "struct<folder:string,date:string,average:string,scripts:string,grades:map<string,int>,scores:map<string,double>>"


def parse_history(raw: DataFrame, column: str = "value") -> DataFrame:
    """History entries, oldest first; unreadable entries are left out."""
    d = raw.select(F.from_json(column, HISTORY).alias("d")).filter(F.col("d.date").try_cast("timestamp").isNotNull())
    return d.select("d.folder", F.col("d.date").try_cast("timestamp").alias("ts"), S.json_double(F.col("d.average")).alias("average"),
                    S.json_int(F.col("d.scripts")).alias("scripts"), "d.grades", "d.scores").orderBy("folder", "ts")


def read_history(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    out = parse_history(spark.read.text(path))
    return out.filter(F.col("folder") == folder) if folder else out


LABELS = "path string, grades array<string>, default_grades array<string>, contexts array<string>, must array<string>, must_not array<string>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Expected grades and rules per file, a JSON object per line."""
    none = F.array().cast("array<string>")
    return spark.read.schema(LABELS).json(path).select(
        "path", "grades", F.coalesce("default_grades", "grades").alias("default_grades"), *[F.coalesce(c, none).alias(c) for c in ("contexts", "must", "must_not")])
