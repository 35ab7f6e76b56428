"""Scores, grades and summaries. One shuffle per level, all with partial aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.functions import scalars as S


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per file, category and severity."""
    return findings.groupBy("path", "category").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES], F.count("*").alias("total")
    )


def size_factor(code_lines: Column, reference_lines: int | Column) -> Column:
    """Medium and low penalties shrink for files longer than the reference size."""
    ref = F.lit(max(1, reference_lines)) if isinstance(reference_lines, int) else F.greatest(F.lit(1), reference_lines)
    return F.sqrt(ref.cast("double") / F.greatest(ref, code_lines))


def rule_penalties(findings: DataFrame, files: DataFrame, profile: str = "standard") -> DataFrame:
    """Cost of each (file, category, tool, rule, severity): weight × (1 + log2 n) × size factor.

    Weights and the reference size are those of the profile, or of the file where it has settings ``s``.
    """
    p = dims.PROFILES[profile]
    counts = findings.groupBy("path", "category", "tool", "rule", "severity").agg(F.count("*").alias("n"))
    own = "s" in files.columns
    weight = F.try_element_at(F.col("s.weights") if own else dims.literal_map(p["weights"]), F.col("severity"))
    factor = F.when(F.col("severity").isin("critical", "high"), F.lit(1.0)).otherwise(
        size_factor(F.coalesce("code_lines", F.lit(0)), F.col("s.reference_lines") if own else p["reference_lines"])
    )
    return (
        counts.join(files.select("path", "code_lines", *(["s"] if own else [])), "path", "left")
        .withColumn("cost", F.round(weight * (1 + F.log2("n")) * factor, 9))
        .drop("code_lines", "s")
    )


def _points(penalty: Column) -> Column:
    return S.round1(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.lit(10.0) - F.round(penalty, 6))))


def global_of(scores: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean, at most ``MAX_GAP`` above the worst category."""
    weights = weights or dims.CATEGORY_WEIGHTS
    total = sum(weights.get(c, 1.0) for c in scores)
    if total == 0:
        return F.lit(0.0)
    mean = reduce(lambda a, b: a + b, [s * F.lit(weights.get(c, 1.0)) for c, s in scores.items()]) / F.lit(total)
    return S.round1(F.round(F.least(mean, F.least(*scores.values()) + F.lit(dims.MAX_GAP)), 6))


def penalty_columns(penalties: DataFrame) -> DataFrame:
    """One row per file with the penalty sum of each category as a column."""
    return penalties.groupBy("path").agg(
        *[F.sum(F.when(F.col("category") == c, F.col("cost")).otherwise(0.0)).alias(c) for c in dims.CATEGORIES]
    )


def script_scores(files: DataFrame, penalties: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Wide scores per file: five categories, global, grade. Files without findings score 10."""
    wide = files.select("path").join(penalty_columns(penalties), "path", "left")
    for c in dims.CATEGORIES:
        wide = wide.withColumn(c, _points(F.coalesce(c, F.lit(0.0))))
    wide = wide.withColumn("global", global_of({c: F.col(c) for c in dims.CATEGORIES}, weights))
    return wide.withColumn("grade", S.grade(F.col("global")))


def category_scores(files: DataFrame, findings: DataFrame, penalties: DataFrame) -> DataFrame:
    """Long scores: every file × category, with severity counts."""
    scores = script_scores(files, penalties)
    long = scores.select(
        "path", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in dims.CATEGORIES])).alias("s")
    ).select("path", "s.*")
    counts = severity_counts(findings)
    out = long.join(counts, ["path", "category"], "left")
    return out.select(
        "path", "category", "score", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*dims.SEVERITIES, "total")]
    )


def folder_summary(scores: DataFrame, findings: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Per repository: files, shell and Python split, mean, grades, severity totals."""
    by_file = findings.groupBy("path").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES])
    joined = files.select("path", "dialect", *keys).join(scores.select("path", "global", "grade"), "path").join(by_file, "path", "left")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("files"),
        F.count_if(F.col("dialect") == "python").alias("python_files"),
        F.count_if(F.col("dialect") != "python").alias("shell_files"),
        S.round1(F.round(F.avg("global"), 6)).alias("average"),
        *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDE"],
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in dims.SEVERITIES],
    )


def script_table(scores: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    worst = findings.filter(F.col("severity").isin("critical", "high")).groupBy("path").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high")
    )
    return (
        files.select("path", "dialect").join(scores, "path").join(worst, "path", "left")
        .withColumn("critical", F.coalesce("critical", F.lit(0))).withColumn("high", F.coalesce("high", F.lit(0)))
    )


def top_rules(findings: DataFrame, limit: int = 20, unit: str = "path", keys: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent rules: occurrences, files (or repositories) affected, worst severity."""
    # Two-level distinct: a rule holding a third of all rows never lands in one task.
    fine = findings.groupBy(*keys, "tool", "rule", unit).agg(
        F.count("*").alias("n"), F.min(dims.severity_rank(F.col("severity"))).alias("r")
    )
    grouped = fine.groupBy(*keys, "tool", "rule").agg(
        F.sum("n").alias("occurrences"), F.count("*").alias("affected"), F.min("r").alias("r")
    )
    out = grouped.withColumn("severity", dims.severity_name(F.col("r"))).drop("r")
    order = [F.desc("occurrences"), "tool", "rule"]
    if not keys:
        return out.orderBy(*order).limit(limit)
    w = Window.partitionBy(*keys).orderBy(*order)
    return out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def weakest_scripts(scores: DataFrame, limit: int = 5) -> DataFrame:
    """Lowest global scores per repository (``scores`` with a ``repo`` column)."""
    w = Window.partitionBy("repo").orderBy("global", "path")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("repo", "rank", "path", "global")


def repo_dashboard(history: DataFrame, recent: int | None = None) -> DataFrame:
    """Latest scan per repository with the change since the one before and the series of its scans (the last ``recent`` if given)."""
    w = Window.partitionBy("folder").orderBy(F.desc("ts"))
    latest = history.withColumn("_n", F.row_number().over(w))
    if recent is not None:
        latest = latest.filter(F.col("_n") <= recent)
    return latest.groupBy("folder").agg(
        F.max_by("average", "ts").alias("average"),
        F.max_by("scripts", "ts").alias("scripts"),
        F.max("ts").alias("ts"),
        F.max(F.when(F.col("_n") == 2, F.col("average"))).alias("previous"),
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "average"))), lambda s: s["average"]).alias("series"),
    ).withColumn("delta", S.round1(F.col("average") - F.col("previous")))


def compliance(findings: DataFrame, titles: DataFrame) -> DataFrame:
    """Per reference: count, worst severity, files, family and title."""
    fine = findings.select("path", F.explode("refs").alias("ref"), dims.severity_rank(F.col("severity")).alias("r")).groupBy(
        "ref", "path"
    ).agg(F.count("*").alias("n"), F.min("r").alias("r"))
    out = fine.groupBy("ref").agg(F.sum("n").alias("count"), F.count("*").alias("files"), F.min("r").alias("r"))
    return (
        out.join(F.broadcast(titles), "ref", "left")
        .select("ref", S.reference_family(F.col("ref")).alias("family"), "title", "count", "files",
                dims.severity_name(F.col("r")).alias("severity"))
    )


def suggest_profile(scores: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    mean = F.round(F.avg("global"), 6)
    return scores.groupBy(*keys).agg(
        F.when(mean >= 8.5, "strict").when(mean < 6, "legacy").otherwise("standard").alias("profile")
    )


def false_positive_summary(cases: DataFrame) -> DataFrame:
    return cases.groupBy("tool", "rule").agg(F.count("*").alias("cases")).orderBy(F.desc("cases"), "tool", "rule")


def calibrate(scores: DataFrame, findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Check labelled files: grade in the allowed set, required rules seen, forbidden rules absent."""
    seen = findings.select("path", "rule").distinct()
    must = labels.select("path", F.explode("must").alias("rule")).join(seen, ["path", "rule"], "left_anti")
    missing = must.groupBy("path").agg(F.count("*").alias("missing"))
    never = labels.select("path", F.explode("must_not").alias("rule")).join(seen, ["path", "rule"], "left_semi")
    forbidden = never.groupBy("path").agg(F.count("*").alias("forbidden"))
    return (
        labels.join(scores.select("path", "global", "grade"), "path")
        .join(missing, "path", "left").join(forbidden, "path", "left")
        .select(
            "path", "global", "grade", F.array_contains("grades", F.col("grade")).alias("grade_ok"),
            F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("forbidden", F.lit(0)).alias("forbidden"),
        )
    )


def rule_histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path", F.format_string("%s(%s)", "rule", "severity").alias("label")).agg(F.count("*").alias("n"))


def run_gate_outputs(scores: DataFrame) -> DataFrame:
    """Mean score, worst grade and file count of a run."""
    return scores.agg(
        S.round1(F.round(F.avg("global"), 6)).alias("score"), F.max("grade").alias("grade"), F.count("*").alias("files")
    )
