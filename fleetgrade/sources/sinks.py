"""Exports. A document of a file with very many findings is cut into parts, so no row grows without bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.functions import scalars as S
from fleetgrade.operators.lines import anonymize
from fleetgrade.operators.prefix import occurrence

PART = 10000


def _parts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Assign findings to document parts of about ``PART`` rows, with their order ``_n`` in a part.

    A file is cut along its lines. When a document covers many files, whole files go to parts by
    a hash over as many parts as the document needs, so no window ever spans a repository.
    """
    rank = dims.category_rank(F.col("category")) * 4 + dims.severity_rank(F.col("severity"))
    group = list(dict.fromkeys([*keys, "path"]))
    numbered = occurrence(findings, group, "line", tie=["tool", "rule", "position"], name="_row")
    cut_at = F.floor((F.col("_row") - 1) / PART).cast("int")
    order = F.struct(rank.alias("rank"), "path", "line", "tool", "rule", "position")
    if keys == ["path"]:
        return numbered.withColumn("part", cut_at).withColumn("_n", order).drop("_row")
    parts = findings.groupBy(*keys).agg(F.ceil(F.count("*") / PART).alias("_parts"))
    bucket = F.pmod(F.xxhash64("path"), F.col("_parts"))
    return numbered.join(parts, keys).withColumn("part", bucket * F.lit(1 << 31) + cut_at).withColumn("_n", order).drop("_row", "_parts")


def uri(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def reports_json(files: DataFrame, scores: DataFrame, findings: DataFrame, tool: str = "fleetgrade") -> DataFrame:
    """One JSON document per file and part: (path, part, value)."""
    f = F.struct("tool", "rule", "category", "severity", "line", F.col("end_line").alias("endLine"), "column", "message", "snippet", "hint", "url", "fingerprint", "refs",
                 F.transform("edits", lambda e: F.struct(e["line"].alias("line"), e["column"].alias("column"), e["end_line"].alias("endLine"), e["end_column"].alias("endColumn"),
                                                        e["replacement"].alias("replacement"), e["rule"].alias("rule"))).alias("edits"))
    grouped = _parts(findings, ["path"]).groupBy("path", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", f.alias("f")))), lambda s: s["f"]).alias("findings"))
    head = files.select("path", "dialect", "code_lines").join(scores, "path").join(grouped, "path", "left")
    report = F.struct(
        F.col("path").alias("file"), "dialect", F.struct(F.col("code_lines").alias("code")).alias("lines"), F.struct(F.col("global").alias("score"), "grade").alias("global"),
        F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in dims.CATEGORIES]).alias("categories"),
        F.coalesce("findings", F.array()).alias("findings"))
    return head.select("path", F.coalesce("part", F.lit(0)).cast("bigint").alias("part"), F.to_json(F.struct(F.lit(tool).alias("tool"), F.array(report).alias("reports"))).alias("value"))


def write_reports_json(documents: DataFrame, path: str) -> None:
    documents.select("value").write.mode("overwrite").text(path)


# Names of the severities in the export formats.
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
SARIF_SCORE = {"critical": "9.5", "high": "7.5", "medium": "5.0", "low": "2.0"}
QUALITY_SEVERITY = {"critical": "blocker", "high": "critical", "medium": "major", "low": "minor"}
QUALITY_CATEGORY = {"security": "Security", "robustness": "Bug Risk", "maintainability": "Style", "portability": "Compatibility", "performance": "Performance"}
ANNOTATION = {"critical": "error", "high": "error", "medium": "warning", "low": "notice"}


def _described() -> Column:
    return F.concat("message", F.when(F.col("hint").isNotNull(), F.concat(F.lit(" — "), "hint")).otherwise(""))


def sarif(findings: DataFrame, keys: tuple[str, ...] = ("repo",), name: str = "fleetgrade") -> DataFrame:
    """SARIF documents per repository and part: (keys, part, value); each part names its own rules."""
    key = list(keys)
    level = dims.literal_map(SARIF_LEVEL)[F.col("severity")]
    rule_id = F.concat_ws("/", "tool", "rule")
    at = F.greatest("line", F.lit(1))
    place = F.struct(F.struct(
        F.struct(uri(F.col("path")).alias("uri")).alias("artifactLocation"),
        F.struct(at.alias("startLine"), F.when(F.col("column") > 0, F.col("column")).alias("startColumn"),
                 F.when((F.col("line") > 0) & F.col("snippet").isNotNull(), F.struct(F.col("snippet").alias("text"))).alias("snippet")).alias("region")).alias("physicalLocation"))
    change = F.transform("edits", lambda e: F.struct(
        F.struct(e["line"].alias("startLine"), e["column"].alias("startColumn"), e["end_line"].alias("endLine"), e["end_column"].alias("endColumn")).alias("deletedRegion"),
        F.struct(e["replacement"].alias("text")).alias("insertedContent")))
    fixes = F.when(F.size("edits") > 0, F.array(F.struct(
        F.struct(F.coalesce("hint", "message").alias("text")).alias("description"),
        F.array(F.struct(F.struct(uri(F.col("path")).alias("uri")).alias("artifactLocation"), change.alias("replacements"))).alias("artifactChanges"))))
    result = F.struct(
        rule_id.alias("ruleId"), level.alias("level"), F.struct(_described().alias("text")).alias("message"), F.array(place).alias("locations"),
        F.when(F.col("fingerprint").isNotNull(), F.create_map(F.lit("lineHash/v1"), F.col("fingerprint"))).alias("partialFingerprints"), fixes.alias("fixes"),
        F.struct("severity", "category", "tool").alias("properties"))
    tags = F.concat(F.array("category", "tool"), F.transform("refs", lambda r: F.when(F.startswith(r, F.lit("CWE-")), F.concat(F.lit("external/cwe/"), F.lower(r))).otherwise(r)))
    rule = F.struct(
        rule_id.alias("id"), F.col("rule").alias("name"), F.struct(F.col("message").alias("text")).alias("shortDescription"), F.col("url").alias("helpUri"),
        F.struct(level.alias("level")).alias("defaultConfiguration"),
        F.struct("category", tags.alias("tags"), F.when(F.col("category") == "security", dims.literal_map(SARIF_SCORE)[F.col("severity")]).alias("security-severity")).alias("properties"))
    numbered = _parts(findings, key)
    # Distinct rules first, from the earliest finding of each; then the arrays of a bounded part.
    rules = numbered.groupBy(*key, "part", "tool", "rule").agg(F.min_by(rule, "_n").alias("r")).groupBy(*key, "part").agg(F.array_sort(F.collect_list("r")).alias("rules"))
    results = numbered.select(*key, "part", "_n", result.alias("r")).groupBy(*key, "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", F.to_json("r").alias("j")))), lambda s: s["j"]).alias("results"))
    driver = F.struct(F.struct(F.lit(name).alias("name"), F.col("rules")).alias("driver"))
    value = F.concat(
        F.lit('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":'), F.to_json(driver),
        F.lit(',"results":['), F.array_join("results", ","), F.lit("]}]}"))
    return rules.join(results, [*key, "part"]).select(*key, "part", value.alias("value"))


def code_quality(findings: DataFrame) -> DataFrame:
    """One code-quality issue per finding: (path, value)."""
    issue = F.struct(
        F.lit("issue").alias("type"), F.concat_ws("/", "tool", "rule").alias("check_name"), _described().alias("description"),
        F.array(dims.literal_map(QUALITY_CATEGORY)[F.col("category")]).alias("categories"), dims.literal_map(QUALITY_SEVERITY)[F.col("severity")].alias("severity"),
        F.coalesce("fingerprint", F.concat_ws(":", "path", F.col("line").cast("string"), "rule")).alias("fingerprint"),
        F.struct(uri(F.col("path")).alias("path"), F.struct(F.greatest("line", F.lit(1)).alias("begin")).alias("lines")).alias("location"))
    return findings.select("path", F.to_json(issue).alias("value"))


def _xml(text: Column) -> Column:
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def junit(files: DataFrame, scores: DataFrame, findings: DataFrame) -> DataFrame:
    """A test suite per file and part; a clean file counts one passed case: (path, part, value)."""
    name = _xml(uri(F.col("path")))
    where = F.when(F.col("line") > 0, F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise("")
    line_attr = F.when(F.col("line") > 0, F.concat(F.lit(' line="'), F.col("line").cast("string"), F.lit('"'))).otherwise("")
    body = _xml(F.concat_ws("\n", F.concat("tool", F.lit(" "), "rule", F.lit(" — "), "category", F.lit(" / "), "severity"), F.concat(uri(F.col("path")), where), "snippet", "hint", "url"))
    case = F.concat(
        F.lit('<testcase classname="'), name, F.lit('" name="'), _xml(F.concat("rule", where)), F.lit('" file="'), name, F.lit('"'), line_attr, F.lit('><failure type="'), "severity",
        F.lit('" message="'), _xml(F.col("message")), F.lit('">'), body, F.lit("</failure></testcase>"))
    cases = _parts(findings, ["path"]).select("path", "part", "_n", case.alias("c")).groupBy("path", "part").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "c"))), lambda s: s["c"]), "").alias("cases"))
    suites = files.select("path").join(scores.select("path", "global", "grade"), "path").join(cases, "path", "left")
    clean = F.concat(F.lit('<testcase classname="'), name, F.lit('" name="clean"/>'))
    value = F.concat(
        F.lit('<testsuite name="'), name, F.lit('" tests="'), F.coalesce("n", F.lit(1)).cast("string"), F.lit('" failures="'), F.coalesce("n", F.lit(0)).cast("string"),
        F.lit('"><properties><property name="score" value="'), F.format_string("%.1f", "global"), F.lit('"/><property name="grade" value="'), "grade", F.lit('"/></properties>'),
        F.coalesce("cases", clean), F.lit("</testsuite>"))
    return suites.select("path", F.coalesce("part", F.lit(0)).alias("part"), value.alias("value"))


def annotations(findings: DataFrame) -> DataFrame:
    """One escaped workflow command per finding: (path, value)."""
    prop = lambda c: S.escape_command(c, prop=True)
    props = F.concat_ws(
        ",", F.concat(F.lit("file="), prop(uri(F.col("path")))), F.when(F.col("line") > 0, F.concat(F.lit("line="), F.col("line").cast("string"))),
        F.when((F.col("line") > 0) & (F.col("column") > 0), F.concat(F.lit("col="), F.col("column").cast("string"))),
        F.concat(F.lit("title="), prop(F.format_string("%s (%s, %s)", "rule", "tool", "severity"))))
    text = F.concat("message", F.when(F.col("hint").isNotNull(), F.concat(F.lit("\n"), "hint")).otherwise(""))
    return findings.select("path", F.concat(F.lit("::"), dims.literal_map(ANNOTATION)[F.col("severity")], F.lit(" "), props, F.lit("::"), S.escape_command(text)).alias("value"))


def write_lines(values: DataFrame, path: str) -> None:
    """Write the ``value`` column as text files."""
    values.select("value").write.mode("overwrite").text(path)


# Fixed value: lines of context in a feedback entry.
CONTEXT = 2


def history_entry(scores: DataFrame, keys: Column, ts: Column) -> DataFrame:
    """One history row per folder from the scores of a scan."""
    # Two levels: grades first, so that no folder gathers its files in one row.
    by_grade = scores.groupBy(keys.alias("folder"), "grade").agg(F.count("*").alias("n"), F.sum("global").alias("s"), *[F.sum(c).alias(c) for c in dims.CATEGORIES])
    total = F.sum("n")
    return by_grade.groupBy("folder").agg(
        S.round1(F.round(F.sum("s") / total, 6)).alias("average"), total.cast("int").alias("scripts"), F.map_from_entries(F.collect_list(F.struct("grade", F.col("n").cast("int")))).alias("grades"),
        F.create_map(*[x for c in dims.CATEGORIES for x in (F.lit(c), S.round1(F.round(F.sum(c) / total, 6)))]).alias("scores")).withColumn("ts", ts)


def append_history(history: DataFrame, entries: DataFrame, keep: int | None = None) -> DataFrame:
    """History with new entries; with ``keep``, the newest so many per folder stay."""
    if keep is None:
        return history.unionByName(entries)
    w = Window.partitionBy("folder").orderBy(F.desc("ts"))
    return history.unionByName(entries).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def false_positive_entries(marked: DataFrame, lines: DataFrame, secret: DataFrame | None = None) -> DataFrame:
    """Feedback rows with anonymised context, two lines around; masked lines are null.

    ``marked`` holds findings, ``secret(path, line)`` the lines that must not be copied.
    """
    near = marked.select("path", "tool", "rule", "message", "position", F.col("line").alias("at"),
                         F.explode(F.sequence(F.col("line") - CONTEXT, F.col("line") + CONTEXT)).alias("line"))
    joined = near.join(lines.select("path", "line", anonymize(F.col("raw")).alias("text")), ["path", "line"])
    if secret is not None:
        joined = joined.join(secret.select("path", "line", F.lit(True).alias("_s")).distinct(), ["path", "line"], "left").withColumn(
            "text", F.when(F.col("_s").isNull(), F.col("text")))
    return joined.groupBy("path", "tool", "rule", "message", "position", F.col("at").alias("line")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]).alias("context"))


def write_version(df: DataFrame, root: str, version: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a table under a new version folder, so that readers of the old one are not disturbed."""
    path = f"{root.rstrip('/')}/version={version}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path
