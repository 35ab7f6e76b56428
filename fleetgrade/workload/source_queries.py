"""Queries over sources: text and script tests, ignore rules, globs, change lists, stored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.catalog import builtin_rules
from fleetgrade import catalog as RC
from fleetgrade import dims
from fleetgrade.operators import scoring as AG
from fleetgrade.sources import files as SC
from fleetgrade.session import work_folder
from fleetgrade.sources import reports as RP
from fleetgrade.sources import sinks as SK
from fleetgrade.workload import event_views as V
from fleetgrade.workload.registry import query, table


@query("scan_files", """SELECT 'b=' || (doc_id % 20) AS folder, sum(strlen(regexp_replace(text, '[\\n\\r]', ' ', 'g')) + 1)::BIGINT AS bytes, count(*) AS lines FROM documents GROUP BY ALL""")
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts written from the documents, found again with their sizes and contents."""
    root = work_folder(spark, "scan")
    d = table(spark, sf, "documents").select(F.regexp_replace("text", r"[\n\r]", " ").alias("value"), (F.col("doc_id") % 20).alias("b"))
    d.write.partitionBy("b").text(root)
    found = SC.scan_files(spark, root).filter(F.startswith("path", F.lit("b=")))
    lines = F.regexp_count(F.col("content").cast("string"), F.lit("\n"))
    return found.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.sum("length").alias("bytes"), F.sum(lines).cast("bigint").alias("lines"))


@query("write_version", "SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 2 AS BIGINT) AS version FROM orders")
def write_version(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a table beside each other: writing the second leaves the first as it is."""
    root = work_folder(spark, "versions")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    paths = [SK.write_version(o.filter(F.col("o_orderkey") % 2 == v), root, str(v), ("o_orderstatus",)) for v in (0, 1)]
    parts = [spark.read.parquet(p).select("o_orderkey", "o_orderstatus", F.lit(v).cast("bigint").alias("version")) for v, p in enumerate(paths)]
    return parts[0].unionByName(parts[1])


@query("read_labels", """SELECT 'c' || c_custkey AS path, CASE WHEN c_custkey % 2 = 0 THEN 'A B' ELSE 'C' END AS grades, CASE WHEN c_custkey % 3 = 0 THEN 'D' WHEN c_custkey % 2 = 0 THEN 'A B' ELSE 'C' END AS default_grades,
 CASE WHEN c_custkey % 5 = 0 THEN 'R' || (c_custkey % 7) ELSE '' END AS must FROM customer""")
def read_labels(spark: SparkSession, sf: str) -> DataFrame:
    root = work_folder(spark, "labels")
    k = F.col("c_custkey")
    when = lambda m, *v: F.when(k % m == 0, F.array(*[F.lit(x) if isinstance(x, str) else x for x in v]))
    table(spark, sf, "customer").select(F.to_json(F.struct(
        F.concat(F.lit("c"), k.cast("string")).alias("path"), F.coalesce(when(2, "A", "B"), F.array(F.lit("C"))).alias("grades"), when(3, "D").alias("default_grades"),
        when(5, F.concat(F.lit("R"), (k % 7).cast("string"))).alias("must"))).alias("value")).write.text(root)
    out = RP.read_labels(spark, root)
    return out.select("path", *[F.array_join(c, " ").alias(c) for c in ("grades", "default_grades", "must")])


@query("keep_text", "SELECT doc_id FROM documents WHERE doc_id % 7 <> 0")
def keep_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    broken = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    raw = d.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, broken).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return SC.keep_text(raw)[0].select(F.col("path").cast("bigint").alias("doc_id"))


@query("skipped_files", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0")
def skipped_files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    raw = d.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return SC.keep_text(raw)[1].select(F.col("path").cast("bigint").alias("doc_id"))


_NAMES = ("a.sh", "b.PY", "tool", "notes.txt", ".github/workflows/x.yml", "Makefile", "conf.yaml", "bin/.hidden", "lib.tar.gz", ".gitlab-ci.yml")
_HEADS = ("#!/bin/sh", "plain text", "#!/usr/bin/env python3", "#!/usr/bin/perl")
_NAME_SQL = "([" + ",".join(f"'{n}'" for n in _NAMES) + "])"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """One file per customer: folders, name and first line by its key."""
    k = F.col("c_custkey")
    pick = lambda xs, m: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(k / m) % len(xs) + 1).cast("int"))
    folder = F.concat(F.lit("r"), k % 5, F.when(k % 11 == 0, "/node_modules").when(k % 11 == 1, "/.cache").when(k % 11 == 2, "/build/out").when(k % 11 == 3, "/src").otherwise(""))
    return table(spark, sf, "customer").select(
        F.concat(folder, F.lit("/k"), k, F.lit("/"), pick(_NAMES, 1)).alias("path"), F.concat(pick(_HEADS, 10), F.lit("\n"), F.col("c_mktsegment"), F.lit("\n")).alias("content"), k.alias("k"))


PATH_SQL = f"""pth AS (SELECT c_custkey AS k, 'r' || (c_custkey % 5) || CASE c_custkey % 11 WHEN 0 THEN '/node_modules' WHEN 1 THEN '/.cache' WHEN 2 THEN '/build/out' WHEN 3 THEN '/src' ELSE '' END
 || '/k' || c_custkey || '/' || {_NAME_SQL}[c_custkey % 10 + 1] AS path, (['#!/bin/sh','plain text','#!/usr/bin/env python3','#!/usr/bin/perl'])[(c_custkey // 10) % 4 + 1] AS head, {_NAME_SQL}[c_custkey % 10 + 1] AS name FROM customer)"""


@query("keep_scripts", f"""WITH {PATH_SQL} SELECT path FROM pth WHERE name IN ('a.sh', 'b.PY') OR (name = 'tool' AND head IN ('#!/bin/sh', '#!/usr/bin/env python3'))
 OR (name IN ('.github/workflows/x.yml', 'Makefile', '.gitlab-ci.yml') AND head NOT LIKE '#!%') OR (name = 'Makefile' AND head IN ('#!/bin/sh', '#!/usr/bin/env python3')) OR (name = 'bin/.hidden' AND head IN ('#!/bin/sh', '#!/usr/bin/env python3'))""")
def keep_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return SC.keep_scripts(_paths(spark, sf)).select("path")


@query("drop_hidden_vendor", f"WITH {PATH_SQL} SELECT path FROM pth WHERE k % 11 NOT IN (0, 1) AND name <> 'bin/.hidden'")
def drop_hidden_vendor(spark: SparkSession, sf: str) -> DataFrame:
    return SC.drop_hidden_vendor(_paths(spark, sf)).select("path")


@query("ignore_paths", f"""WITH {PATH_SQL} SELECT path FROM pth WHERE NOT (path LIKE '%/build/%') AND NOT (path LIKE 'r1/%') AND NOT (name = 'notes.txt' AND k % 5 <> 2) AND NOT regexp_matches(path, '(^|/)k[12]4/')
 AND NOT regexp_matches(path, '^r3/(.*/)?Makefile$')""")
def ignore_paths(spark: SparkSession, sf: str) -> DataFrame:
    patterns = ("# comment", "build/", "/r1", "!r1/k6/a.sh", "*.txt", "!/r2/**/notes.txt", "k[12]4/", "r3/**/Makefile", "nothing/")
    return SC.ignore_paths(_paths(spark, sf), patterns).select("path")


# Lines of the ignore files of three repositories, of one folder in each and of the whole tree.
IGNORE_LINES = {
    "": ("# everywhere", "node_modules/", ".cache"),
    "r1": ("*.txt", "!/k1*/notes.txt", "build/", "lib.tar.gz"),
    "r2": ("/src", "k*[02468]/", "!k12/"),
    "r3": ("src/**/Makefile", "/src/k3*/tool", "*.gz", "!lib.tar.gz"),
    "r3/build": ("out/*/a.sh", "conf.yaml"),
}


@query("ignore_by_rules", f"""WITH {PATH_SQL} SELECT path FROM pth WHERE k % 11 NOT IN (0, 1) AND CASE k % 5
  WHEN 1 THEN NOT (k % 11 = 2 OR name = 'lib.tar.gz' OR (name = 'notes.txt' AND NOT regexp_matches(path, '^r1/k1[0-9]*/notes\\.txt$')))
  WHEN 2 THEN NOT (k % 11 = 3 OR (k % 2 = 0 AND k <> 12))
  WHEN 3 THEN NOT (k % 11 = 3 AND name = 'Makefile' OR regexp_matches(path, '^r3/src/k3[0-9]*/tool$') OR (k % 11 = 2 AND name IN ('a.sh', 'conf.yaml')))
  ELSE true END""")
def ignore_by_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every repository with ignore rules of its own, delivered as a table for the repositories that the files have."""
    paths = _paths(spark, sf)
    repos = paths.select(F.substring_index("path", "/", 1).alias("repo")).distinct()
    told = F.create_map(*[x for folder, lines in IGNORE_LINES.items() for x in (F.lit(folder), F.array(*[F.lit(p) for p in lines]))])
    held = repos.select(F.explode(F.array(F.lit(""), "repo", F.concat("repo", F.lit("/build")))).alias("folder")).distinct()
    rules = held.select("folder", F.posexplode(F.try_element_at(told, F.col("folder"))).alias("ord", "pattern"))
    return SC.ignore_by_rules(paths, rules).select("path")


@query("glob_targets", f"""WITH {PATH_SQL} SELECT path FROM pth WHERE (name = 'a.sh' AND k % 11 NOT IN (0, 1)) OR (path LIKE 'r2/%' AND name = 'tool' AND k % 11 NOT IN (0, 1)) OR regexp_matches(path, '^r4/k[0-9]/[^/]*\\.[Pt]..?$')""")
def glob_targets(spark: SparkSession, sf: str) -> DataFrame:
    p = _paths(spark, sf)
    one = SC.glob_targets(p, ("*.sh",), recursive=True)
    return one.unionByName(SC.glob_targets(p, ("r2/**/tool", "r4/k[0-9]/*.[Pt]??", "r4/k[0-9]/*.[Pt]?"))).select("path").distinct()


@query("changed_since", f"WITH {PATH_SQL} SELECT path FROM pth WHERE k % 6 NOT IN (2, 5)")
def changed_since(spark: SparkSession, sf: str) -> DataFrame:
    p = _paths(spark, sf)
    state = F.element_at(F.array(*[F.lit(s) for s in ("A", "M", "D", "R100", "??")]), (F.col("k") % 6 + 1).cast("int"))
    changes = p.filter("k % 6 <> 5").select("path", state.alias("state"))
    return SC.changed_since(p, changes).select("path")


@query("nearest_config", f"""WITH {PATH_SQL}, c(folder, profile) AS (SELECT 'r' || r_regionkey, r_name FROM region WHERE r_regionkey IN (1, 2, 3) UNION ALL SELECT 'r2/src', 'deep'),
 f AS (SELECT path, folder, profile, length(folder) AS d FROM pth JOIN c ON starts_with(path, folder || '/') UNION ALL SELECT path, 'r3/build', NULL, 8 FROM pth WHERE path LIKE 'r3/build/%')
 SELECT path, arg_max(CASE WHEN folder = 'r3/build' THEN 'none' ELSE profile END, d) AS profile FROM f GROUP BY path HAVING profile <> 'none'""")
def nearest_config(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region")
    configs = r.filter("r_regionkey in (1, 2, 3)").select(F.concat(F.lit("r"), "r_regionkey").alias("folder"), F.col("r_name").alias("profile")).unionByName(
        r.filter("r_regionkey = 0").select(F.lit("r2/src").alias("folder"), F.lit("deep").alias("profile")))
    roots = r.filter("r_regionkey = 3").select(F.lit("r3/build").alias("folder"))
    return SC.nearest_config(_paths(spark, sf), configs, roots).filter("profile is not null").select("path", "profile")


@query("load_profile", """SELECT o.o_orderpriority AS severity, p.name AS profile, count(*) * any_value(p.high) AS cost FROM orders o,
 (VALUES ('standard', 2.0::DOUBLE), ('strict', 3.0::DOUBLE), ('legacy', 1.5::DOUBLE)) p(name, high) GROUP BY ALL""")
def load_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The three profiles applied to counts of orders."""
    configs = None
    for name in ("standard", "strict", "legacy"):
        part = dims.load_profile(spark, name)
        configs = part if configs is None else configs.unionByName(part)
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(configs)).select("severity", "profile", (F.col("n") * F.col("weights")["high"]).alias("cost"))


# ---------------------------------------------------------------- stored documents


def report_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON report per customer, with numbers as strings now and then; every 13th is no report."""
    k = F.col("c_custkey").cast("string")
    number = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('"'), (F.col("c_custkey") % 40).cast("string"), F.lit('"'))).otherwise((F.col("c_custkey") % 40).cast("string"))
    doc = F.concat(
        F.lit('{"tool":"t","reports":[{"file":"f'), k, F.lit('","dialect":"bash","lines":{"code":'), number, F.lit('},"global":{"score":"7.5","grade":"B"},"categories":[{"category":"security","score":'),
        (F.col("c_custkey") % 10).cast("string"), F.lit('}],"findings":[{"tool":"builtin","rule":"SEC001","category":"security","severity":"high","line":'), number,
        F.lit(',"fingerprint":"x'), k, F.lit('","edits":[{"line":1,"column":"2","endLine":1,"endColumn":3,"replacement":"r","rule":"SEC001"}]},{"tool":"ruff","rule":"F401","line":0}]}]}'))
    return table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 13 == 0, '{"other": 1}').when(F.col("c_custkey") % 13 == 1, "garbage").otherwise(doc).alias("value"))


@query("read_reports", "SELECT 'f' || c_custkey AS path, CAST(c_custkey % 40 AS INTEGER) AS code_lines, 7.5::DOUBLE AS \"global\", (c_custkey % 10)::DOUBLE AS security FROM customer WHERE c_custkey % 13 > 1")
def read_reports(spark: SparkSession, sf: str) -> DataFrame:
    return RP.parse_reports(report_documents(spark, sf))[0].select("path", "code_lines", "global", "security")


@query("read_report_findings", """SELECT 'f' || c_custkey AS path, r.rule, CASE WHEN r.rule = 'SEC001' THEN CAST(c_custkey % 40 AS INTEGER) ELSE 0 END AS line, CASE WHEN r.rule = 'SEC001' THEN 'x' || c_custkey END AS fingerprint,
 CASE WHEN r.rule = 'SEC001' THEN 2 END AS edit_column FROM customer, (VALUES ('SEC001'), ('F401')) r(rule) WHERE c_custkey % 13 > 1""")
def read_report_findings(spark: SparkSession, sf: str) -> DataFrame:
    f = RP.parse_reports(report_documents(spark, sf))[1]
    return f.select("path", "rule", "line", "fingerprint", F.try_element_at("edits", F.lit(1))["column"].alias("edit_column"))


@query("rejected_reports", "SELECT CASE WHEN c_custkey % 13 = 0 THEN '{\"other\": 1}' ELSE 'garbage' END AS value FROM customer WHERE c_custkey % 13 <= 1")
def rejected_reports(spark: SparkSession, sf: str) -> DataFrame:
    return RP.rejected_reports(report_documents(spark, sf))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    doc = F.concat(F.lit('{"date":"2024-01-02T03:04:05","tool":"ruff","rule":"R'), F.col("c_custkey") % 9, F.lit('","message":"m","line":"'), F.col("c_custkey") % 30, F.lit('","context":["a",null,"b"]}'))
    return c.select(F.when(F.col("c_custkey") % 7 == 0, "not json").otherwise(doc).alias("value"))


@query("false_positive_summary", "SELECT 'ruff' AS tool, 'R' || (c_custkey % 9) AS rule, count(*) AS cases FROM customer WHERE c_custkey % 7 <> 0 GROUP BY ALL")
def false_positive_summary(spark: SparkSession, sf: str) -> DataFrame:
    return AG.false_positive_summary(RP.parse_false_positives(_log(spark, sf)))


@query("read_false_positives", "SELECT 'R' || (c_custkey % 9) AS rule, CAST(c_custkey % 30 AS INTEGER) AS line, 3 AS n FROM customer WHERE c_custkey % 7 <> 0")
def read_false_positives(spark: SparkSession, sf: str) -> DataFrame:
    return RP.parse_false_positives(_log(spark, sf)).select("rule", "line", F.size("context").alias("n"))


def history_log(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    doc = F.concat(F.lit('{"folder":"c'), F.col("o_custkey") % 40, F.lit('","date":"'), F.date_format(F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 80000), "yyyy-MM-dd'T'HH:mm:ss"),
                   F.lit('","average":"'), F.round(F.col("o_totalprice") % 10, 1), F.lit('","scripts":'), F.col("o_orderkey") % 50, F.lit(',"grades":{"A":1},"scores":{"security":5.5}}'))
    return o.select(F.when(F.col("o_orderkey") % 29 == 0, '{"folder":"c1","date":"soon"}').otherwise(doc).alias("value"))


HISTORY_SQL = """hst AS (SELECT 'c' || (o_custkey % 40) AS folder, o_orderdate + to_seconds(o_orderkey % 80000) AS ts, round(o_totalprice % 10, 1) AS average, CAST(o_orderkey % 50 AS INTEGER) AS scripts FROM orders WHERE o_orderkey % 29 <> 0)"""


@query("read_history", f"WITH {HISTORY_SQL} SELECT folder, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, average, scripts FROM hst")
def read_history(spark: SparkSession, sf: str) -> DataFrame:
    return RP.parse_history(history_log(spark, sf)).select("folder", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "average", "scripts")


@query("repo_dashboard", f"""WITH {HISTORY_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY ts DESC) AS n FROM hst)
 SELECT folder, max(CASE WHEN n = 1 THEN average END) AS average, max(CASE WHEN n = 1 THEN scripts END) AS scripts, max(CASE WHEN n = 2 THEN average END) AS previous,
 round((max(CASE WHEN n = 1 THEN average END) - max(CASE WHEN n = 2 THEN average END)) * 10) / 10 AS delta, string_agg(CAST(average AS VARCHAR), ' ' ORDER BY ts) AS series FROM n WHERE n <= 20 GROUP BY folder""")
def repo_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    out = AG.repo_dashboard(RP.parse_history(history_log(spark, sf)), 20)
    return out.select("folder", "average", "scripts", "previous", "delta", F.array_join(F.transform("series", lambda x: x.cast("string")), " ").alias("series"))


# ---------------------------------------------------------------- catalogue


@query("rule_catalog", "WITH RECURSIVE " + V.FINDINGS_SQL + " SELECT tool, rule, count(*) AS n FROM fnd GROUP BY ALL UNION ALL SELECT 'builtin', 'catalogue', 92")
def rule_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Built-in rules and those met in scans in one catalogue, with the findings of each."""
    f = V.findings(spark, sf)
    met = f.select("tool", "rule").distinct()
    full = RC.rule_catalog(builtin_rules(spark), met)
    counts = f.groupBy("tool", "rule").agg(F.count("*").alias("n"))
    return full.select("tool", "rule").distinct().join(counts, ["tool", "rule"]).unionByName(
        builtin_rules(spark).groupBy("tool").agg(F.count("*").alias("n")).select("tool", F.lit("catalogue").alias("rule"), "n"))


@query("seen_rules", "WITH RECURSIVE " + V.FINDINGS_SQL + " SELECT DISTINCT tool, rule FROM fnd WHERE NOT (tool = 'builtin' AND rule IN ('SEC002','SEC005','SEC009','ROB005','MNT001','PERF001','SEC022'))")
def seen_rules(spark: SparkSession, sf: str) -> DataFrame:
    return RC.seen_rules(V.findings(spark, sf), builtin_rules(spark))


@query("find_rule", "WITH RECURSIVE " + V.FINDINGS_SQL + " SELECT position FROM fnd WHERE rule = 'SC2164'")
def find_rule(spark: SparkSession, sf: str) -> DataFrame:
    return RC.find_rule(V.findings(spark, sf), " sc2164 ").select("position")


@query("similar_rules", "WITH RECURSIVE " + V.FINDINGS_SQL + " SELECT DISTINCT rule FROM fnd WHERE contains(rule, 'C2') OR contains(rule, '05')")
def similar_rules(spark: SparkSession, sf: str) -> DataFrame:
    f = V.findings(spark, sf)
    return RC.similar_rules(f, "c2").unionByName(RC.similar_rules(f, "05")).distinct()


@query("search_rules", "WITH RECURSIVE " + V.FINDINGS_SQL + " SELECT position, rule FROM fnd WHERE tool = 'builtin' AND category = 'security' AND contains(lower(rule || ' ' || message), 'sec0')")
def search_rules(spark: SparkSession, sf: str) -> DataFrame:
    f = V.findings(spark, sf).withColumnRenamed("message", "title")
    return RC.search_rules(f, tool="builtin", category="security", text="SEC0").select("position", "rule")
