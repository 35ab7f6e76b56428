"""Queries that compare two runs. The runs are overlapping halves of the event findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.operators import compare as CP
from fleetgrade.operators import scoring as AG
from fleetgrade.workload import event_views as V
from fleetgrade.workload.registry import query, table

w = V.with_findings


def _run(spark: SparkSession, sf: str, where: str) -> DataFrame:
    mark = F.concat_ws("|", "tool", "rule", (F.col("line") % 4).cast("string"))
    return V.findings(spark, sf, where).withColumn("fingerprint", F.when(F.col("line") != 3, mark))


def before(spark: SparkSession, sf: str) -> DataFrame:
    """The earlier run: its files are stored under another root."""
    return _run(spark, sf, "event_id % 3 <> 0").withColumn(
        "path", F.when(F.length("path") % 2 == 0, F.concat(F.lit("./old/../"), "path")).otherwise(F.concat(F.lit("base/"), "path"))
    )


def after(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, sf, "event_id % 5 <> 0 or value >= 30")


RUN_SQL = """
bef AS (SELECT * REPLACE (CASE WHEN length(path) % 2 = 0 THEN './old/../' || path ELSE 'base/' || path END AS path), path AS norm,
  CASE WHEN line <> 3 THEN tool || '|' || rule || '|' || (line % 4) END AS fp FROM fnd WHERE position % 3 <> 0),
aft AS (SELECT *, CASE WHEN line <> 3 THEN tool || '|' || rule || '|' || (line % 4) END AS fp FROM fnd WHERE position % 5 <> 0 OR sev < 3),
bfl AS (SELECT path, norm, count(*) * 3 AS code_lines FROM bef GROUP BY ALL),
afl AS (SELECT path, count(*) * 3 AS code_lines FROM aft GROUP BY ALL),
mat AS (SELECT a.path, coalesce(b.path, CASE WHEN n.c = 1 THEN n.p END) AS entry FROM afl a
  LEFT JOIN (SELECT path, norm FROM bfl WHERE length(norm) % 2 = 0) b ON b.norm = a.path
  LEFT JOIN (SELECT regexp_extract(path, '([^/]*)$', 1) AS bn, count(*) AS c, min(path) AS p FROM bfl GROUP BY 1) n ON n.bn = regexp_extract(a.path, '([^/]*)$', 1))"""


def _files(f: DataFrame) -> DataFrame:
    return f.groupBy("path").agg((F.count("*") * 3).alias("code_lines"))


@query("match_baseline", w("SELECT path, entry FROM mat", RUN_SQL))
def match_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return CP.match_baseline(_files(after(spark, sf)), _files(before(spark, sf)))


DIFF_SQL = """
num AS (SELECT m.path, fp, count(*) AS a FROM aft JOIN mat m USING (path) WHERE entry IS NOT NULL GROUP BY ALL),
old AS (SELECT m.path, fp, count(*) AS b FROM bef JOIN mat m ON m.entry = bef.path WHERE fp IS NOT NULL GROUP BY ALL),
cmp AS (SELECT path, sum(greatest(coalesce(a, 0) - coalesce(b, 0), 0))::BIGINT AS new, sum(greatest(coalesce(b, 0) - coalesce(a, 0), 0))::BIGINT AS fixed,
  sum(least(coalesce(a, 0), coalesce(b, 0)))::BIGINT AS unchanged FROM num FULL JOIN old USING (path, fp) GROUP BY path)"""
_BSCR = (V.penalty_sql("bef", "bpen", "bfl"), V.score_sql("bpen", "bscr", "bfl"))
_ASCR = (V.penalty_sql("aft", "apen", "afl"), V.score_sql("apen", "ascr", "afl"))


def _scores(f: DataFrame) -> DataFrame:
    files = _files(f)
    return AG.script_scores(files, AG.rule_penalties(f, files))


def _diff(spark: SparkSession, sf: str) -> DataFrame:
    b, a = before(spark, sf), after(spark, sf)
    return CP.diff_baseline(a, b, CP.match_baseline(_files(a), _files(b)), _scores(b))


@query("diff_baseline", w("""SELECT m.path, m.entry, s."global" AS previous, coalesce(new, 0) AS new, coalesce(fixed, 0) AS fixed, coalesce(unchanged, 0) AS unchanged
 FROM mat m LEFT JOIN cmp USING (path) LEFT JOIN bscr s ON s.path = m.entry WHERE m.entry IS NOT NULL""", RUN_SQL, DIFF_SQL, *_BSCR))
def diff_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return _diff(spark, sf)


@query("multiset_states", w("""SELECT a.position, CASE WHEN fp IS NOT NULL AND n <= coalesce(c, 0) THEN 'unchanged' ELSE 'new' END AS state FROM
 (SELECT *, row_number() OVER (PARTITION BY path, fp ORDER BY position) AS n FROM aft) a
 LEFT JOIN (SELECT norm AS path, fp, count(*) AS c FROM bef GROUP BY ALL) b USING (path, fp)""", RUN_SQL))
def multiset_states(spark: SparkSession, sf: str) -> DataFrame:
    b = _run(spark, sf, "event_id % 3 <> 0")
    return CP.multiset_states(b, after(spark, sf), ["path"], "fingerprint").select("position", "state")


@query("score_delta", w("SELECT a.path, " + ", ".join(f'round(round(a."{c}" - b."{c}", 6) * 10) / 10 AS {c}_delta' for c in ("global", *dims.CATEGORIES))
  + " FROM ascr a JOIN b2scr b USING (path)", RUN_SQL, *_ASCR,
  "b2 AS (SELECT * REPLACE (norm AS path) FROM bef)", "b2f AS (SELECT norm AS path, code_lines FROM bfl)",
  V.penalty_sql("b2", "b2pen", "b2f"), V.score_sql("b2pen", "b2scr", "b2f")))
def score_delta(spark: SparkSession, sf: str) -> DataFrame:
    return CP.score_delta(_scores(_run(spark, sf, "event_id % 3 <> 0")), _scores(after(spark, sf)))


@query("tighten_baseline", w("""SELECT path, position FROM bef WHERE path NOT IN (SELECT entry FROM chosen)
 UNION ALL SELECT c.entry AS path, a.position FROM aft a JOIN chosen c USING (path)""", RUN_SQL, DIFF_SQL,
 "chosen AS (SELECT m.entry, max(m.path) AS path FROM mat m JOIN cmp USING (path) WHERE m.entry IS NOT NULL AND new = 0 AND fixed > 0 GROUP BY m.entry)"))
def tighten_baseline(spark: SparkSession, sf: str) -> DataFrame:
    b, a = before(spark, sf), after(spark, sf)
    return CP.tighten_baseline(b, _diff(spark, sf), a).select("path", "position")


@query("tighten_counts", w("""SELECT count(*) FILTER (new = 0 AND fixed > 0) AS updated, coalesce(sum(CASE WHEN new = 0 THEN fixed END), 0)::BIGINT AS removed,
 count(*) FILTER (new > 0) AS refused FROM cmp""", RUN_SQL, DIFF_SQL))
def tighten_counts(spark: SparkSession, sf: str) -> DataFrame:
    return CP.tighten_counts(_diff(spark, sf))


# Two listings of customers as file paths, with moved roots.
def _listing(spark: SparkSession, sf: str, side: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_custkey % 10 <> 3" if side == "base" else "c_custkey % 8 <> 5")
    a, b = (F.col("c_custkey") % 2, F.col("c_custkey") % 7) if side == "base" else ((F.col("c_custkey") + 1) % 3, F.col("c_custkey") % 5)
    root = F.when(F.col("c_custkey") % 9 == 0, "same").otherwise(side)
    path = F.concat(root, F.lit("/a"), a, F.lit("/b"), b, F.lit("/t"), F.col("c_custkey") % 97 % 61, F.lit(".sh"))
    return c.groupBy(path.alias("path")).agg(F.min("c_custkey").alias("ord"))


LISTING_SQL = """
bli AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'same' ELSE 'base' END || '/a' || (c_custkey % 2) || '/b' || (c_custkey % 7) || '/t' || (c_custkey % 97 % 61) || '.sh' AS path, min(c_custkey) AS ord FROM customer WHERE c_custkey % 10 <> 3 GROUP BY 1),
ali AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN 'same' ELSE 'head' END || '/a' || ((c_custkey + 1) % 3) || '/b' || (c_custkey % 5) || '/t' || (c_custkey % 97 % 61) || '.sh' AS path, min(c_custkey) AS ord FROM customer WHERE c_custkey % 8 <> 5 GROUP BY 1),
bt AS (SELECT path, ord, string_split(path, '/')[-1] AS bn, list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[-i:], '/')) AS tails FROM bli WHERE path NOT IN (SELECT path FROM ali)),
att AS (SELECT path, ord, string_split(path, '/')[-1] AS bn, list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[-i:], '/')) AS tails,
  row_number() OVER (PARTITION BY string_split(path, '/')[-1] ORDER BY ord) AS n FROM ali WHERE path NOT IN (SELECT path FROM bli)),
mst AS (
  SELECT bn, 0::BIGINT AS n, NULL::VARCHAR AS path, NULL::VARCHAR AS hit, (SELECT list({'p': path, 't': tails}) FROM bt WHERE bt.bn = d.bn) AS rest FROM (SELECT DISTINCT bn FROM att) d
  UNION ALL
  SELECT bn, n, path, hit, CASE WHEN hit IS NULL THEN rest ELSE list_filter(rest, lambda r: r.p <> hit) END FROM (
    SELECT bn, n, path, rest, CASE WHEN len(top) = 1 THEN top[1].p END AS hit FROM (
      SELECT bn, n, path, rest, list_filter(rest, lambda r: len(list_intersect(r.t, tails)) = best) AS top FROM (
        SELECT s.bn, a.n, a.path, a.tails, s.rest, list_max(list_transform(s.rest, lambda r: len(list_intersect(r.t, a.tails)))) AS best
        FROM mst s JOIN att a ON a.bn = s.bn AND a.n = s.n + 1)))),
prs AS (SELECT path, path AS before_path FROM ali WHERE path IN (SELECT path FROM bli) UNION ALL SELECT path, hit FROM mst WHERE n > 0)"""


@query("match_reports", "WITH RECURSIVE " + LISTING_SQL + " SELECT path, before_path FROM prs")
def match_reports(spark: SparkSession, sf: str) -> DataFrame:
    return CP.match_reports(_listing(spark, sf, "base"), _listing(spark, sf, "head"))


def _issues(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Orders of a customer are the issues of its file."""
    c = table(spark, sf, "customer")
    a, b = (F.col("o_custkey") % 2, F.col("o_custkey") % 7) if side == "base" else ((F.col("o_custkey") + 1) % 3, F.col("o_custkey") % 5)
    root = F.when(F.col("o_custkey") % 9 == 0, "same").otherwise(side)
    path = F.concat(root, F.lit("/a"), a, F.lit("/b"), b, F.lit("/t"), F.col("o_custkey") % 97 % 61, F.lit(".sh"))
    keep = "o_custkey % 10 <> 3 and o_orderkey % 4 <> 1" if side == "base" else "o_custkey % 8 <> 5 and o_orderkey % 3 <> 1"
    return table(spark, sf, "orders").filter(keep).select(
        path.alias("path"), F.substring("o_orderpriority", 1, 1).alias("rule"), (F.col("o_orderkey") % 5).alias("line"),
        F.when(F.col("o_orderkey") % 6 != 0, F.concat("o_orderpriority", "o_orderstatus")).alias("fingerprint"),
    )


_ISS = """SELECT CASE WHEN o_custkey % 9 = 0 THEN 'same' ELSE '{side}' END || '/a' || ({a}) || '/b' || (o_custkey % {b}) || '/t' || (o_custkey % 97 % 61) || '.sh' AS path,
  coalesce(CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority || o_orderstatus END, substr(o_orderpriority, 1, 1) || '@' || (o_orderkey % 5)) AS k, count(*) AS n FROM orders WHERE {keep} GROUP BY ALL"""
ISSUE_SQL = ("bis AS (" + _ISS.format(side="base", a="o_custkey % 2", b=7, keep="o_custkey % 10 <> 3 AND o_orderkey % 4 <> 1") + "), ais AS ("
             + _ISS.format(side="head", a="(o_custkey + 1) % 3", b=5, keep="o_custkey % 8 <> 5 AND o_orderkey % 3 <> 1") + """),
both_ AS (SELECT path, a.n AS a, b.n AS b FROM (SELECT ais.* FROM ais JOIN prs USING (path) WHERE before_path IS NOT NULL) a FULL JOIN
  (SELECT p.path, k, n FROM bis JOIN prs p ON p.before_path = bis.path) b USING (path, k)),
agg_ AS (SELECT path, sum(greatest(coalesce(a,0)-coalesce(b,0),0))::BIGINT AS new, sum(greatest(coalesce(b,0)-coalesce(a,0),0))::BIGINT AS fixed, sum(least(coalesce(a,0),coalesce(b,0)))::BIGINT AS unchanged FROM both_ GROUP BY path),
dif AS (SELECT path, state, coalesce(n, 0) AS n FROM (SELECT p.path, unnest(['new','fixed','unchanged']) AS state, unnest([new, fixed, unchanged]) AS n FROM prs p LEFT JOIN agg_ USING (path) WHERE before_path IS NOT NULL)
  UNION ALL SELECT path, 'added', 1 FROM prs WHERE before_path IS NULL
  UNION ALL SELECT path, 'removed', 1 FROM bli WHERE path NOT IN (SELECT before_path FROM prs WHERE before_path IS NOT NULL))""")


@query("diff_reports", "WITH RECURSIVE " + LISTING_SQL + ", " + ISSUE_SQL + " SELECT path, state, n FROM dif")
def diff_reports(spark: SparkSession, sf: str) -> DataFrame:
    b, a = _listing(spark, sf, "base"), _listing(spark, sf, "head")
    return CP.diff_reports(_issues(spark, sf, "base"), _issues(spark, sf, "head"), CP.match_reports(b, a), b)


_COMPARED = ("cmpd AS (SELECT path, coalesce(new, 0) AS new, coalesce(fixed, 0) AS fixed, coalesce(unchanged, 0) AS unchanged, "
             "round(round(a.\"global\" - b.\"global\", 6) * 10) / 10 AS delta FROM cmp JOIN mat m USING (path) JOIN ascr a USING (path) JOIN bscr b ON b.path = m.entry)")
_ALL = (RUN_SQL, DIFF_SQL, *_BSCR, *_ASCR, _COMPARED)


def compared(spark: SparkSession, sf: str) -> DataFrame:
    from fleetgrade.functions.scalars import round1

    now = _scores(after(spark, sf)).select("path", "global")
    return _diff(spark, sf).join(now, "path").select(
        "path", "new", "fixed", "unchanged", round1(F.round(F.col("global") - F.col("previous"), 6)).alias("delta")
    )


@query("triage_order", w("SELECT path, CASE WHEN delta < 0 THEN 0 WHEN new > 0 THEN 1 WHEN fixed > 0 THEN 2 ELSE 3 END AS rank, delta FROM cmpd", *_ALL))
def triage_order(spark: SparkSession, sf: str) -> DataFrame:
    return CP.triage_order(compared(spark, sf)).select("path", "rank", "delta")


@query("changed_only", w("SELECT * FROM cmpd WHERE new > 0 OR fixed > 0 OR delta <> 0", *_ALL))
def changed_only(spark: SparkSession, sf: str) -> DataFrame:
    return CP.changed_only(compared(spark, sf))


@query("diff_summary", w("""SELECT count(*) AS files, sum(new)::BIGINT AS new, sum(fixed)::BIGINT AS fixed, sum(unchanged)::BIGINT AS unchanged,
 count(*) FILTER (delta < 0) AS worse, count(*) FILTER (delta > 0) AS better FROM cmpd""", *_ALL))
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return CP.diff_summary(compared(spark, sf))


@query("average_change", w("""SELECT round(round(avg(b."global"), 6) * 10) / 10 AS before, round(round(avg(a."global"), 6) * 10) / 10 AS after, count(*) AS files
 FROM ascr a JOIN mat m USING (path) JOIN bscr b ON b.path = m.entry""", *_ALL))
def average_change(spark: SparkSession, sf: str) -> DataFrame:
    b, a = before(spark, sf), after(spark, sf)
    pairs = CP.match_baseline(_files(a), _files(b)).filter("entry is not null")
    moved = _scores(b).withColumnRenamed("path", "entry").join(pairs, "entry").select("path", "global")
    return CP.average_change(moved, _scores(a))


_STATES = """sta AS (SELECT a.path, a.sev, CASE WHEN fp IS NOT NULL AND n <= coalesce(c, 0) THEN 'unchanged' ELSE 'new' END AS state FROM
 (SELECT *, row_number() OVER (PARTITION BY path, fp ORDER BY position) AS n FROM aft) a
 LEFT JOIN (SELECT norm AS path, fp, count(*) AS c FROM bef GROUP BY ALL) b USING (path, fp))"""


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return CP.multiset_states(_run(spark, sf, "event_id % 3 <> 0"), after(spark, sf), ["path"], "fingerprint")


@query("gate_thresholds", w("""SELECT path, 'global < 7.0' AS reason FROM ascr WHERE "global" < 7 UNION ALL SELECT path, 'security < 8.0' FROM ascr WHERE security < 8
 UNION ALL SELECT DISTINCT path, 'new high' FROM sta WHERE state = 'new' AND sev <= 1""", RUN_SQL, *_ASCR, _STATES))
def gate_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return CP.gate_thresholds(_scores(after(spark, sf)), _states(spark, sf), {"global": 7.0, "security": 8.0}, "high")


@query("gate_diff", w("""SELECT path, 'lower score' AS reason FROM cmpd WHERE delta < 0 UNION ALL SELECT DISTINCT path, 'new critical' FROM sta WHERE state = 'new' AND sev = 0""", *_ALL, _STATES))
def gate_diff(spark: SparkSession, sf: str) -> DataFrame:
    deltas = compared(spark, sf).withColumnRenamed("delta", "global_delta")
    return CP.gate_diff(deltas, _states(spark, sf), "critical")


_LI = "CAST(l_partkey % 50 AS VARCHAR) || l_returnflag || l_linestatus"


@query("multiset_at_volume", f"""WITH b AS (SELECT l_orderkey % 1000 AS path, {_LI} AS item, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL),
 a AS (SELECT l_orderkey % 1000 AS path, {_LI} AS item, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY ALL)
 SELECT path, sum(greatest(coalesce(a.n,0)-coalesce(b.n,0),0))::BIGINT AS new, sum(greatest(coalesce(b.n,0)-coalesce(a.n,0),0))::BIGINT AS fixed,
 sum(least(coalesce(a.n,0),coalesce(b.n,0)))::BIGINT AS unchanged FROM a FULL JOIN b USING (path, item) GROUP BY path""")
def multiset_at_volume(spark: SparkSession, sf: str) -> DataFrame:
    """Two overlapping halves of ``lineitem`` compared as multisets."""
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 1000).alias("path"), "l_linenumber",
        F.concat((F.col("l_partkey") % 50).cast("string"), "l_returnflag", "l_linestatus").alias("fingerprint"), F.lit("x").alias("rule"), F.lit(1).alias("line"),
    )
    counts = li.groupBy("path", "fingerprint").agg(
        F.count_if(F.col("l_linenumber") % 3 != 0).alias("a"), F.count_if(F.col("l_linenumber") % 2 == 0).alias("b")
    ).filter("a > 0 or b > 0")
    return counts.groupBy("path").agg(
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("new"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("fixed"),
        F.sum(F.least("a", "b")).alias("unchanged"),
    )
