"""Queries over derived scripts: line model, built-in shell rules, end to end scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.operators import lines as LN
from fleetgrade.operators import shell_rules as SR
from fleetgrade.session import cut
from fleetgrade.workload import script_views as V
from fleetgrade.workload.registry import dealt, query, table


def w(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([V.FILES_SQL, *ctes]) + " " + body


# ---------------------------------------------------------------- lines of the given texts


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


DOC_LINES = """dl0 AS (SELECT source || '/' || doc_id AS path, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents),
dl1 AS (SELECT path, CASE WHEN t LIKE '%' || chr(10) THEN string_split(t[:-2], chr(10)) WHEN t = '' THEN [] ELSE string_split(t, chr(10)) END AS p FROM dl0),
dln AS (SELECT path, unnest(p) AS raw, unnest(range(1, len(p) + 1)) AS line FROM dl1)"""


@query("to_lines", f"WITH {DOC_LINES} SELECT path, line, md5(raw) AS digest FROM dln")
def to_lines(spark: SparkSession, sf: str) -> DataFrame:
    return LN.to_lines(documents(spark, sf)).select("path", "line", F.md5(F.encode("raw", "UTF-8")).alias("digest"))


@query("detect_dialect", w(f"SELECT path, {V.DIALECT_CASE} AS dialect, has_crlf FROM sfl"))
def detect_dialect(spark: SparkSession, sf: str) -> DataFrame:
    return V.shell_files(spark, sf).select("path", "dialect", "has_crlf")


_HOSTS = ("x/.github/workflows/ci.yml", ".github/workflows/a.yaml", "a/action.yml", ".gitlab-ci.yml", "b/.gitlab/jobs.yml", "Dockerfile", "c/Dockerfile.dev", "app.dockerfile",
          "Makefile", "rules.mk", "play.yml", "run.sh", "x/.github/workflows/run.py", "notes.txt")


@query("detect_host_kind", f"""WITH n AS (SELECT page_id, page_id || '/' || {V._list(_HOSTS)}[page_id % {len(_HOSTS)} + 1] AS path, page_id % 5 AS v FROM pages)
 SELECT path, CASE WHEN v = 4 THEN 'makefile' WHEN v = 3 THEN NULL WHEN path LIKE '%.github/workflows/%.y%ml' OR path LIKE '%/action.yml' THEN 'github_actions'
 WHEN path LIKE '%gitlab%' THEN 'gitlab_ci' WHEN lower(path) LIKE '%dockerfile%' THEN 'dockerfile' WHEN path LIKE '%Makefile' OR path LIKE '%.mk' THEN 'makefile'
 WHEN path LIKE '%play.yml' AND v = 0 THEN 'ansible' END AS host_kind FROM n""")
def detect_host_kind(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    names = F.array(*[F.lit(h) for h in _HOSTS])
    path = F.concat(F.col("page_id").cast("string"), F.lit("/"), F.element_at(names, (F.col("page_id") % len(_HOSTS) + 1).cast("int")))
    v = F.col("page_id") % 5
    head = F.when(v == 4, "#!/usr/bin/make -f\n").when(v == 3, "#!/bin/sh\n").when(v == 0, "- hosts: all\n  tasks:\n    - shell: ls\n").otherwise("")
    return p.select(path.alias("path"), LN.detect_host_kind(path, F.concat(head, "html")).alias("host_kind"))


@query("mask_lines", w("SELECT path, line, code, regexp_replace(bare, '\"\"|\\s|\"|''', '', 'g') AS bare, in_heredoc FROM sln"))
def mask_lines(spark: SparkSession, sf: str) -> DataFrame:
    return V.lexed(spark, sf).select("path", "line", "code", F.regexp_replace("bare", r"""\s|"|'""", "").alias("bare"), "in_heredoc")


@query("count_lines", w("SELECT path, total_lines, code_lines, comment_lines FROM sfg", V.FLAGS_SQL))
def count_lines(spark: SparkSession, sf: str) -> DataFrame:
    return LN.count_lines(LN.to_lines(V.files(spark, sf)))


PY_BLOCKS = ('x = 1', '"""One line."""', '"""Two\nlines."""', "def f():\n    '''Doc\n    more\n    '''\n    return 1", "# note", "", 's = """a\nb\n"""', "r'''raw'''", "print('x')  # tail")


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    c = dealt(table(spark, sf, "customer").select("c_custkey"))
    blocks = F.array(*[F.lit(b) for b in PY_BLOCKS])
    pick = lambda m: F.element_at(blocks, (F.col("c_custkey") * m % len(PY_BLOCKS) + 1).cast("int"))
    head = F.when(F.col("c_custkey") % 2 == 0, "#!/usr/bin/env python3\n").otherwise("")
    return c.select(
        F.concat(F.lit("py/m"), F.col("c_custkey"), F.lit(".py")).alias("path"),
        F.concat(head, pick(1), F.lit("\n"), pick(4), F.lit("\n"), pick(7), F.lit("\n")).alias("content"),
    )


_KINDS = {0: (1, 0), 1: (0, 1), 2: (0, 2), 3: (2, 3), 4: (0, 1), 5: (0, 0), 6: (3, 0), 7: (0, 1), 8: (1, 0)}


@query("count_python_lines", "WITH k(i, c, d) AS (VALUES " + ",".join(f"({i},{c},{d})" for i, (c, d) in _KINDS.items())
  + ") SELECT 'py/m' || c_custkey || '.py' AS path, a.c + b.c + g.c AS code_lines, a.d + b.d + g.d AS comment_lines FROM customer "
  + " ".join(f"JOIN k {n} ON {n}.i = c_custkey * {m} % 9" for n, m in (("a", 1), ("b", 4), ("g", 7))))
def count_python_lines(spark: SparkSession, sf: str) -> DataFrame:
    return LN.count_python_lines(LN.python_lines(python_files(spark, sf))).select("path", "code_lines", "comment_lines")


@query("function_spans", w("""SELECT path, CASE WHEN raw LIKE 'greet%' THEN 'greet' WHEN raw LIKE 'big%' THEN 'big_function' ELSE 'go' END AS name, line AS start,
 CASE WHEN raw LIKE 'greet%' THEN line + 2 WHEN raw LIKE 'big%' THEN line + 14 ELSE line END AS "end", CASE WHEN raw LIKE 'greet%' THEN 3 WHEN raw LIKE 'big%' THEN 15 ELSE 1 END AS length
 FROM sln WHERE regexp_matches(raw, '^(greet\\(\\)|big_function\\(\\)|function go )')"""))
def function_spans(spark: SparkSession, sf: str) -> DataFrame:
    return LN.function_spans(V.lexed(spark, sf))


@query("secret_tokens", w("SELECT path, line, 'Zm9vYmFyQmF6MTIzNDU2Nzg5MHF3ZXJ0eQ' AS token FROM sln WHERE raw LIKE '%Zm9vYmFyQmF6MTIzNDU2Nzg5MHF3ZXJ0eQ%' AND raw NOT LIKE '%sha256%'"))
def secret_tokens(spark: SparkSession, sf: str) -> DataFrame:
    lines = LN.to_lines(V.files(spark, sf))
    found = lines.select("path", "line", F.explode(LN.secret_tokens(F.col("raw"))).alias("token"))
    return found.select("path", "line", F.regexp_replace("token", "^blob=", "").alias("token"))


@query("unpinned_installs", w("SELECT path, line, raw FROM sln WHERE raw IN ('pip install requests', 'sudo npm install -g left-pad', 'cargo install ripgrep; echo done', 'pip install --index-url https://pypi.example.org flask')"))
def unpinned_installs(spark: SparkSession, sf: str) -> DataFrame:
    return V.lexed(spark, sf).filter(LN.unpinned_install(F.col("code"))).select("path", "line", "raw")


@query("set_options", w("SELECT path, errexit, nounset, pipefail FROM sfg", V.FLAGS_SQL))
def set_options(spark: SparkSession, sf: str) -> DataFrame:
    return LN.set_options(V.files(spark, sf))


_FLAGS = ("dialect", "total_lines", "code_lines", "comment_lines", "shebang", "errexit", "nounset", "pipefail", "pipes", "sets_path", "locks", "checkout",
          "ifs_back", "traps", "mktemp_line", "functions", "tab_lines", "space_lines", "manager_line")


@query("file_flags", w("SELECT path, " + ", ".join(_FLAGS) + ", coalesce(array_to_string(managers, ','), '') AS managers FROM sfg", V.FLAGS_SQL))
def file_flags(spark: SparkSession, sf: str) -> DataFrame:
    return LN.file_flags(V.shell_files(spark, sf), V.lexed(spark, sf)).select("path", *_FLAGS, F.array_join("managers", ",").alias("managers"))


_HEAD_SQL = """shd AS (SELECT path, bool_or(ltrim(raw, E' \\t') LIKE '#%') AS head_comment FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS n
 FROM sln WHERE trim(raw, E' \\t') <> '' AND NOT (line = 1 AND raw LIKE '#!%')) WHERE n <= 3 GROUP BY path)"""


@query("head_comment", w("SELECT path, head_comment FROM shd", _HEAD_SQL))
def head_comment(spark: SparkSession, sf: str) -> DataFrame:
    return V.files(spark, sf).select("path", LN.head_comment(LN.normalized(F.col("content"))).alias("head_comment"))


@query("indent_profile", w("""SELECT path, CASE WHEN tabs > spaces THEN 0 ELSE greatest(1, least(8, coalesce(good, low, 2))) END AS indent FROM (SELECT path, any_value(tabs) AS tabs, any_value(spaces) AS spaces,
  min(w) FILTER (w > 0 AND (n >= 2 OR n * 10 >= spaces)) AS good, min(w) FILTER (w > 0) AS low FROM (
  SELECT *, sum(CASE WHEN w < 0 THEN n ELSE 0 END) OVER (PARTITION BY path) AS tabs, sum(CASE WHEN w > 0 THEN n ELSE 0 END) OVER (PARTITION BY path) AS spaces FROM (
  SELECT path, CASE WHEN raw LIKE chr(9) || '%' AND trim(raw, E' \\t') <> '' THEN -1 WHEN raw LIKE ' %' AND trim(raw) <> '' THEN length(raw) - length(ltrim(raw, E' \\t')) ELSE 0 END AS w, count(*) AS n FROM sln GROUP BY ALL)) GROUP BY path)"""))
def indent_profile(spark: SparkSession, sf: str) -> DataFrame:
    return LN.indent_profile(LN.to_lines(V.files(spark, sf)))


_ANON = r"""regexp_replace(regexp_replace({t}, '(")(?:\\.|[^"\\])*"|('')(?:\\.|[^''\\])*''', '\1\2…\1\2', 'g'), '[A-Za-z0-9+/_-]{{16,}}={{0,2}}', '…', 'g')"""


@query("anonymize", f"SELECT doc_id, md5({_ANON.format(t='text')}) AS digest FROM documents")
def anonymize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(F.encode(LN.anonymize(F.col("text")), "UTF-8")).alias("digest"))


# ---------------------------------------------------------------- rules


def _hits(spark: SparkSession, sf: str, prefix: str) -> DataFrame:
    lines = V.lexed(spark, sf)
    others = tuple({r.rule for r in SR.LINE_RULES if not r.rule.startswith(prefix)} | {"MNT001", "MNT003", "PERF004"})
    hits = SR.line_rule_hits(lines, LN.content_flags(V.shell_files(spark, sf)), others)
    return hits.groupBy("path", "line", "rule").agg(F.count("*").alias("n"))


def _family(prefix: str):
    @query(f"line_rules_{prefix.lower()}", V.line_rules_sql((prefix,)))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _hits(spark, sf, prefix)

    return run


for _prefix in ("SEC00", "SEC01", "SEC02", "ROB0", "MNT", "POR", "PERF"):
    _family(_prefix)


@query("long_lines", w("SELECT path, line, length(raw) || ' > 120' AS extra FROM sln WHERE length(raw) > 120 AND NOT in_heredoc"))
def long_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.lexed(spark, sf)
    every = tuple({r.rule for r in SR.LINE_RULES} | {"MNT003", "PERF004"})
    return SR.line_rule_hits(lines, LN.content_flags(V.shell_files(spark, sf)), every).select("path", "line", "extra")


@query("long_functions", w("SELECT path, line, 'low' AS severity FROM sln WHERE raw LIKE 'big_function()%'"))
def long_functions(spark: SparkSession, sf: str) -> DataFrame:
    return SR.function_length_hits(V.lexed(spark, sf), 10).select("path", "line", F.col("own_severity").alias("severity"))


# Block events in order; the depth is a running sum that never falls below zero.
_EVENT = r"(?:(?:^|[;&|({)!]|\b(?:then|do|else))\s*(?:if|for|while|until|case|select)\b)|(?:(?:^|[;&|)\s])(?:fi|done|esac)(?:$|[\s;&|)<>]))"
_DEPTH_SQL = f"""ev1 AS (SELECT path, line, regexp_extract_all(bare, {V._lit(_EVENT)}) AS es FROM sln WHERE NOT in_heredoc),
ev2 AS (SELECT path, line, unnest(es) AS e, unnest(range(1, len(es) + 1)) AS pos FROM ev1 WHERE len(es) > 0),
ev3 AS (SELECT *, sum(CASE WHEN regexp_matches(e, '(if|for|while|until|case|select)$') THEN 1 ELSE -1 END) OVER (PARTITION BY path ORDER BY line, pos) AS p FROM ev2),
ev4 AS (SELECT path, line, pos, CAST(p - least(0, min(p) OVER (PARTITION BY path ORDER BY line, pos)) AS INTEGER) AS depth FROM ev3),
ev5 AS (SELECT path, line, max(depth) AS top, arg_max(depth, pos) AS depth FROM ev4 GROUP BY path, line)"""


@query("nesting_depth", w("SELECT s.path, s.line, coalesce(last_value(e.depth IGNORE NULLS) OVER (PARTITION BY s.path ORDER BY s.line), 0) AS depth FROM sln s LEFT JOIN ev5 e USING (path, line)", _DEPTH_SQL))
def nesting_depth(spark: SparkSession, sf: str) -> DataFrame:
    return LN.block_depth(V.lexed(spark, sf)).select("path", "line", "depth")


@query("block_depth", w("""SELECT path, max(depth) AS deepest, count(*) FILTER (depth > 0) AS inside FROM (
  SELECT s.path, s.line, coalesce(last_value(e.depth IGNORE NULLS) OVER (PARTITION BY s.path ORDER BY s.line), 0) AS depth FROM sln s LEFT JOIN ev5 e USING (path, line)) GROUP BY path""", _DEPTH_SQL))
def block_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Deepest line and number of nested lines of each script."""
    return LN.block_depth(V.lexed(spark, sf)).groupBy("path").agg(F.max("depth").alias("deepest"), F.count_if(F.col("depth") > 0).alias("inside"))


@query("deep_blocks", w("SELECT path, line, 'MNT003' AS rule, '5' AS extra FROM (SELECT *, coalesce(lag(depth) OVER (PARTITION BY path ORDER BY line), 0) AS before FROM ev5) WHERE top > 4 AND before <= 4 UNION ALL SELECT path, line, 'PERF004', NULL FROM sln WHERE raw LIKE '%$(basename %'", _DEPTH_SQL))
def deep_blocks(spark: SparkSession, sf: str) -> DataFrame:
    lines = V.lexed(spark, sf)
    every = tuple({r.rule for r in SR.LINE_RULES} | {"MNT001"})
    return SR.line_rule_hits(lines, LN.content_flags(V.shell_files(spark, sf)), every).select("path", "line", "rule", "extra")


_FILE_SQL = """x AS (SELECT f.*, coalesce(h.head_comment, false) AS hc, s.has_crlf FROM sfg f LEFT JOIN shd h USING (path) JOIN sfl s USING (path)),
fa AS (SELECT path, 'ROB009' AS rule, 0 AS line FROM x WHERE has_crlf UNION ALL SELECT path, 'POR001', 0 FROM x WHERE shebang IS NULL
 UNION ALL SELECT path, 'POR002', 1 FROM x WHERE shebang LIKE '#!/usr/local%' UNION ALL SELECT path, 'ROB001', 0 FROM x WHERE code_lines >= 5 AND NOT errexit
 UNION ALL SELECT path, 'ROB003', 0 FROM x WHERE code_lines >= 5 AND NOT nounset UNION ALL SELECT path, 'ROB002', 0 FROM x WHERE code_lines >= 5 AND dialect IN ('bash', 'ksh', 'zsh') AND pipes AND NOT pipefail
 UNION ALL SELECT path, 'ROB004', mktemp_line FROM x WHERE mktemp_line IS NOT NULL AND NOT traps UNION ALL SELECT path, 'SEC017', 0 FROM x WHERE NOT sets_path
 UNION ALL SELECT path, 'ROB016', 0 FROM x WHERE NOT sets_path UNION ALL SELECT path, 'ROB014', 0 FROM x WHERE NOT locks UNION ALL SELECT path, 'MNT004', 0 FROM x WHERE code_lines >= 5 AND NOT hc
 UNION ALL SELECT path, 'MNT005', 0 FROM x WHERE code_lines > 30 AND comment_lines * 20 < code_lines UNION ALL SELECT path, 'MNT008', 0 FROM x WHERE functions = 0 AND code_lines > 20
 UNION ALL SELECT path, 'MNT009', 0 FROM x WHERE tab_lines > 0 AND space_lines > 0 UNION ALL SELECT path, 'POR006', manager_line FROM x WHERE len(managers) = 1)"""


@query("file_rules", w("SELECT path, rule, CAST(line AS INTEGER) AS line FROM fa", V.FLAGS_SQL, _HEAD_SQL, _FILE_SQL))
def file_rules(spark: SparkSession, sf: str) -> DataFrame:
    hits = SR.file_rule_hits(LN.file_flags(V.shell_files(spark, sf), V.lexed(spark, sf)), 20)
    return hits.select("path", "rule", "line")


@query("shell_findings")
def shell_findings(spark: SparkSession, sf: str) -> DataFrame:
    """All built-in findings of all scripts, with contexts."""
    out = SR.shell_findings(V.lexed(spark, sf), V.shell_files(spark, sf), contexts=("cron", "root"))
    return out.groupBy("rule", "category", "severity").agg(F.count("*").alias("n"))


@query("drop_embedded_rules", w("SELECT path, rule, line FROM fa WHERE NOT (path LIKE 'repo3/%' AND (rule IN ('POR001','POR002','ROB001','ROB003','ROB014','SEC017','ROB016','MNT004','MNT005','MNT008','MNT009','POR006') OR rule = 'ROB002'))",
  V.FLAGS_SQL, _HEAD_SQL, _FILE_SQL))
def drop_embedded_rules(spark: SparkSession, sf: str) -> DataFrame:
    hosts = V.files(spark, sf).filter("repo = 'repo3'").select("path", F.lit(True).alias("pipefail"))
    hits = file_rules(spark, sf).withColumn("tool", F.lit("builtin"))
    return LN.drop_embedded_rules(hits, hosts).select("path", "rule", "line")


@query("analyze_fleet")
def analyze_fleet(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts, host files and Python files of all tables through the whole analysis."""
    from fleetgrade.plans.analyze import Options, analyze
    from fleetgrade.workload.code_queries import python_files as py
    from fleetgrade.workload.host_queries import all_hosts

    fleet = V.files(spark, sf).select("path", "content").unionByName(py(spark, sf)).unionByName(all_hosts(spark, sf).select("path", "content"))
    # Stored first: real files are a scan, not a derivation repeated by every branch of the plan.
    stored = cut(fleet)
    report = analyze(stored, Options(contexts=("cron",)))
    return report.scores


@query("analyze_codes", w("SELECT path, total_lines, code_lines, comment_lines FROM sfg", V.FLAGS_SQL))
def analyze_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Line counts straight from the text of a file, as the analysis uses them."""
    return LN.content_flags(V.shell_files(spark, sf)).select("path", "total_lines", "code_lines", "comment_lines")
