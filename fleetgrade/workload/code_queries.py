"""Queries over commands, Python files, custom rules, corrections and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.operators import commands as CM
from fleetgrade.operators import custom as UD
from fleetgrade.operators import fixes as FX
from fleetgrade.operators import lines as LN
from fleetgrade.operators import python as PY
from fleetgrade.operators import rule_table as RT
from fleetgrade.functions import scalars as S
from fleetgrade.functions.tables import register_tables
from fleetgrade.sources import sinks as SK
from fleetgrade.workload import event_views as V
from fleetgrade.workload import finding_queries as FQ
from fleetgrade.workload import script_queries as SQ
from fleetgrade.workload import script_views as SV
from fleetgrade.workload.blocks import Blocks
from fleetgrade.workload.registry import query, table

# ---------------------------------------------------------------- commands

SHELL = Blocks("customer", "c_custkey", "c/", ".sh", (
    (("#!/bin/bash", ()), ("# none", ())),
    (("sudo -u app env LANG=C jq . a.json", (("use", 0, "sudo"), ("use", 0, "env"), ("use", 0, "jq"))), ("timeout 30 curl -s x | xargs -n 1 gzip", (("use", 0, "timeout"), ("use", 0, "curl"), ("use", 0, "xargs"), ("use", 0, "gzip"))),
     ("A=1 B=2 ./run.sh && echo done", (("use", 0, "./run.sh"),)), ("for f in *.x; do convert \"$f\"; done", (("use", 0, "convert"), )), ("cat <<EOF\nnot a command\nEOF", (("use", 0, "cat"),))),
    (("command -v jq >/dev/null || exit 1", (("guard", 0, "jq"), ("use", 0, "jq"))), ("type -p 'curl' rsync", (("guard", 0, "curl"), ("guard", 0, "rsync"))), ("ls -l", (("use", 0, "ls"),)), ("if ! hash git; then exit; fi", (("guard", 0, "git"),))),
    (("helper() {\n  rsync -a x y\n}\nhelper", (("use", 1, "rsync"),)), ("$TOOL run; terraform apply", (("use", 0, "terraform"),)), ("psql -c 'select 1'", (("use", 0, "psql"),))),
), ("kind", "off", "name"))


def shell_lines(spark: SparkSession, sf: str) -> DataFrame:
    return LN.mask_lines(LN.with_model(SHELL.files(spark, sf)))


@query("external_commands", f"""WITH {SHELL.ctes('sh')}, loops AS (SELECT path, start AS line, 'f' AS name FROM sh_pos WHERE slot = 9)
 SELECT path, name, min(line) AS first_line, count(DISTINCT line) AS uses FROM (SELECT path, name, line FROM sh WHERE kind = 'use' UNION ALL SELECT path, name, line FROM loops) GROUP BY path, name""")
def external_commands(spark: SparkSession, sf: str) -> DataFrame:
    return CM.external_commands(shell_lines(spark, sf))


@query("guarded_commands", f"WITH {SHELL.ctes('sh')} SELECT DISTINCT path, name FROM sh WHERE kind = 'guard'")
def guarded_commands(spark: SparkSession, sf: str) -> DataFrame:
    return CM.guarded_commands(shell_lines(spark, sf))


_INVENTORY = ("jq", "sudo", "xargs", "convert")


@query("missing_commands", f"""WITH {SHELL.ctes('sh')} SELECT path, 'ROB017' AS rule, min(line) AS line, name AS extra FROM sh u WHERE kind = 'use' AND name NOT IN ('jq','sudo','xargs','convert','env','timeout','gzip','cat','ls')
 AND NOT EXISTS (SELECT 1 FROM sh g WHERE g.kind = 'guard' AND g.path = u.path AND g.name = u.name) GROUP BY path, name""")
def missing_commands(spark: SparkSession, sf: str) -> DataFrame:
    lines = shell_lines(spark, sf)
    have = table(spark, sf, "nation").filter("n_nationkey < 4").select(
        F.lit("command").alias("kind"), F.element_at(F.array(*[F.lit(n) for n in _INVENTORY]), F.col("n_nationkey") + 1).alias("name"))
    return CM.missing_commands(CM.external_commands(lines), CM.guarded_commands(lines), have)


@query("required_packages", f"""WITH {SHELL.ctes('sh')}, p(name, dnf, apt) AS (VALUES ('jq','jq','jq'),('curl','curl','curl'),('sudo','sudo','sudo'),('convert','ImageMagick','imagemagick'),('rsync','rsync','rsync'),('psql','postgresql','postgresql-client'))
 SELECT u.path, coalesce(array_to_string(list_sort(list(DISTINCT dnf) FILTER (dnf IS NOT NULL)), ' '), '') AS dnf, coalesce(array_to_string(list_sort(list(DISTINCT apt) FILTER (apt IS NOT NULL)), ' '), '') AS apt
 FROM (SELECT path, name FROM sh WHERE kind = 'use' AND name NOT IN ('env','timeout','gzip','cat','ls','xargs')) u LEFT JOIN p USING (name) GROUP BY u.path""")
def required_packages(spark: SparkSession, sf: str) -> DataFrame:
    out = CM.required_packages(CM.external_commands(shell_lines(spark, sf)))
    return out.select("path", F.array_join("dnf", " ").alias("dnf"), F.array_join("apt", " ").alias("apt"))


# ---------------------------------------------------------------- Python

PYTHON = Blocks("customer", "c_custkey", "p/", "/main.py", (
    (("#!/usr/bin/env python3", ()), ("#!/usr/bin/python", (("PYPOR001", 0, ""),)), ("# head", ())),
    (('"""Doc."""', ()), ("x0 = 0", ())),
    (("import os, requests", (("import", 0, "os"), ("import", 0, "requests"))), ("try:\n    import yaml\nexcept ImportError:\n    yaml = None", (("import", 1, "yaml"), ("top", 0, ""))), ("from local_mod.sub import a\nfrom . import b\nimport helper", (("import", 0, "local_mod"), ("import", 2, "helper"))),
     ("import foo_bar as fb", (("import", 0, "foo_bar"),))),
    (("import subprocess as sp\nsp.run(['a'])", (("import", 0, "subprocess"), ("PYROB001", 1, ""), ("top", 1, ""))), ("from subprocess import call as c\nc('x', timeout=3)", (("import", 0, "subprocess"), ("top", 1, ""))), ("n = input('?')", (("PYROB002", 0, ""),)), ("a = 1", ())),
    (("def main():\n    return 1", ()), ("async def main():\n    def inner():\n        return 2\n    return None", ()), ("b = 2", ())),
    (("main()", (("top", 0, ""),)), ("if __name__ == '__main__':\n    main()", (("guard", 1, ""),)), ("with open('.lock') as f:\n    pass", (("top", 0, ""), ("lock", 0, "")))),
    (("token = 'Zm9vYmFyQmF6MTIzNDU2Nzg5MHF3ZXJ0eQ'", (("PYSEC001", 0, ""),)), ("c = 3", ()))), ("rule", "off", "name"))


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    return PYTHON.files(spark, sf)


@query("python_facts", f"""WITH {PYTHON.ctes('py')}, ixs AS (SELECT path, max(CASE WHEN slot = 0 THEN ix END) AS s0, max(CASE WHEN slot = 1 THEN ix END) AS doc, max(CASE WHEN slot = 4 THEN ix END) AS fn, max(CASE WHEN slot = 5 THEN ix END) AS tail FROM py_pos GROUP BY path)
 SELECT i.path, doc = 0 AS docstring, CASE fn WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS functions, tail = 1 AS main_guard, coalesce(string_agg(CASE WHEN rule = 'top' THEN line END::VARCHAR, ' ' ORDER BY line), '') AS top_level,
 coalesce(string_agg(CASE WHEN rule = 'PYROB001' THEN line END::VARCHAR, ' ' ORDER BY line), '') AS no_timeout, coalesce(string_agg(CASE WHEN rule = 'PYROB002' THEN line END::VARCHAR, ' ' ORDER BY line), '') AS inputs,
 coalesce(string_agg(CASE WHEN fn = 0 AND ((tail = 0 AND rule = 'top' AND slot = 5) OR rule = 'guard') THEN line END::VARCHAR, ' ' ORDER BY line), '') AS dropped FROM ixs i LEFT JOIN py USING (path) GROUP BY ALL""")
def python_facts(spark: SparkSession, sf: str) -> DataFrame:
    f = PY.python_facts(python_files(spark, sf))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return f.select("path", "docstring", "functions", "main_guard", *[text(c) for c in ("top_level", "no_timeout", "inputs", "dropped")])


@query("lexical_facts", f"""WITH {PYTHON.ctes('py')} SELECT path, max(CASE WHEN slot = 4 THEN CASE ix WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END END) AS functions, bool_or(slot = 5 AND ix = 1) AS main_guard FROM py_pos GROUP BY path""")
def lexical_facts(spark: SparkSession, sf: str) -> DataFrame:
    return PY.lexical_facts(LN.to_lines(python_files(spark, sf))).select("path", "functions", "main_guard")


@query("python_rules", f"""WITH {PYTHON.ctes('py')}, ixs AS (SELECT path, max(CASE WHEN slot = 0 THEN ix END) AS s0, max(CASE WHEN slot = 1 THEN ix END) AS doc, max(CASE WHEN slot = 4 THEN ix END) AS fn, max(CASE WHEN slot = 5 THEN ix END) AS tail,
  max(CASE WHEN slot = 2 THEN CASE ix WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 1 END WHEN slot = 3 THEN NULL END) AS l2, max(CASE WHEN slot = 3 THEN CASE WHEN ix < 2 THEN 2 ELSE 1 END END) AS l3, max(CASE WHEN slot = 4 THEN CASE ix WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 1 END END) AS l4,
  max(CASE WHEN slot = 5 THEN CASE ix WHEN 0 THEN 1 ELSE 2 END END) AS l5 FROM py_pos GROUP BY path),
 tops AS (SELECT path, min(line) AS line FROM py WHERE rule = 'top' GROUP BY path)
 SELECT path, rule, line FROM py WHERE rule LIKE 'PY%' UNION ALL SELECT path, 'PYMNT002', line FROM tops JOIN ixs USING (path) WHERE fn < 2 AND tail <> 1
 UNION ALL SELECT path, 'PYROB003', 0 FROM ixs WHERE tail <> 2 UNION ALL SELECT path, 'PYMNT001', 0 FROM ixs WHERE doc = 1 AND s0 <> 2 AND 1 + l2 + l3 + l4 + l5 + 1 >= 5
 UNION ALL SELECT p.path, 'PYROB004', line FROM py p JOIN ixs USING (path) WHERE fn = 0 AND ((tail = 0 AND rule = 'top' AND slot = 5) OR rule = 'guard')""")
def python_rules(spark: SparkSession, sf: str) -> DataFrame:
    files = python_files(spark, sf)
    lines = LN.to_lines(files)
    counts = LN.count_python_lines(LN.python_lines(files))
    return PY.python_rule_hits(lines, PY.python_facts(files), counts).select("path", "rule", "line")


_MODULES = {"requests": "requests", "helper": "helper-dist"}


def _inventory(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").filter("r_regionkey < 2")
    names = F.array(*[F.lit(m) for m in _MODULES])
    dists = F.array(*[F.lit(d) for d in _MODULES.values()])
    at = F.col("r_regionkey") + 1
    return r.select(F.lit("module").alias("kind"), F.element_at(names, at).alias("name"), F.element_at(dists, at).alias("dist"))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts with a sibling module and dependency files in some folders."""
    files = python_files(spark, sf)
    k = F.regexp_extract("path", r"^p/(\d+)/", 1).cast("bigint")
    at = lambda name, text: files.select(F.concat(F.lit("p/"), k.cast("string"), F.lit("/" + name)).alias("path"), F.lit(text).alias("content"))
    return (
        files.unionByName(at("local_mod.py", "a = 1\n").filter(k % 2 == 0))
        .unionByName(at("requirements.txt", "# deps\nRequests[socks]>=2 ; python_version < '4'\n-r more.txt\n-e git+https://x.example.org/a#egg=Egg_Name\n").filter(k % 4 == 0))
        .unionByName(at("more.txt", "foo_bar-extras==1 # pinned\n--index-url https://x\n").filter(k % 4 == 0))
        .unionByName(at("pyproject.toml", "[project]\nname = 'x'\ndependencies = [\n  'PyYAML>=5', # c\n  \"helper.dist\",\n]\n[tool.poetry.dependencies]\npython = '^3'\nflask = '2'\n").filter(k % 4 == 1))
        .unionByName(at("setup.cfg", "[options]\ninstall_requires =\n    requests\n    pyyaml>5\n\nzip_safe = no\n").filter(k % 4 == 2)))


_STATUS = "CASE name WHEN 'os' THEN 'stdlib' WHEN 'subprocess' THEN 'stdlib' WHEN 'requests' THEN 'installed' WHEN 'helper' THEN 'installed' WHEN 'local_mod' THEN CASE WHEN k % 2 = 0 THEN 'local' ELSE 'missing' END ELSE 'missing' END"


@query("python_imports", f"WITH {PYTHON.ctes('py')} SELECT path, name AS module, line, name = 'yaml' AS optional, {_STATUS} AS status FROM py WHERE rule = 'import'")
def python_imports(spark: SparkSession, sf: str) -> DataFrame:
    tree = _tree(spark, sf)
    return PY.python_imports(python_files(spark, sf), tree, _inventory(spark, sf)).select("path", "module", "line", "optional", "status")


@query("declared_deps", """SELECT 'p/' || c_custkey AS folder, d.dist FROM customer JOIN (VALUES (0,'requests'),(0,'foo-bar-extras'),(0,'egg-name'),(1,'pyyaml'),(1,'helper-dist'),(1,'flask'),(2,'requests'),(2,'pyyaml')) d(m, dist) ON c_custkey % 4 = d.m""")
def declared_deps(spark: SparkSession, sf: str) -> DataFrame:
    return PY.declared_deps(_tree(spark, sf)).filter("dist <> 'x'")


@query("inline_deps", "SELECT 'i/' || c_custkey || '.py' AS path, 'flask rich' AS dists FROM customer WHERE c_custkey % 3 = 0")
def inline_deps(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    head = F.when(F.col("c_custkey") % 3 == 0, "# /// script\n# dependencies = [\n#   \"Flask\",\n#   \"rich>1\",\n# ]\n# ///\n").when(F.col("c_custkey") % 3 == 1, "# /// script\nbroken\n# ///\n").otherwise("")
    files = c.select(F.concat(F.lit("i/"), F.col("c_custkey"), F.lit(".py")).alias("path"), F.concat(head, F.lit("import x\n")).alias("content"))
    return PY.inline_deps(files).select("path", F.array_join(F.array_sort("dists"), " ").alias("dists"))


@query("check_imports", f"""WITH {PYTHON.ctes('py')}, i AS (SELECT path, k, name, line, {_STATUS} AS status FROM py WHERE rule = 'import'),
 d AS (SELECT *, CASE name WHEN 'requests' THEN k % 4 IN (0, 2) WHEN 'foo_bar' THEN k % 4 = 0 WHEN 'yaml' THEN k % 4 IN (1, 2) WHEN 'helper' THEN k % 4 = 1 ELSE false END AS covered, k % 4 < 3 AS known FROM i WHERE status IN ('missing', 'installed'))
 SELECT path, CASE WHEN status = 'missing' THEN 'PYROB005' ELSE 'PYPOR002' END AS rule, line, name AS extra FROM d WHERE NOT covered AND CASE WHEN status = 'missing' THEN name <> 'yaml' ELSE known END""")
def check_imports(spark: SparkSession, sf: str) -> DataFrame:
    tree, files = _tree(spark, sf), python_files(spark, sf)
    imports = PY.python_imports(files, tree, _inventory(spark, sf))
    roots = table(spark, sf, "region").filter("r_regionkey = 0").select(F.lit("p").alias("folder"))
    return PY.check_imports(imports, PY.declared_for(files, PY.declared_deps(tree), roots))


# ---------------------------------------------------------------- custom rules

CUSTOM = (
    UD.CustomRule("MAIL", r"[a-z0-9.]+@([a-z]+)[0-9]*\.example\.(com|org|net)", "an address", replace="<$1>", severity="high", category="security"),
    UD.CustomRule("TOKEN", r'token = "[0-9a-f]{40}"', "a token", severity="critical", category="security"),
    UD.CustomRule("SHOUT", r"the", "the", ignore_case=True, comments=True),
    UD.CustomRule("LICENSE", r"(?i)license", "names no license", absent=True, severity="low"),
)


def _docs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    files = SQ.documents(spark, sf)
    return files, LN.to_lines(files)


@query("custom_rules", f"""WITH {SQ.DOC_LINES}, m AS (
 SELECT path, line, 'MAIL' AS rule, 'high' AS severity, raw, '[a-z0-9.]+@([a-z]+)[0-9]*\\.example\\.(com|org|net)' AS p FROM dln WHERE regexp_matches(raw, '[a-z0-9.]+@([a-z]+)[0-9]*\\.example\\.(com|org|net)') AND NOT regexp_matches(raw, '^\\s*#')
 UNION ALL SELECT path, line, 'TOKEN', 'critical', raw, 'token = "[0-9a-f]{{40}}"' FROM dln WHERE regexp_matches(raw, 'token = "[0-9a-f]{{40}}"') AND NOT regexp_matches(raw, '^\\s*#')
 UNION ALL SELECT path, line, 'SHOUT', 'medium', raw, '(?i)the' FROM dln WHERE regexp_matches(raw, '(?i)the'))
 SELECT path, CAST(line AS INTEGER) AS line, rule, severity, CAST(strpos(raw, regexp_extract(raw, p)) AS INTEGER) AS "column", CASE WHEN rule = 'MAIL' THEN CAST(len(regexp_extract_all(raw, p)) AS INTEGER) ELSE 0 END AS edits FROM m
 UNION ALL SELECT path, 0, 'LICENSE', 'low', 0, 0 FROM (SELECT DISTINCT path FROM dl0) d WHERE NOT EXISTS (SELECT 1 FROM dln WHERE dln.path = d.path AND regexp_matches(raw, '(?i)license') AND NOT regexp_matches(raw, '^\\s*#'))""")
def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    files, lines = _docs(spark, sf)
    out = UD.custom_rules(lines, CUSTOM, files.select("path"))
    return out.select("path", "line", "rule", "severity", "column", F.size("edits").alias("edits"))


@query("custom_replacements", f"""WITH {SQ.DOC_LINES} SELECT path, CAST(line AS INTEGER) AS line, array_to_string(list_transform(regexp_extract_all(raw, '[a-z0-9.]+@([a-z]+)[0-9]*\\.example\\.(com|org|net)', 1), lambda x: '<' || x || '>'), ' ') AS texts
 FROM dln WHERE regexp_matches(raw, '[a-z0-9.]+@([a-z]+)[0-9]*\\.example\\.(com|org|net)') AND NOT regexp_matches(raw, '^\\s*#')""")
def custom_replacements(spark: SparkSession, sf: str) -> DataFrame:
    out = UD.custom_rules(_docs(spark, sf)[1], CUSTOM[:1])
    return out.select("path", "line", F.array_join(F.transform("edits", lambda e: e["replacement"]), " ").alias("texts"))


@query("validate_rules", """WITH r AS (SELECT CASE WHEN p_partkey % 50 = 7 THEN 'SEC001' WHEN p_partkey % 50 = 8 THEN 'low' || p_partkey ELSE 'P' || (p_partkey // 2) END AS id, p_partkey AS k FROM part)
 SELECT id, 'duplicate id' AS problem FROM r GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT id, 'bad category' FROM r WHERE k % 5 = 0 UNION ALL SELECT DISTINCT id, 'built-in id' FROM r WHERE id = 'SEC001'
 UNION ALL SELECT DISTINCT id, 'bad id' FROM r WHERE id LIKE 'low%' UNION ALL SELECT DISTINCT id, 'absent with replace' FROM r WHERE k % 9 = 0""")
def validate_rules(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rules = table(spark, sf, "part").select(
        F.when(k % 50 == 7, "SEC001").when(k % 50 == 8, F.concat(F.lit("low"), k)).otherwise(F.concat(F.lit("P"), F.floor(k / 2))).alias("id"), F.lit("x").alias("pattern"),
        F.lit("m").alias("message"), F.lit("low").alias("severity"), F.when(k % 5 == 0, "odd").otherwise("security").alias("category"), F.lit("any").alias("language"),
        (k % 9 == 0).alias("absent"), F.when(k % 9 == 0, "y").alias("replace"))
    return UD.validate_rules(rules)


# One rule per word of the benchmark texts: as many rules as the table has words.
WORD_RULES_SQL = "rw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark)"


def word_rules(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{5,})"), F.lit(1))).alias("w")).distinct()
    none = F.lit(None).cast("string")
    return words.select(
        F.concat(F.lit("W-"), F.upper("w")).alias("id"), F.concat(F.lit("(?<![A-Za-z])"), "w", F.lit("(?![A-Za-z])")).alias("pattern"), F.lit("a word of the benchmark").alias("message"),
        (F.length("w") % 2 == 0).alias("ignore_case"), F.when(F.length("w") > 8, "high").otherwise("low").alias("severity"), F.lit("security").alias("category"), F.lit("any").alias("language"),
        (F.length("w") % 13 == 0).alias("absent"), F.when(F.endswith("w", F.lit("n")) & (F.length("w") % 13 != 0), "<$0>").alias("replace"), F.lit(False).alias("comments"), none.alias("hint"), none.alias("url"))


@query("rule_table", f"""WITH {SQ.DOC_LINES}, {WORD_RULES_SQL}, tok AS (SELECT path, line, unnest(regexp_extract_all(raw, '[A-Za-z]+')) AS t FROM dln WHERE NOT regexp_matches(raw, '^\\s*#')),
 hit AS (SELECT path, line, w, count(*) AS n FROM tok JOIN rw ON lower(t) = w AND (length(w) % 2 = 0 OR t = w) GROUP BY ALL)
 SELECT path, 'W-' || upper(w) AS rule, CASE WHEN length(w) > 8 THEN 'high' ELSE 'low' END AS severity, count(*) AS lines, CAST(min(line) AS INTEGER) AS first_line, CASE WHEN w LIKE '%n' THEN CAST(sum(n) AS BIGINT) ELSE 0 END AS edits
 FROM hit WHERE length(w) % 13 <> 0 GROUP BY path, w
 UNION ALL SELECT path, 'W-' || upper(w), 'high', 1, 0, 0 FROM (SELECT DISTINCT path FROM dl0) d CROSS JOIN rw WHERE length(w) % 13 = 0 AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.path = d.path AND hit.w = rw.w)""")
def rule_table(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the benchmark as a rule of its own over every line of the documents."""
    files, lines = _docs(spark, sf)
    out = RT.custom_rules(lines, word_rules(spark, sf), files.select("path"))
    return out.groupBy("path", "rule", "severity").agg(
        F.count("*").alias("lines"), F.min("line").alias("first_line"), F.sum(F.size("edits").cast("bigint")).alias("edits"))


@query("document_scores", f"""WITH {SQ.DOC_LINES}, f AS (
 SELECT path, 'security' AS category, 'custom' AS tool, 'MAIL' AS rule, 'high' AS severity FROM dln WHERE regexp_matches(raw, '[a-z0-9.]+@([a-z]+)[0-9]*\\.example\\.(com|org|net)') AND NOT regexp_matches(raw, '^\\s*#')
 UNION ALL SELECT path, 'security', 'custom', 'TOKEN', 'critical' FROM dln WHERE regexp_matches(raw, 'token = "[0-9a-f]{{40}}"') AND NOT regexp_matches(raw, '^\\s*#')
 UNION ALL SELECT path, 'maintainability', 'builtin', 'MNT001', 'low' FROM dln WHERE length(raw) > 120),
 fl AS (SELECT d.path, count(l.line) FILTER (trim(l.raw) <> '' AND NOT regexp_matches(l.raw, '^\\s*#')) AS code_lines FROM (SELECT DISTINCT path FROM dl0) d LEFT JOIN dln l USING (path) GROUP BY d.path),
 {V.penalty_sql('f', 'pen', 'fl')}, {V.score_sql('pen', 'scr', 'fl')} SELECT path, security, maintainability, "global", grade FROM scr""")
def document_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a fleet of files: lines, rules, penalties, scores, grades.

    The lines are exploded once; line counts come from the text of each row.
    """
    from fleetgrade.operators import scoring as AG

    files, lines = _docs(spark, sf)
    long = UD.CustomRule("MNT001", "^.{121}", "line too long", severity="low", comments=True)
    found = UD.custom_rules(lines, (*CUSTOM[:2], long)).select("path", "category", "tool", "rule", "severity")
    counts = files.select("path", F.regexp_count(LN.normalized(F.col("content")), F.lit(r"(?m)^[^\S\n]*[^\s#]")).alias("code_lines"))
    return AG.script_scores(counts, AG.rule_penalties(found, counts)).select("path", "security", "maintainability", "global", "grade")


# ---------------------------------------------------------------- corrections


@query("builtin_fixes", SQ.w("""SELECT path, line, CASE raw WHEN 'read -p ''Password: '' password' THEN 'read -r -p ''Password: '' password' WHEN 'while read line; do' THEN 'while read -r line; do' WHEN 'IFS=, read a b' THEN 'IFS=, read -r a b'
 WHEN 'now=`date`' THEN 'now=$(date)' WHEN 'echo trailing  ' THEN 'echo trailing' WHEN 'which python3' THEN 'command -v python3' WHEN 'egrep foo bar.txt' THEN 'grep -E foo bar.txt' WHEN 'ls | fgrep x' THEN 'ls | grep -F x' END AS after
 FROM sln WHERE raw IN ('read -p ''Password: '' password', 'while read line; do', 'IFS=, read a b', 'now=`date`', 'echo trailing  ', 'which python3', 'egrep foo bar.txt', 'ls | fgrep x')"""))
def builtin_fixes(spark: SparkSession, sf: str) -> DataFrame:
    return FX.builtin_fixes(SV.lexed(spark, sf)).select("path", "line", "after")


@query("fix_summary", SQ.w("""SELECT path, CASE WHEN raw LIKE '%read%' THEN 'ROB007' WHEN raw LIKE 'now%' THEN 'MNT007' WHEN raw LIKE '%trailing%' THEN 'MNT010' WHEN raw LIKE 'which%' THEN 'POR004' ELSE 'POR005' END AS rule, count(*) AS n
 FROM sln WHERE raw IN ('read -p ''Password: '' password', 'while read line; do', 'IFS=, read a b', 'now=`date`', 'echo trailing  ', 'which python3', 'egrep foo bar.txt', 'ls | fgrep x') GROUP BY ALL"""))
def fix_summary(spark: SparkSession, sf: str) -> DataFrame:
    return FX.fix_summary(FX.builtin_fixes(SV.lexed(spark, sf)))


@query("attach_fixes", SQ.w("SELECT path, line, CASE WHEN raw = 'which python3' THEN 'command -v python3' WHEN raw = 'ls | fgrep x' THEN 'ls | grep -F x' END AS replacement FROM sln WHERE raw IN ('which python3', 'ls | fgrep x')"))
def attach_fixes(spark: SparkSession, sf: str) -> DataFrame:
    from fleetgrade.operators.findings import complete

    lines = SV.lexed(spark, sf)
    found = lines.filter(F.col("raw").isin("which python3", "ls | fgrep x")).select(
        "path", F.lit("shellcheck").alias("tool"), F.when(F.col("raw") == "which python3", "SC2230").otherwise("SC2197").alias("rule"), F.lit("portability").alias("category"),
        F.lit("low").alias("severity"), "line", F.col("raw").alias("snippet"))
    return FX.attach_fixes(complete(found), lines).select("path", "line", F.element_at("edits", 1)["replacement"].alias("replacement"))


def _mail_fix(spark: SparkSession, sf: str) -> DataFrame:
    files, lines = _docs(spark, sf)
    return FX.apply_edits(files.withColumn("content", LN.normalized(F.col("content"))), UD.custom_rules(lines, CUSTOM[:1]))


_MAIL_SQL = f"""WITH {SQ.DOC_LINES}, fx AS (SELECT path, line, CASE WHEN regexp_matches(raw, '^\\s*#') THEN raw ELSE regexp_replace(raw, '[a-z0-9.]+@([a-z]+)[0-9]*\\.example\\.(com|org|net)', '<\\1>', 'g') END AS after, raw FROM dln)"""


@query("apply_edits", _MAIL_SQL + " SELECT path, md5(string_agg(after, chr(10) ORDER BY line)) AS digest, CAST(count(*) FILTER (after <> raw) AS INTEGER) AS n FROM fx GROUP BY path HAVING n > 0")
def apply_edits(spark: SparkSession, sf: str) -> DataFrame:
    out = _mail_fix(spark, sf)
    return out.select("path", F.md5(F.encode(F.regexp_replace("fixed", r"\n\z", ""), "UTF-8")).alias("digest"), F.element_at("counts", "MAIL").alias("n"))


@query("change_table", _MAIL_SQL + " SELECT path, CAST(line AS INTEGER) AS line, raw AS before, after FROM fx WHERE after <> raw")
def change_table(spark: SparkSession, sf: str) -> DataFrame:
    fixed = _mail_fix(spark, sf)
    return FX.change_table(LN.to_lines(fixed), LN.to_lines(fixed.select("path", F.col("fixed").alias("content"))))


@query("fix_preview", _MAIL_SQL + " SELECT path, CAST(line AS INTEGER) AS first, raw AS before, after FROM fx WHERE after <> raw")
def fix_preview(spark: SparkSession, sf: str) -> DataFrame:
    lines = _docs(spark, sf)[1]
    return FX.fix_preview(UD.custom_rules(lines, CUSTOM[:1]), lines).select("path", "first", "before", "after")


# ---------------------------------------------------------------- exports

w = V.with_findings
PEN, SCR = V.penalty_sql(), V.score_sql()


@query("write_reports_json", w("SELECT path, \"global\" AS score, grade, count(position) AS findings FROM scr LEFT JOIN fnd USING (path) GROUP BY ALL", PEN, SCR))
def write_reports_json(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as text and read back."""
    from fleetgrade.sources.reports import parse_reports

    f, files, _, scr = FQ.scored(spark, sf)
    docs = SK.reports_json(files, scr, _plain(f))
    heads, found = parse_reports(docs)
    n = found.groupBy("path").agg(F.count("*").alias("findings"))
    return heads.join(n, "path", "left").select("path", F.col("global").alias("score"), "grade", F.coalesce("findings", F.lit(0)).alias("findings"))


def _plain(f: DataFrame) -> DataFrame:
    from fleetgrade.operators.findings import complete

    return complete(f.drop("ts", "repo")).join(f.select("position", "repo"), "position")


@query("write_sarif", w("SELECT repo, count(*) AS results, count(DISTINCT tool || '/' || rule) AS rules FROM fnd GROUP BY repo"))
def write_sarif(spark: SparkSession, sf: str) -> DataFrame:
    docs = SK.sarif(_plain(V.findings(spark, sf)))
    doc = F.from_json("value", "struct<runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleId:string>>>>>")
    run = docs.select("repo", F.element_at(doc["runs"], 1).alias("r"))
    return run.select("repo", F.size("r.results").cast("bigint").alias("results"), F.size("r.tool.driver.rules").cast("bigint").alias("rules"))


@query("write_code_quality", w("""SELECT position, '{"type":"issue","check_name":"' || tool || '/' || rule || '","description":"' || message || '","categories":["' || CASE category WHEN 'security' THEN 'Security' WHEN 'robustness' THEN 'Bug Risk' WHEN 'maintainability' THEN 'Style' WHEN 'portability' THEN 'Compatibility' ELSE 'Performance' END
 || '"],"severity":"' || (['blocker','critical','major','minor'])[sev + 1] || '","fingerprint":"' || path || ':' || line || ':' || rule || '","location":{"path":"' || path || '","lines":{"begin":' || greatest(line, 1) || '}}}' AS value FROM fnd"""))
def write_code_quality(spark: SparkSession, sf: str) -> DataFrame:
    f = _plain(V.findings(spark, sf)).withColumn("path", F.concat(F.lit("./"), "path"))
    out = SK.code_quality(f.withColumn("fingerprint", F.concat_ws(":", F.substr("path", F.lit(3)), F.col("line").cast("string"), "rule")).withColumn("path", F.concat_ws("#", "path", F.col("position").cast("string"))))
    return out.select(F.substring_index("path", "#", -1).cast("bigint").alias("position"), F.regexp_replace("value", r'#\d+"', '"').alias("value"))


@query("write_junit", w("SELECT path, count(position) AS failures, greatest(count(position), 1) AS tests, max(\"global\") AS score FROM scr LEFT JOIN fnd USING (path) GROUP BY path", PEN, SCR))
def write_junit(spark: SparkSession, sf: str) -> DataFrame:
    f, files, _, scr = FQ.scored(spark, sf)
    suites = SK.junit(files, scr, _plain(f))
    at = lambda p: F.xpath_string("value", F.lit(p))
    return suites.select("path", at("/testsuite/@failures").cast("bigint").alias("failures"), at("/testsuite/@tests").cast("bigint").alias("tests"),
                         at("/testsuite/properties/property[@name='score']/@value").cast("double").alias("score"))


@query("write_annotations", w("""SELECT position, '::' || (['error','error','warning','notice'])[sev + 1] || ' file=' || path || CASE WHEN line > 0 THEN ',line=' || line ELSE '' END || ',title=' || rule || ' (' || tool || '%2C ' || severity || ')::' || message AS value FROM fnd"""))
def write_annotations(spark: SparkSession, sf: str) -> DataFrame:
    f = _plain(V.findings(spark, sf)).withColumn("path", F.concat_ws("#", "path", F.col("position").cast("string")))
    out = SK.annotations(f)
    return out.select(F.substring_index("path", "#", -1).cast("bigint").alias("position"), F.regexp_replace("value", r"#\d+([,:])", "$1").alias("value"))


@query("history_entry", w("""SELECT f.repo AS folder, round(round(avg("global"), 6) * 10) / 10 AS average, CAST(count(*) AS INTEGER) AS scripts, round(round(avg(security), 6) * 10) / 10 AS security FROM scr JOIN fls f USING (path) GROUP BY f.repo""", PEN, SCR))
def history_entry(spark: SparkSession, sf: str) -> DataFrame:
    _, files, _, scr = FQ.scored(spark, sf)
    out = SK.history_entry(scr.join(files.select("path", "repo"), "path"), F.col("repo"), F.lit("2024-01-01").cast("timestamp"))
    return out.select("folder", "average", "scripts", F.col("scores")["security"].alias("security"))


@query("append_history", """WITH h AS (SELECT 'c' || (o_custkey % 40) AS folder, o_orderdate + to_seconds(o_orderkey % 80000) AS ts, round(o_totalprice % 10, 1) AS average FROM orders WHERE o_orderkey % 29 <> 0),
 n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY ts DESC) AS n FROM h) SELECT folder, count(*) AS kept, round(sum(average), 3) AS total FROM n WHERE n <= 200 GROUP BY folder""")
def append_history(spark: SparkSession, sf: str) -> DataFrame:
    from fleetgrade.sources.reports import parse_history
    from fleetgrade.workload.source_queries import history_log

    h = parse_history(history_log(spark, sf)).select("folder", "ts", "average")
    old, new = h.filter("year(ts) < 1998"), h.filter("year(ts) >= 1998")
    return SK.append_history(old, new, 200).groupBy("folder").agg(F.count("*").alias("kept"), F.round(F.sum("average"), 3).alias("total"))


@query("append_false_positive", w("""SELECT f.position, string_agg(CASE WHEN s.line IS NULL THEN l.raw ELSE '-' END, '|' ORDER BY l.line) AS context FROM fnd f JOIN lns l ON l.path = f.path AND l.line BETWEEN f.line - 2 AND f.line + 2
 LEFT JOIN (SELECT DISTINCT path, line FROM fnd WHERE rule = 'SEC002') s ON s.path = l.path AND s.line = l.line GROUP BY f.position"""))
def append_false_positive(spark: SparkSession, sf: str) -> DataFrame:
    f = V.findings(spark, sf)
    out = SK.false_positive_entries(f, V.lines(spark, sf), f.filter("rule = 'SEC002'").select("path", "line"))
    return out.select("position", F.array_join("context", "|", "-").alias("context"))


# ---------------------------------------------------------------- scalar functions


@query("scalar_functions", """SELECT p_partkey, regexp_replace(lower(p_name || '__' || p_brand), '[-_.]+', '-', 'g') AS dist, CASE WHEN p_retailprice % 10 >= 9 THEN 'A' WHEN p_retailprice % 10 >= 7.5 THEN 'B' WHEN p_retailprice % 10 >= 6 THEN 'C' WHEN p_retailprice % 10 >= 4 THEN 'D' ELSE 'E' END AS grade,
 p_partkey % 3 = 0 AS secret, p_partkey % 4 IN (1, 3) AS pinned, p_size % 2 = 0 AS matched, CAST(p_size AS INTEGER) AS number, CASE WHEN p_size % 3 = 0 THEN 'CWE' WHEN p_size % 3 = 1 THEN 'OWASP CI/CD' ELSE 'ANSSI' END AS family,
 'name-' || p_partkey AS requirement FROM part""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, m, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % m + 1).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", S.normalize_dist(F.concat("p_name", F.lit("__"), "p_brand")).alias("dist"), S.grade(F.col("p_retailprice") % 10).alias("grade"),
        S.is_secret_name(pick(k, 3, "DB_PASSWORD", "SECRET_FILE", "TOKENIZER")).alias("secret"),
        S.is_pinned_image(pick(k, 4, "reg:5000/app", "app:1.2", "app:latest", "x@sha256:ab")).alias("pinned"),
        S.matches_rule(pick(size, 2, "SC2*", "SC2"), F.lit("SC2086")).alias("matched"), S.json_int(F.concat(size.cast("string"), F.lit(".0"))).alias("number"),
        S.reference_family(pick(size, 3, "CWE-1", "OWASP CICD-SEC-3", "ANSSI-BP-028 R1")).alias("family"),
        S.requirement_name(F.concat(F.lit(" Name_"), k, F.lit("[x]>=1 ; y"))).alias("requirement"))


_REFS = {
    "CWE-": None, "OWASP A08:2021": "https://top10.owasp.org/2021/A08_2021-Software_and_Data_Integrity_Failures/", "OWASP A11:2021": None,
    "OWASP CICD-SEC-4": "https://owasp.org/www-project-top-10-ci-cd-security-risks/CICD-SEC-04-Poisoned-Pipeline-Execution",
    "OWASP CICD-SEC-8": "https://owasp.org/www-project-top-10-ci-cd-security-risks/", "ANSSI-BP-028 R5": "https://messervices.cyber.gouv.fr/documents-guides/fr_np_linux_configuration-v2.0.pdf",
    "ANSSI OpenSSH R6": "https://messervices.cyber.gouv.fr/documents-guides/NT_OpenSSH.pdf", "other": None, "OWASP A10:2021": "https://top10.owasp.org/2021/A10_2021-Server-Side_Request_Forgery_%28SSRF%29/",
}
_REF_CASES = " ".join(f"WHEN {i} THEN {'NULL' if url is None else repr(url)}" for i, url in enumerate(_REFS.values()) if i)


@query("reference_url", f"""SELECT p_partkey, CASE p_partkey % {len(_REFS)} WHEN 0 THEN 'https://cwe.mitre.org/data/definitions/' || p_partkey || '.html' {_REF_CASES} END AS url FROM part""")
def reference_url(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(r) for r in _REFS]), (k % len(_REFS) + 1).cast("int"))
    ref = F.when(kind == "CWE-", F.concat(kind, k.cast("string"))).otherwise(kind)
    return table(spark, sf, "part").select("p_partkey", S.reference_url(ref).alias("url"))


@query("registered_functions", """SELECT p_partkey, CASE WHEN p_retailprice % 10 >= 9 THEN 'A' WHEN p_retailprice % 10 >= 7.5 THEN 'B' WHEN p_retailprice % 10 >= 6 THEN 'C' WHEN p_retailprice % 10 >= 4 THEN 'D' ELSE 'E' END AS g,
 false AS secret, NOT contains(p_name, 'x') IS NULL AND false AS pinned, starts_with(p_brand, 'Brand#1') AS hit FROM part""")
def registered_functions(spark: SparkSession, sf: str) -> DataFrame:
    S.register(spark)
    table(spark, sf, "part").createOrReplaceTempView("fleetgrade_part")
    return spark.sql("SELECT p_partkey, grade(p_retailprice % 10) AS g, is_secret_name(p_name) AS secret, is_pinned_image(p_name) AS pinned, matches_rule('Brand#1*', p_brand) AS hit FROM fleetgrade_part")


# One shell line per order, and its commands in the order in which they end.
_ORDER_LINE = ("X=1 nohup curl -s -o c", "o_custkey", " http://h/", "o_orderkey", " | tee out && echo \"$(date -d ", "o_orderkey", ")\" > log; bash -c 'rm -r ", "o_orderkey", "'")
_ORDER_COMMANDS = (
    (1, "nohup", "curl", "'-s -o c' || o_custkey || ' http://h/' || o_orderkey", "", "|", False), (2, "tee", "tee", "'out'", "|", "&&", False), (3, "date", "date", "'-d ' || o_orderkey", "$(", "", False),
    (4, "echo", "echo", "'\"$(date -d ' || o_orderkey || ')\"'", "&&", ";", False), (5, "bash", "bash", "'-c ''rm -r ' || o_orderkey || ''''", ";", "", False), (6, "rm", "rm", "'-r ' || o_orderkey", "", "", True))


@query("shell_commands", " UNION ALL ".join(
    f"SELECT o_orderkey, {n} AS number, '{name}' AS name, '{base}' AS base, {bare} AS bare, '{before}' AS before, '{after}' AS after, {inner} AS inner FROM orders" for n, name, base, bare, before, after, inner in _ORDER_COMMANDS))
def shell_commands(spark: SparkSession, sf: str) -> DataFrame:
    """The table function in SQL, over a shell line of each order."""
    register_tables(spark)
    parts = [F.col(p).cast("string") if p.startswith("o_") else F.lit(p) for p in _ORDER_LINE]
    lines = table(spark, sf, "orders").select("o_orderkey", F.concat(*parts).alias("code"))
    return spark.sql("SELECT o_orderkey, number, name, base, array_join(bare, ' ') AS bare, before, after, inner FROM shell_commands(TABLE({lines}))", lines=lines)


@query("shannon_entropy", """WITH c AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0),
 f AS (SELECT doc_id, n, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL) SELECT doc_id, round(-sum((k::DOUBLE / n) * log2(k::DOUBLE / n)), 6) AS bits FROM f GROUP BY doc_id""")
def shannon_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of the characters of each document."""
    d = table(spark, sf, "documents").filter("text <> ''")
    return d.select("doc_id", F.round(S.shannon_entropy(F.col("text")), 6).alias("bits"))


@query("real_secrets", "SELECT c_custkey, c_custkey % 5 = 4 AS hit, CASE WHEN c_acctbal >= 0 THEN '+' ELSE '' END || printf('%.1f', round(c_acctbal * 10) / 10) AS delta FROM customer")
def real_secrets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.element_at(F.array(*[F.lit(x) for x in ("short", "has a blank x", "change_me12", "aaaaaaabb", "k3yM4teri4l")]), (k % 5 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", S.looks_like_real_secret(value).alias("hit"), S.score_delta_text(F.col("c_acctbal")).alias("delta"))
