"""Queries over tool outputs: each order row becomes the recorded output of one tool run."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.sources import tools as T
from fleetgrade.workload.registry import query, table


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def outputs(spark: SparkSession, sf: str, template: str, codes: tuple[str, ...]) -> DataFrame:
    """``template`` with @K (key), @N (line 1–50), @M (0–9) and @C (code) filled in per order."""
    k = F.col("o_orderkey")
    text = F.lit(template)
    fills = {"@C": F.element_at(F.array(*[F.lit(c) for c in codes]), (k % len(codes) + 1).cast("int")), "@N": (k % 50 + 1).cast("string"),
             "@M": (k % 10).cast("string"), "@K": k.cast("string")}
    for mark, value in fills.items():
        text = F.replace(text, F.lit(mark), value)
    return table(spark, sf, "orders").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), text.alias("output"), (k % 3).alias("v"))


SHAPE = ("path", "rule", "category", "severity", "line", "column", "message", "equivalents")


def shape(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join("equivalents", " ").alias(c) if c == "equivalents" else F.col(c) for c in SHAPE])


def oracle(codes: tuple[str, ...], rows: list[dict]) -> str:
    """One SELECT per expected finding; values are SQL over k (key), n (line), m, c (code)."""
    base = f"SELECT 'f' || o_orderkey AS path, o_orderkey AS k, CAST(o_orderkey % 50 + 1 AS INTEGER) AS n, CAST(o_orderkey % 10 AS INTEGER) AS m, ([{','.join(map(_lit, codes))}])[o_orderkey % {len(codes)} + 1] AS c FROM orders"
    defaults = {"column": "0", "equivalents": "''", "where": "true"}
    picks = []
    for r in rows:
        r = {**defaults, **r}
        cols = ", ".join(f"CAST({r[c]} AS {'INTEGER' if c in ('line', 'column') else 'VARCHAR'}) AS \"{c}\"" for c in SHAPE if c != "path")
        picks.append(f"SELECT path, {cols} FROM b WHERE {r['where']}")
    return f"WITH b AS ({base}) " + " UNION ALL ".join(picks)


def case(column: str, pairs: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in pairs.items()) + f" ELSE {other} END"


def _add(name: str, reader, template: str, codes: tuple[str, ...], rows: list[dict]) -> None:
    @query(f"tool_{name}", oracle(codes, rows))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return shape(reader(outputs(spark, sf, template, codes)))


_add("shellcheck", T.shellcheck, json.dumps({"comments": [
    {"line": "@N", "column": 3, "endLine": 1, "level": "warning", "code": "@C", "message": "m @K", "fix": {"replacements": [{"line": 1, "column": 1, "endLine": 1, "endColumn": 2, "replacement": "x"}]}},
    {"line": 2, "column": "@M", "level": "style", "code": 9999, "message": "s"}]}), ("2086", "3010", "1009", "3045", "2999", "2114"), [
    {"rule": "'SC' || c", "category": case("c", {"2086": "robustness", "3010": "portability", "1009": "robustness", "3045": "portability", "2999": "robustness", "2114": "security"}),
     "severity": case("c", {"2086": "medium", "3010": "high", "1009": "medium", "3045": "medium", "2999": "medium", "2114": "critical"}), "line": "n", "column": "3", "message": "'m ' || k"},
    {"rule": "'SC9999'", "category": "'maintainability'", "severity": "'low'", "line": "2", "column": "m", "message": "'s'"}])

_add("syntax", T.syntax_errors, "x.sh: line @N: syntax error near @C\nx.sh: line @N: `echo line'\nnoise", ("fi", "done"), [
    {"rule": "'SYNTAX'", "category": "'robustness'", "severity": "'critical'", "line": "n", "message": "'syntax error near ' || c", "equivalents": "'SC1* E040'"}])

_add("python_syntax", T.python_syntax_errors, "trace\n@N:@M:invalid @C \n", ("x", "y"), [
    {"rule": "'SYNTAX'", "category": "'robustness'", "severity": "'critical'", "line": "n", "column": "m", "message": "'invalid ' || c", "equivalents": _lit(" ".join(T.PY_SYNTAX))}])

_DIFF = "--- a\n+++ b\n@@ -@N,3 +@N,3 @@\n same\n-old @C\n-old2\n+new\n@@ -90,2 +91,3 @@\n+only added\n same"
for _name, _reader in (("shfmt_diff", T.format_diff), ("ruff_format", T.READERS["ruff-format"])):
    _add(_name, _reader, _DIFF, ("x",), [
        {"rule": "'FORMAT'", "category": "'maintainability'", "severity": "'low'", "line": "n + 1", "message": "'formatting differs: 2 line(s)'"}])

_add("shfmt", T.shfmt_errors, "a.sh:@N:@M: @C\nno error here", ("arrays are a bash feature", "reached EOF"), [
    {"rule": "CASE WHEN c LIKE '%bash%' THEN 'DIALECT' ELSE 'PARSE' END", "category": "CASE WHEN c LIKE '%bash%' THEN 'portability' ELSE 'robustness' END",
     "severity": "CASE WHEN c LIKE '%bash%' THEN 'medium' ELSE 'high' END", "line": "n", "column": "m", "message": "c",
     "equivalents": "CASE WHEN c LIKE '%bash%' THEN 'SC3* SC2039 SC2112 SC2113 CB' ELSE 'SYNTAX SC1*' END"}])


@query("tool_shfmt_retry", oracle(("reached EOF",), [
    {"rule": "CASE WHEN k % 3 = 0 THEN 'DIALECT' ELSE 'PARSE' END", "category": "CASE WHEN k % 3 = 0 THEN 'portability' ELSE 'robustness' END",
     "severity": "CASE WHEN k % 3 = 0 THEN 'medium' ELSE 'high' END", "line": "n", "column": "m", "message": "c",
     "equivalents": "CASE WHEN k % 3 = 0 THEN 'SC3* SC2039 SC2112 SC2113 CB' ELSE 'SYNTAX SC1*' END"}]))
def tool_shfmt_retry(spark: SparkSession, sf: str) -> DataFrame:
    raw = outputs(spark, sf, "a.sh:@N:@M: @C", ("reached EOF",))
    return shape(T.shfmt_errors(raw.withColumn("retry_output", F.when(F.col("v") == 0, "").when(F.col("v") == 1, F.col("output")))))


_add("bashate", T.bashate, "x.sh:@N:1: @C text @K\n[E] E040: broken\n - x.sh : L7\n[W] W001: nowhere", ("E042", "E006", "E041"), [
    {"rule": "c", "category": case("c", {"E042": "robustness", "E006": "maintainability", "E041": "portability"}), "severity": "'low'", "line": "n", "message": "'text ' || k"},
    {"rule": "'E040'", "category": "'robustness'", "severity": "'high'", "line": "7", "message": "'broken'", "equivalents": "'SYNTAX SC1*'"},
    {"rule": "'W001'", "category": "'maintainability'", "severity": "'low'", "line": "0", "message": "'nowhere'"}])

_add("checkbashisms", T.checkbashisms, "possible bashism in x.sh line @N (@C):\n  code here\npossible bashism in x.sh line 3 (let):", ("'function'", "[[ ]]"), [
    {"rule": "'CB'", "category": "'portability'", "severity": "'medium'", "line": "n", "message": "'possible bashism: ' || c", "equivalents": "'SC3* SC2039 SC2112 SC2113 DIALECT POR003'"},
    {"rule": "'CB'", "category": "'portability'", "severity": "'medium'", "line": "3", "message": "'possible bashism: let'", "equivalents": "'SC3* SC2039 SC2112 SC2113 DIALECT POR003'"}])

_RUFF_CLASS = {"F401": ("maintainability", "low"), "S602": ("security", "high"), "PLW0603": ("robustness", "low"), "PERF203": ("performance", "low"), "E902": ("robustness", "high"),
               "S999": ("security", "medium"), "Z1": ("maintainability", "low"), "C901": ("maintainability", "low")}
_add("ruff", T.ruff, "warning: log\n" + json.dumps([
    {"code": "@C", "message": "m", "location": {"row": "@N", "column": 2}, "end_location": {"row": 9, "column": 1}, "url": None, "fix": {"applicability": "safe", "edits": []}},
    {"code": None, "message": "x added in Python 3.12", "location": {"row": 1, "column": 1}}]), tuple(_RUFF_CLASS), [
    {"rule": "c", "category": case("c", {k: v[0] for k, v in _RUFF_CLASS.items()}), "severity": case("c", {k: v[1] for k, v in _RUFF_CLASS.items()}), "line": "n", "column": "2", "message": "'m'",
     "equivalents": case("c", {"F401": "W0611", "S602": "B602", "PLW0603": "W0603", "S999": "B999", "C901": "R1260 CC"}, "''")},
    {"rule": "'invalid-syntax'", "category": "'portability'", "severity": "'high'", "line": "1", "column": "1", "message": "'x added in Python 3.12'", "equivalents": "'VERMIN PYRIGHT'"}])

_add("bandit", T.bandit, json.dumps({"results": [
    {"test_id": "@C", "issue_severity": "HIGH", "issue_confidence": "LOW", "issue_text": "Possible hardcoded password: 'a1b2c3d4e@M'", "line_number": "@N", "line_range": [1, "12", 4], "col_offset": 4,
     "issue_cwe": {"id": 78}}]}), ("B105", "B602", "B101"), [
    {"rule": "c", "category": case("c", {"B105": "security", "B602": "security", "B101": "robustness"}), "severity": case("c", {"B105": "critical", "B602": "medium", "B101": "low"}), "line": "n", "column": "5",
     "message": "CASE WHEN c = 'B105' THEN 'Possible hardcoded password' ELSE 'Possible hardcoded password: ''a1b2c3d4e' || m || '''' END",
     "equivalents": "'S' || substr(c, 2) || CASE WHEN c = 'B105' THEN ' " + " ".join(T.SECRET_CODES) + "' ELSE '' END"}])

_add("semgrep", T.semgrep, json.dumps({"results": [
    {"check_id": "python.lang.@C", "start": {"line": "@N", "col": 3}, "end": {"line": 60, "col": 9}, "extra": {"message": "first\nsecond", "severity": "ERROR", "fix": "y",
     "metadata": {"category": "security", "confidence": "LOW", "cwe": ["CWE-78: x", "CWE-79: y"], "owasp": "A03:2021 - z"}}}], "errors": []}), ("exec-use", "hardcoded-password"), [
    {"rule": "c", "category": "'security'", "severity": "'medium'", "line": "n", "column": "3", "message": "CASE WHEN c = 'exec-use' THEN 'first' ELSE 'possible hard-coded secret (' || c || ')' END",
     "equivalents": _lit(" ".join(f"{p}{n}*" for p in "BS" for n in range(1, 8)))}])

_add("mypy", T.mypy, '{"line": @N, "column": 1, "message": "bad", "hint": "try @C", "code": "arg-type", "severity": "error"}\n{"line": 1, "message": "n", "severity": "note"}\nnot json\n'
     '{"line": "2", "column": "@M", "message": "oops", "hint": null, "code": "syntax", "severity": "error"}', ("x",), [
    {"rule": "'arg-type'", "category": "'robustness'", "severity": "'medium'", "line": "n", "column": "1", "message": "'bad (try x)'", "equivalents": "'report*'"},
    {"rule": "'syntax'", "category": "'robustness'", "severity": "'critical'", "line": "2", "column": "m", "message": "'oops'", "equivalents": _lit("report* SYNTAX " + " ".join(T.PY_SYNTAX))}])

_add("pyright", T.pyright, json.dumps({"generalDiagnostics": [
    {"severity": "error", "message": "first\nmore", "rule": "report@C", "range": {"start": {"line": "@N", "character": 0}, "end": {"line": 3}}},
    {"severity": "warning", "message": "Match needs Python 3.10", "range": {"start": {"line": 0, "character": 4}}}, {"severity": "information", "message": "x", "range": {}}]}), ("A", "B"), [
    {"rule": "'report' || c", "category": "'robustness'", "severity": "'medium'", "line": "n + 1", "column": "1", "message": "'first'"},
    {"rule": "'PYRIGHT'", "category": "'portability'", "severity": "'high'", "line": "1", "column": "5", "message": "'Match needs Python 3.10'", "equivalents": "'VERMIN invalid-syntax'"}])

_add("pylint", T.pylint, json.dumps({"messages": [
    {"type": "warning", "symbol": "s", "messageId": "@C", "message": "a\nb", "line": "@N", "column": 0, "endLine": None}, {"type": "info", "messageId": "I0011", "message": "x", "line": 1}]}),
    ("W0611", "W0123", "W9999", "E0001"), [
    {"rule": "c", "category": case("c", {"W0123": "security"}, "'robustness'"), "severity": case("c", {"W0123": "medium", "E0001": "critical"}, "'low'"), "line": "n", "column": "1", "message": "'a'",
     "equivalents": "'PL' || c || " + case("c", {"W0611": " F401", "W0123": " S307 B307 S307", "E0001": " SYNTAX " + " ".join(T.PY_SYNTAX)}, "''")}])

_add("radon_complexity", T.radon_complexity, json.dumps({"f.py": [
    {"type": "function", "name": "f", "rank": "C", "complexity": "1@M", "lineno": "@N"},
    {"type": "class", "name": "K", "rank": "F", "complexity": 50, "lineno": 60, "methods": [{"type": "method", "name": "g@C", "rank": "E", "complexity": 31, "lineno": 61}]}]}), ("a",), [
    {"rule": "'CC'", "category": "'maintainability'", "severity": "'low'", "line": "n", "message": "'complexity of f is ' || (10 + m) || ' (C)'", "equivalents": "'C901 PLR0912 R0912'", "where": "10 + m >= 11"},
    {"rule": "'CC'", "category": "'maintainability'", "severity": "'high'", "line": "61", "message": "'complexity of ga is 31 (E)'", "equivalents": "'C901 PLR0912 R0912'"}])

_add("radon_index", T.radon_index, '{"f.py": {"mi": 1@M.25, "rank": "@C"}}', ("A", "B", "C"), [
    {"rule": "'MI'", "category": "'maintainability'", "severity": "CASE WHEN c = 'C' THEN 'medium' ELSE 'low' END", "line": "0",
     "message": "'maintainability index is 1' || m || '.3 (' || c || ')'", "where": "c <> 'A'"}])

_add("vermin", T.vermin, "f.py:@N:@M:!2:3.10:@C\nf.py:2::!2:!3:print\nMinimum required versions: 3.10", ("match",), [
    {"rule": "'VERMIN'", "category": "'portability'", "severity": "'high'", "line": "n", "column": "m", "message": "'match needs Python 3.10 (target 3.9)'", "equivalents": "'PYRIGHT'"},
    {"rule": "'VERMIN'", "category": "'portability'", "severity": "'high'", "line": "2", "message": "'print is not in Python 3'", "equivalents": "'PYRIGHT'"}])

_add("hadolint", T.hadolint, json.dumps([{"code": "@C", "level": "warning", "line": "@N", "column": 1, "message": "m"}, {"code": "SC2086", "level": "info", "line": 1, "column": 1, "message": "x"}]), ("DL3006", "DL9999", "DL4006"), [
    {"rule": "c", "category": case("c", {"DL3006": "security", "DL9999": "maintainability", "DL4006": "robustness"}), "severity": "'medium'", "line": "n", "column": "1", "message": "'m'",
     "equivalents": case("c", {"DL3006": "DKR001", "DL4006": "ROB002"}, "''")}])

_add("actionlint", T.actionlint, json.dumps([{"kind": "expression", "message": "@C see https://x", "line": "@N", "column": 4}, {"kind": "shellcheck", "message": "x", "line": 1, "column": 1}, {"kind": "permissions", "message": "p", "line": 1, "column": 1}]),
     ("\\\"a\\\" is potentially untrusted", "undefined"), [
    {"rule": "'expression'", "category": "CASE WHEN c LIKE '%untrusted' THEN 'security' ELSE 'robustness' END", "severity": "CASE WHEN c LIKE '%untrusted' THEN 'critical' ELSE 'medium' END", "line": "n", "column": "4",
     "message": "replace(c, '\\', '')", "equivalents": "CASE WHEN c LIKE '%untrusted' THEN 'SEC023' ELSE '' END"},
    {"rule": "'permissions'", "category": "'security'", "severity": "'medium'", "line": "1", "column": "1", "message": "'p'"}])

_add("zizmor", T.zizmor, json.dumps([{"ident": "@C", "desc": "d", "url": "u", "determinations": {"severity": "High", "confidence": "Low"}, "locations": [
    {"symbolic": {"kind": "Related", "annotation": "r"}, "concrete": {"location": {"start_point": {"row": 1, "column": 1}}}},
    {"symbolic": {"kind": "Primary", "annotation": "here"}, "concrete": {"location": {"start_point": {"row": "@N", "column": "@M"}}}}]}]), ("unpinned-uses", "artipacked"), [
    {"rule": "c", "category": "'security'", "severity": "'medium'", "line": "n + 1", "column": "m + 1", "message": "'d (here)'", "equivalents": case("c", {"unpinned-uses": "CI001"}, "''")}])

_add("gitleaks", T.gitleaks, "12:00AM INF scan completed\n" + json.dumps([{"Description": "Key @M", "StartLine": "@N", "StartColumn": 3, "Secret": "REDACTED", "RuleID": "@C"}]), ("aws", "generic"), [
    {"rule": "'GL:' || c", "category": "'security'", "severity": "'critical'", "line": "n", "column": "3", "message": "'secret found: Key ' || m"}])

_add("trufflehog", T.trufflehog, 'log\n{"SourceMetadata":{"Data":{"Filesystem":{"line":@N}}},"DetectorName":"@C","Verified":false,"Raw":"x"}\n{"SourceMetadata":{"Data":{"Filesystem":{"line":9}}},"DetectorName":"AWS","Verified":true}',
     ("Github", "Slack"), [
    {"rule": "'TH:' || c", "category": "'security'", "severity": "'high'", "line": "n", "message": "'secret found: ' || c"},
    {"rule": "'TH:AWS'", "category": "'security'", "severity": "'critical'", "line": "9", "message": "'secret found: AWS'"}])


@query("tool_pip_audit", """WITH b AS (SELECT 'f' || o_orderkey AS path, CAST(o_orderkey % 50 + 1 AS INTEGER) AS n, o_orderkey AS k FROM orders)
 SELECT path, 'PYSEC-' || k AS rule, 'security' AS category, 'high' AS severity, n AS line, CAST(0 AS INTEGER) AS "column", 'Req.Lib 1.0: known vulnerability (CVE-1)' AS message, '' AS equivalents FROM b WHERE k % 2 = 0""")
def tool_pip_audit(spark: SparkSession, sf: str) -> DataFrame:
    raw = outputs(spark, sf, json.dumps({"dependencies": [
        {"name": "Req.Lib", "version": "1.0", "vulns": [{"id": "PYSEC-@K", "aliases": ["CVE-1"], "fix_versions": ["1.1"]}]}, {"name": "unused", "version": "2", "vulns": [{"id": "X", "aliases": [], "fix_versions": []}]}]}), ("x",))
    imports = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(
        F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.lit("req-lib").alias("dist"), (F.col("o_orderkey") % 50 + 1).cast("int").alias("line"))
    return shape(T.pip_audit(raw, imports))


@query("read_outputs", """SELECT 'f' || o_orderkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'gitleaks' ELSE 'hadolint' END AS tool, CAST(o_orderkey % 50 + 1 AS INTEGER) AS line FROM orders""")
def read_outputs(spark: SparkSession, sf: str) -> DataFrame:
    raw = outputs(spark, sf, json.dumps([{"RuleID": "r", "StartLine": "@N", "code": "DL1", "level": "info", "line": "@N", "message": "m"}]), ("x",))
    odd = F.substring("path", 2, 20).cast("bigint") % 2
    return T.read_outputs(raw.withColumn("tool", F.when(odd == 0, "gitleaks").otherwise("hadolint")), ("gitleaks", "hadolint")).select("path", "tool", "line")
