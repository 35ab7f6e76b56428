"""Recorded outputs of external analyzers, ``(path, tool, output)``, read as findings.

Everything is parsed inside the row with JSON and array functions: a scan over tool outputs
needs no shuffle and no Python. Numbers may be strings in some tool versions, so every JSON
field is declared a string first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.functions import scalars as S
from fleetgrade.operators.findings import EDIT, complete

Classes = dict[str, tuple[str, str]]


def _table(groups: dict[tuple[str, str], str]) -> Classes:
    return {code: cls for cls, codes in groups.items() for code in codes.split()}


# Class of the ShellCheck codes.
SHELLCHECK = _table({
    ("security", "critical"): "2114 2115",
    ("security", "high"): "2156",
    ("security", "medium"): "2029 2035 2059 2087 2211 2294",
    ("security", "low"): "2216",
    ("robustness", "high"): "2094 2164 2218",
    ("robustness", "medium"): "2044 2045 2046 2064 2068 2069 2086 2154",
    ("robustness", "low"): "2012 2015 2155 2162",
    ("maintainability", "low"): "1090 2004 2006 2034 2181 2219 2317",
    ("portability", "high"): "2112 2113 3001 3005 3006 3010 3011 3018 3020 3030 3054",
    ("portability", "medium"): "1008 1071 2039 2148",
    ("portability", "low"): "2166 2196 2197 2230",
    ("performance", "low"): "2001 2002 2003 2005 2009 2010 2116 2126 2129 2143 2233 2234 2235",
})
# Class of the bashate codes.
BASHATE = _table({
    ("robustness", "high"): "E040", ("robustness", "low"): "E042 E043 E044",
    ("portability", "low"): "E041", ("maintainability", "low"): "E020",
})
# Class of the Ruff codes, then of the code families.
RUFF = _table({
    ("robustness", "critical"): "invalid-syntax",
    ("robustness", "high"): "F821",
    ("robustness", "medium"): "B006 E722 F811 PLW1510 S113 T100 W605",
    ("robustness", "low"): "B904 S101 S110 S112 SIM115",
    ("maintainability", "low"): "F401 F841",
    ("security", "high"): "S102 S105 S106 S107 S301 S307 S501 S506 S602 S604 S605 S608",
    ("security", "medium"): "S108 S324",
    ("security", "low"): "S311 S603 S607",
    ("portability", "medium"): "EXE003",
    ("portability", "low"): "PLW1514",
})
RUFF_FAMILIES = _table({
    ("robustness", "high"): "E9 PLE", ("robustness", "medium"): "T10 F", ("robustness", "low"): "E7 PLW BLE B",
    ("maintainability", "low"): "E4 E5 PLR SIM PIE RUF ISC UP W A", ("performance", "low"): "PERF ASYNC C4",
    ("portability", "low"): "EXE", ("security", "medium"): "S",
})
# Class of the Bandit codes; others are security by their own severity.
BANDIT = _table({
    ("security", "high"): "B102 B105 B106 B107 B301 B307 B506 B608",
    ("robustness", "medium"): "B113", ("robustness", "low"): "B101 B110 B112",
})
# Class of the Pylint codes.
PYLINT = _table({
    ("security", "medium"): "W0122 W0123", ("robustness", "medium"): "W0102 W0702 W1510",
    ("robustness", "high"): "E0602", ("portability", "low"): "W1514",
})
# Category and equivalents of the hadolint codes.
HADOLINT_CATEGORY = {
    c: cat
    for cat, codes in {
        "security": "DL3002 DL3004 DL3006 DL3007 DL3008 DL3013 DL3015 DL3016 DL3018 DL3028 DL3033 DL3037 DL3041 DL3064",
        "robustness": "DL3003 DL4006",
        "performance": "DL3009 DL3019 DL3032 DL3040 DL3042 DL3060",
    }.items()
    for c in codes.split()
}
HADOLINT_EQUIVALENTS = {
    "DL3002": ("DKR002",), "DL3006": ("DKR001",), "DL3007": ("DKR001",), "DL3013": ("SEC024",), "DL3016": ("SEC024",),
    "DL3028": ("SEC024",), "DL3064": ("DKR005",), "DL3020": ("DKR004",), "DL3003": ("ROB005", "SC2164"), "DL4006": ("ROB002",),
    "DL3009": ("DKR007",), "DL3015": ("DKR006",), "DL3019": ("DKR007",), "DL3040": ("DKR007",), "DL3032": ("DKR007",),
}
ZIZMOR_EQUIVALENTS = {
    "unpinned-uses": ("CI001",), "template-injection": ("SEC023",), "dangerous-triggers": ("CI003",),
    "excessive-permissions": ("CI002",), "hardcoded-container-credentials": ("CI004",), "unpinned-images": ("CI005",),
}
# Codes that mean the same as another tool's.
PY_SYNTAX = ("invalid-syntax", "E999", "E0001", "syntax", "PYRIGHT", "VERMIN")
SECRET_CODES = ("PYSEC001", "GL*", "TH*", "B105", "B106", "B107", "S105", "S106", "S107")
DIALECT_CODES = ("SC3*", "SC2039", "SC2112", "SC2113", "CB")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _lists(table: dict[str, tuple[str, ...]], key: Column) -> Column:
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), _strings(v))])
    return F.coalesce(F.try_element_at(m, key), _strings(()))


def _category(table: Classes, key: Column) -> Column:
    return F.try_element_at(dims.literal_map({k: v[0] for k, v in table.items()}), key)


def _severity(table: Classes, key: Column) -> Column:
    return F.try_element_at(dims.literal_map({k: v[1] for k, v in table.items()}), key)


def _lower(severity: Column) -> Column:
    return dims.severity_name(F.least(dims.severity_rank(severity) + 1, F.lit(3)))


def _json_part(output: Column) -> Column:
    """The document in an output that may start with log text: from the first line that opens one."""
    text = F.trim(output)
    return F.regexp_extract(text, r"(?s)(?:^|\n)([\[{].*)\z", 1)


def _items(raw: DataFrame, schema: str, at: str | None = None) -> DataFrame:
    """Items of a JSON array (``at`` names the field that holds it) as (path, position, d.*)."""
    doc = F.from_json(_json_part(F.col("output")), schema)
    return raw.select("path", F.posexplode(doc[at] if at else doc).alias("position", "d"))


def _text_lines(raw: DataFrame) -> DataFrame:
    lines = F.split(F.replace("output", F.lit("\r"), F.lit("")), "\n")
    return raw.select("path", F.posexplode(lines).alias("position", "text"))


def _int(c: Column) -> Column:
    return F.coalesce(S.json_int(c), F.lit(0))


def _emit(df: DataFrame, tool: str, **columns: Column) -> DataFrame:
    columns.setdefault("column", F.lit(0))
    out = df.select("path", F.lit(tool).alias("tool"), F.col("position").cast("bigint").alias("position"), *[v.alias(k) for k, v in columns.items()])
    return complete(out)


def _first_line(text: Column) -> Column:
    return F.trim(F.substring_index(F.trim(text), "\n", 1))


# ---------------------------------------------------------------- shell tools


def shellcheck(raw: DataFrame) -> DataFrame:
    fix = "struct<replacements:array<struct<line:string,column:string,endLine:string,endColumn:string,replacement:string>>>"
    item = f"struct<code:string,level:string,line:string,column:string,message:string,fix:{fix}>"
    d = _items(raw, f"struct<comments:array<{item}>>", "comments")
    code, level = F.col("d.code"), F.col("d.level")
    number = _int(code)
    by_level = F.when(level == "error", "high").when(level == "warning", "medium").otherwise("low")
    posix, parse = number.between(3000, 3999), (number < 2000) & (level == "error")
    category = F.coalesce(_category(SHELLCHECK, code), F.when(posix, "portability").when(parse, "robustness").when(level == "style", "maintainability").otherwise("robustness"))
    severity = F.coalesce(
        _severity(SHELLCHECK, code),
        F.when(posix, F.when(level.isin("error", "warning"), "medium").otherwise("low")).when(parse, "high").when(level == "style", "low").otherwise(by_level),
    )
    rule = F.concat(F.lit("SC"), code)
    edits = F.transform(
        F.coalesce(F.col("d.fix.replacements"), F.array()),
        lambda r: F.struct(_int(r["line"]), _int(r["column"]), _int(r["endLine"]), _int(r["endColumn"]), r["replacement"], rule).cast(EDIT),
    )
    return _emit(d, "shellcheck", rule=rule, category=category, severity=severity, line=_int(F.col("d.line")), column=_int(F.col("d.column")),
                 message=F.col("d.message"), edits=edits)


def syntax_errors(raw: DataFrame) -> DataFrame:
    """Shell (``file: line N: text``); echo lines of the shell start with a backtick."""
    pattern = r"^[^:]*:\s*(?:line\s+)?(\d+):\s*(.*)\z"
    t = F.trim("text")
    d = _text_lines(raw).select("path", "position", F.regexp_extract(t, pattern, 1).alias("n"), F.trim(F.regexp_extract(t, pattern, 2)).alias("m"))
    return _emit(d.filter("n <> '' and not startswith(m, '`')"), "syntax", rule=F.lit("SYNTAX"), category=F.lit("robustness"), severity=F.lit("critical"),
                 line=F.col("n").cast("int"), message=F.col("m"), equivalents=_strings(("SC1*", "E040")))


def python_syntax_errors(raw: DataFrame) -> DataFrame:
    pattern = r"(?m)^(\d+):(\d+):(.*)$"
    part = lambda g: F.regexp_extract("output", pattern, g)
    d = raw.filter(part(1) != "").withColumn("position", F.lit(0))
    return _emit(d, "syntax", rule=F.lit("SYNTAX"), category=F.lit("robustness"), severity=F.lit("critical"), line=part(1).cast("int"),
                 column=part(2).cast("int"), message=F.trim(part(3)), equivalents=_strings(PY_SYNTAX))


def format_diff(raw: DataFrame, tool: str = "shfmt") -> DataFrame:
    """One finding per hunk of a unified diff, at its first removed line."""
    hunks = F.slice(F.split(F.concat(F.lit("\n"), "output"), r"\n@@ -"), 2, 2**30)
    d = raw.select("path", F.posexplode(hunks).alias("position", "hunk"))
    body = F.slice(F.split("hunk", "\n"), 2, 2**30)
    d = d.withColumn("body", body).withColumn("removed", F.size(F.filter("body", lambda x: F.startswith(x, F.lit("-")))))
    first = F.array_position(F.transform("body", lambda x: F.startswith(x, F.lit("-"))), True).cast("int")
    kept_before = F.size(F.filter(F.slice("body", F.lit(1), F.greatest(first - 1, F.lit(0))), lambda x: F.startswith(x, F.lit(" "))))
    start = F.regexp_extract("hunk", r"^(\d+)(,\d+)? \+\d+(,\d+)? @@", 1)
    d = d.filter((F.col("removed") > 0) & (start != ""))
    return _emit(d, tool, rule=F.lit("FORMAT"), category=F.lit("maintainability"), severity=F.lit("low"), line=(start.cast("int") + kept_before).cast("int"),
                 message=F.concat(F.lit("formatting differs: "), F.col("removed").cast("string"), F.lit(" line(s)")))


_SHFMT = r"^.*?:(\d+):(\d+):\s*(.*)\z"


def shfmt_errors(raw: DataFrame) -> DataFrame:
    """Parse or dialect errors; ``retry_output``, the output in bash mode, turns parse errors of
    a POSIX script that bash accepts into dialect errors."""
    if "retry_output" not in raw.columns:
        raw = raw.withColumn("retry_output", F.lit(None).cast("string"))
    accepted = F.col("retry_output").isNotNull() & ~F.exists(F.split("retry_output", "\n"), lambda x: F.trim(x).rlike(_SHFMT))
    lines = raw.select("path", accepted.alias("ok"), F.posexplode(F.split("output", "\n")).alias("position", "text"))
    t = F.trim("text")
    d = lines.filter(t.rlike(_SHFMT)).withColumn("m", F.regexp_extract(t, _SHFMT, 3))
    dialect = F.col("ok") | F.col("m").rlike(r"(bash|mksh|posix) feature|parsing as posix|not supported")
    return _emit(d, "shfmt", rule=F.when(dialect, "DIALECT").otherwise("PARSE"), category=F.when(dialect, "portability").otherwise("robustness"),
                 severity=F.when(dialect, "medium").otherwise("high"), line=F.regexp_extract(t, _SHFMT, 1).cast("int"),
                 column=F.regexp_extract(t, _SHFMT, 2).cast("int"), message=F.col("m"),
                 equivalents=F.when(dialect, _strings(DIALECT_CODES)).otherwise(_strings(("SYNTAX", "SC1*"))))


def bashate(raw: DataFrame) -> DataFrame:
    modern, legacy, place = r"^.*?:(\d+):(\d+):\s*([EW]\d{3})\s+(.*)\z", r"^\[[EW]\]\s*([EW]\d{3}):\s*(.*)\z", r"^\s*-\s*.*:\s*L(\d+)\s*\z"
    lines = F.split("output", "\n")
    pairs = F.transform(lines, lambda x, i: F.struct(F.trim(x).alias("t"), F.coalesce(F.try_element_at(lines, i + 2), F.lit("")).alias("after")))
    d = raw.select("path", F.posexplode(pairs).alias("position", "p")).select("path", "position", "p.*")
    is_modern = F.col("t").rlike(modern)
    d = d.filter(is_modern | F.col("t").rlike(legacy))
    code = F.when(is_modern, F.regexp_extract("t", modern, 3)).otherwise(F.regexp_extract("t", legacy, 1))
    line = F.when(is_modern, F.regexp_extract("t", modern, 1)).otherwise(F.regexp_extract("after", place, 1))
    message = F.when(is_modern, F.regexp_extract("t", modern, 4)).otherwise(F.regexp_extract("t", legacy, 2))
    return _emit(d, "bashate", rule=code, category=F.coalesce(_category(BASHATE, code), F.lit("maintainability")), severity=F.coalesce(_severity(BASHATE, code), F.lit("low")),
                 line=F.coalesce(line.try_cast("int"), F.lit(0)), message=F.trim(message),
                 equivalents=F.when(code == "E040", _strings(("SYNTAX", "SC1*"))).otherwise(_strings(())))


def checkbashisms(raw: DataFrame) -> DataFrame:
    pattern = r"^possible bashism in .* line (\d+) \((.*)\):\s*\z"
    lines = F.split("output", "\n")
    pairs = F.transform(lines, lambda x, i: F.struct(x.alias("t"), F.try_element_at(lines, i + 2).alias("after")))
    d = raw.select("path", F.posexplode(pairs).alias("position", "p")).select("path", "position", "p.*").filter(F.col("t").rlike(pattern))
    return _emit(d, "checkbashisms", rule=F.lit("CB"), category=F.lit("portability"), severity=F.lit("medium"), line=F.regexp_extract("t", pattern, 1).cast("int"),
                 message=F.concat(F.lit("possible bashism: "), F.regexp_extract("t", pattern, 2)),
                 snippet=F.when(~F.startswith("after", F.lit("possible bashism")), F.trim("after")),
                 equivalents=_strings(("SC3*", "SC2039", "SC2112", "SC2113", "DIALECT", "POR003")))


# ---------------------------------------------------------------- Python tools


def ruff(raw: DataFrame) -> DataFrame:
    place = "struct<row:string,column:string>"
    item = (f"struct<code:string,message:string,url:string,location:{place},end_location:{place},"
            f"fix:struct<applicability:string,edits:array<struct<content:string,location:{place},end_location:{place}>>>>")
    d = _items(raw, f"array<{item}>")
    code = F.coalesce("d.code", F.lit("invalid-syntax"))
    version_only = (code == "invalid-syntax") & F.col("d.message").rlike(r"(on|added in) Python 3\.\d+")

    def classed(pick) -> Column:
        # The longest family prefix wins: try four letters, then three, two, one.
        return F.coalesce(pick(RUFF, code), *[pick(RUFF_FAMILIES, F.substring(code, 1, n)) for n in (5, 4, 3, 2, 1)])

    bandit = F.when(code.rlike(r"^S\d{3}\z"), F.array(F.concat(F.lit("B"), F.substring(code, 2, 3)))).otherwise(_strings(()))
    pylint = F.when(code.rlike(r"^PL[CERW]\d{4}\z"), F.array(F.substring(code, 3, 5))).otherwise(_strings(()))
    same = _lists({a: (b,) for a, b in dims.SAME_PYTHON}, code)
    complexity = F.when(code.isin("C901", "PLR0912"), _strings(("CC",))).otherwise(_strings(()))
    secret = F.when(code.isin("S105", "S106", "S107"), _strings(SECRET_CODES)).otherwise(_strings(()))
    broken = F.when(code == "invalid-syntax", _strings(("SYNTAX", *PY_SYNTAX))).otherwise(_strings(()))
    edits = F.when(F.col("d.fix.applicability") == "safe", F.transform(
        F.filter(F.col("d.fix.edits"), lambda e: e["location"].isNotNull() & e["end_location"].isNotNull()),
        lambda e: F.struct(_int(e["location"]["row"]), _int(e["location"]["column"]), _int(e["end_location"]["row"]), _int(e["end_location"]["column"]),
                           F.coalesce(e["content"], F.lit("")), code).cast(EDIT)))
    return _emit(d, "ruff", rule=code, category=F.when(version_only, "portability").otherwise(F.coalesce(classed(_category), F.lit("maintainability"))),
                 severity=F.when(version_only, "high").otherwise(F.coalesce(classed(_severity), F.lit("low"))),
                 line=_int(F.col("d.location.row")), end_line=S.json_int(F.col("d.end_location.row")), column=_int(F.col("d.location.column")),
                 message=F.col("d.message"), url=F.col("d.url"),
                 equivalents=F.when(version_only, _strings(("VERMIN", "PYRIGHT"))).otherwise(F.concat(bandit, pylint, same, complexity, secret, broken)),
                 edits=F.coalesce(edits, F.array().cast(f"array<{EDIT}>")))


def bandit(raw: DataFrame) -> DataFrame:
    item = ("struct<test_id:string,issue_severity:string,issue_confidence:string,issue_text:string,line_number:string,line_range:array<string>,"
            "col_offset:string,more_info:string,issue_cwe:struct<id:string>>")
    d = _items(raw, f"struct<results:array<{item}>>", "results")
    rule, text = F.col("d.test_id"), F.col("d.issue_text")
    secret = rule.isin("B105", "B106", "B107")
    own = F.when(F.upper("d.issue_severity") == "HIGH", "high").when(F.upper("d.issue_severity") == "MEDIUM", "medium").otherwise("low")
    own = F.when(F.upper("d.issue_confidence") == "LOW", _lower(own)).otherwise(own)
    real = S.looks_like_real_secret(F.regexp_extract(text, r"'(.*)'\s*\z", 1))
    cwe = S.json_int(F.col("d.issue_cwe.id"))
    return _emit(d, "bandit", rule=rule, category=F.coalesce(_category(BANDIT, rule), F.lit("security")),
                 severity=F.when(secret & real, "critical").otherwise(F.coalesce(_severity(BANDIT, rule), own)),
                 line=_int(F.col("d.line_number")), end_line=F.array_max(F.transform("d.line_range", S.json_int)),
                 column=(F.coalesce(S.json_int(F.col("d.col_offset")), F.lit(-1)) + 1).cast("int"),
                 message=F.when(secret, F.substring_index(text, ":", 1)).otherwise(text), url=F.col("d.more_info"),
                 refs=F.when(cwe.isNotNull(), F.array(F.concat(F.lit("CWE-"), cwe.cast("string")))).otherwise(_strings(())),
                 equivalents=F.concat(F.array(F.concat(F.lit("S"), F.substr(rule, F.lit(2)))), F.when(rule == "B307", _strings(("W0123",))).otherwise(_strings(())),
                                      F.when(secret, _strings(SECRET_CODES)).otherwise(_strings(()))))


def semgrep(raw: DataFrame) -> DataFrame:
    point = "struct<line:string,col:string>"
    meta = "struct<category:string,confidence:string,cwe:string,owasp:string,source:string,shortlink:string>"
    item = f"struct<check_id:string,start:{point},end:{point},extra:struct<message:string,severity:string,fix:string,metadata:{meta}>>"
    d = _items(raw, f"struct<results:array<{item}>>", "results")
    m = F.col("d.extra.metadata")
    category = (F.when(F.lower(m["category"]) == "security", "security").when(F.lower(m["category"]) == "correctness", "robustness")
                .when(F.lower(m["category"]).isin("performance", "portability"), F.lower(m["category"])).otherwise("maintainability"))
    level = F.upper("d.extra.severity")
    severity = F.when(level.isin("ERROR", "HIGH", "CRITICAL"), "high").when(level.isin("WARNING", "MEDIUM"), "medium").otherwise("low")
    severity = F.when(F.upper(m["confidence"]) == "LOW", _lower(severity)).otherwise(severity)
    rule = F.element_at(F.split("d.check_id", r"\."), -1)
    secret = F.lower(rule).rlike(r"secret|password|passwd|token|credential|api-?key|private-key")
    # A reference field is one string or a list: its text holds the entries either way.
    cwe = F.transform(F.regexp_extract_all(F.coalesce(m["cwe"], F.lit("")), F.lit(r'(?:^|")CWE-(\d+)'), F.lit(1)), lambda n: F.concat(F.lit("CWE-"), n))
    owasp = F.transform(F.regexp_extract_all(F.coalesce(m["owasp"], F.lit("")), F.lit(r'(?:^|")(A\d\d):2021\b'), F.lit(1)), lambda n: F.concat(F.lit("OWASP "), n, F.lit(":2021")))
    line, end = _int(F.col("d.start.line")), S.json_int(F.col("d.end.line"))
    fix = F.when(~secret & F.col("d.extra.fix").isNotNull() & end.isNotNull(), F.array(
        F.struct(line, _int(F.col("d.start.col")), end, _int(F.col("d.end.col")), F.col("d.extra.fix"), rule).cast(EDIT)))
    return _emit(d, "semgrep", rule=rule, category=category, severity=severity, line=line, end_line=end, column=_int(F.col("d.start.col")),
                 message=F.when(secret, F.concat(F.lit("possible hard-coded secret ("), rule, F.lit(")"))).otherwise(_first_line(F.col("d.extra.message"))),
                 url=F.coalesce(m["source"], m["shortlink"]), refs=F.concat(cwe, owasp),
                 equivalents=_strings([f"{p}{n}*" for p in "BS" for n in range(1, 8)]), edits=F.coalesce(fix, F.array().cast(f"array<{EDIT}>")))


def mypy(raw: DataFrame) -> DataFrame:
    item = "struct<line:string,end_line:string,column:string,message:string,hint:string,code:string,severity:string>"
    d = _text_lines(raw).filter(F.ltrim("text").startswith("{")).select("path", "position", F.from_json(F.trim("text"), item).alias("d"))
    d = d.filter(F.col("d.message").isNotNull() & ~F.col("d.severity").eqNullSafe("note"))
    code = F.coalesce("d.code", F.lit("misc"))
    syntax = code == "syntax"
    return _emit(d, "mypy", rule=code, category=F.lit("robustness"), severity=F.when(syntax, "critical").otherwise("medium"), line=_int(F.col("d.line")),
                 end_line=S.json_int(F.col("d.end_line")), column=_int(F.col("d.column")),
                 message=F.when(F.length("d.hint") > 0, F.concat("d.message", F.lit(" ("), "d.hint", F.lit(")"))).otherwise(F.col("d.message")),
                 url=F.concat(F.lit("https://mypy.readthedocs.io/en/stable/error_code_list.html#code-"), code),
                 equivalents=F.concat(_strings(("report*",)), F.when(syntax, _strings(("SYNTAX", *PY_SYNTAX))).otherwise(_strings(()))))


def pyright(raw: DataFrame) -> DataFrame:
    point = "struct<line:string,character:string>"
    item = f"struct<severity:string,message:string,rule:string,range:struct<start:{point},end:{point}>>"
    d = _items(raw, f"struct<generalDiagnostics:array<{item}>>", "generalDiagnostics").filter(F.col("d.severity").isin("error", "warning"))
    message = _first_line(F.col("d.message"))
    anonymous = F.col("d.rule").isNull()
    version_only = anonymous & message.rlike(r"Python 3\.\d+")
    plus = lambda c: (F.coalesce(S.json_int(c), F.lit(-1)) + 1).cast("int")
    return _emit(d, "pyright", rule=F.coalesce("d.rule", F.lit("PYRIGHT")), category=F.when(version_only, "portability").otherwise("robustness"),
                 severity=F.when(version_only, "high").when(F.col("d.severity") == "error", "medium").otherwise("low"),
                 line=plus(F.col("d.range.start.line")), end_line=S.json_int(F.col("d.range.end.line")) + 1, column=plus(F.col("d.range.start.character")), message=message,
                 url=F.when(~anonymous, F.concat(F.lit("https://microsoft.github.io/pyright/#/configuration?id="), "d.rule")),
                 equivalents=F.when(version_only, _strings(("VERMIN", "invalid-syntax"))).when(anonymous, _strings(("SYNTAX", *PY_SYNTAX))).otherwise(_strings(())))


def pylint(raw: DataFrame) -> DataFrame:
    item = "struct<type:string,symbol:string,message:string,messageId:string,line:string,endLine:string,column:string>"
    kinds = {"fatal": ("robustness", "high"), "error": ("robustness", "medium"), "warning": ("robustness", "low"),
             "refactor": ("maintainability", "low"), "convention": ("maintainability", "low")}
    d = _items(raw, f"struct<messages:array<{item}>>", "messages").filter(F.col("d.type").isin(*kinds))
    rule = F.col("d.messageId")
    syntax = rule == "E0001"
    return _emit(d, "pylint", rule=rule, category=F.coalesce(_category(PYLINT, rule), _category(kinds, F.col("d.type"))),
                 severity=F.when(syntax, "critical").otherwise(F.coalesce(_severity(PYLINT, rule), _severity(kinds, F.col("d.type")))),
                 line=_int(F.col("d.line")), end_line=S.json_int(F.col("d.endLine")), column=(F.coalesce(S.json_int(F.col("d.column")), F.lit(-1)) + 1).cast("int"),
                 message=F.substring_index("d.message", "\n", 1),
                 url=F.concat(F.lit("https://pylint.readthedocs.io/en/stable/user_guide/messages/"), "d.type", F.lit("/"), "d.symbol", F.lit(".html")),
                 equivalents=F.concat(F.array(F.concat(F.lit("PL"), rule)), _lists({b: (a,) for a, b in dims.SAME_PYTHON}, rule),
                                      F.when(rule == "W0123", _strings(("B307", "S307"))).otherwise(_strings(())),
                                      F.when(rule == "R0912", _strings(("CC",))).otherwise(_strings(())),
                                      F.when(syntax, _strings(("SYNTAX", *PY_SYNTAX))).otherwise(_strings(()))))


_RADON = "https://radon.readthedocs.io/en/latest/intro.html#"


def radon_complexity(raw: DataFrame) -> DataFrame:
    block = "type:string,name:string,rank:string,complexity:string,lineno:string"
    item = f"struct<{block},methods:array<struct<{block}>>>"
    doc = F.from_json(_json_part(F.col("output")), f"map<string,array<{item}>>")
    outer = raw.select("path", F.explode(F.flatten(F.map_values(doc))).alias("o"))
    plain = lambda b: F.struct(*[b[f].alias(f) for f in ("type", "name", "rank", "complexity", "lineno")])
    every = F.concat(F.coalesce(F.transform("o.methods", plain), F.array().cast(f"array<struct<{block}>>")), F.array(plain(F.col("o"))))
    d = outer.select("path", F.explode(every).alias("d")).filter(~F.col("d.type").eqNullSafe("class"))
    n = _int(F.col("d.complexity"))
    d = d.filter(n >= 11).withColumn("position", _int(F.col("d.lineno")))
    return _emit(d, "radon", rule=F.lit("CC"), category=F.lit("maintainability"), severity=F.when(n > 30, "high").when(n > 20, "medium").otherwise("low"),
                 line=_int(F.col("d.lineno")), message=F.concat(F.lit("complexity of "), "d.name", F.lit(" is "), n.cast("string"), F.lit(" ("), "d.rank", F.lit(")")),
                 url=F.lit(_RADON + "cyclomatic-complexity"), equivalents=_strings(("C901", "PLR0912", "R0912")))


def radon_index(raw: DataFrame) -> DataFrame:
    doc = F.from_json(_json_part(F.col("output")), "map<string,struct<mi:double,rank:string>>")
    d = raw.select("path", F.posexplode(F.map_values(doc)).alias("position", "d")).filter("d.mi is not null and d.rank <> 'A'")
    d = d.withColumn("position", F.lit(10**9) + F.col("position"))
    return _emit(d, "radon", rule=F.lit("MI"), category=F.lit("maintainability"), severity=F.when(F.col("d.rank") == "C", "medium").otherwise("low"), line=F.lit(0),
                 message=F.format_string("maintainability index is %.1f (%s)", "d.mi", "d.rank"), url=F.lit(_RADON + "maintainability-index"))


def vermin(raw: DataFrame, target: str = "3.9") -> DataFrame:
    pattern = r"^(.*?):(\d+):(\d*):([^:]*):([^:]*):(.+)\z"
    t = F.trim("text")
    part = lambda g: F.regexp_extract(t, pattern, g)
    d = _text_lines(raw).filter(t.rlike(pattern))
    needs, feature = F.trim(part(5)), F.trim(part(6))
    return _emit(d, "vermin", rule=F.lit("VERMIN"), category=F.lit("portability"), severity=F.lit("high"), line=part(2).cast("int"),
                 column=F.coalesce(part(3).try_cast("int"), F.lit(0)),
                 message=F.when(F.startswith(needs, F.lit("!")), F.concat(feature, F.lit(" is not in Python 3"))).otherwise(
                     F.concat(feature, F.lit(" needs Python "), needs, F.lit(f" (target {target})"))),
                 url=F.lit("https://github.com/netromdk/vermin"), equivalents=_strings(("PYRIGHT",)))


def pip_audit(raw: DataFrame, imports: DataFrame) -> DataFrame:
    """Vulnerable distributions at the line that imports them; ``imports(path, dist, line)``."""
    item = "struct<name:string,version:string,vulns:array<struct<id:string,aliases:array<string>,fix_versions:array<string>>>>"
    d = _items(raw, f"struct<dependencies:array<{item}>>", "dependencies")
    d = d.select("path", S.normalize_dist(F.col("d.name")).alias("dist"), F.col("d.name").alias("name"), F.col("d.version").alias("version"),
                 "position", F.posexplode("d.vulns").alias("v_at", "v"))
    at = imports.groupBy("path", "dist").agg(F.min("line").alias("at"))
    d = d.join(at, ["path", "dist"]).withColumn("position", F.col("position").cast("bigint") * 1000 + F.col("v_at"))
    return _emit(d, "pip-audit", rule=F.col("v.id"), category=F.lit("security"), severity=F.lit("high"), line=F.col("at").cast("int"),
                 message=F.concat("name", F.lit(" "), "version", F.lit(": known vulnerability"),
                                  F.when(F.size("v.aliases") > 0, F.concat(F.lit(" ("), F.array_join("v.aliases", ", "), F.lit(")"))).otherwise("")),
                 hint=F.when(F.size("v.fix_versions") > 0, F.concat(F.lit("Upgrade to "), F.element_at("v.fix_versions", 1), F.lit(" or later."))).otherwise(
                     "No fixed version: replace the package."),
                 url=F.concat(F.lit("https://osv.dev/vulnerability/"), "v.id"))


# ---------------------------------------------------------------- container, pipeline and secret tools


def hadolint(raw: DataFrame) -> DataFrame:
    d = _items(raw, "array<struct<code:string,level:string,line:string,column:string,message:string>>").filter(~F.startswith("d.code", F.lit("SC")))
    code, level = F.col("d.code"), F.col("d.level")
    return _emit(d, "hadolint", rule=code, category=F.coalesce(F.try_element_at(dims.literal_map(HADOLINT_CATEGORY), code), F.lit("maintainability")),
                 severity=F.when(level == "error", "high").when(level == "warning", "medium").otherwise("low"), line=_int(F.col("d.line")), column=_int(F.col("d.column")),
                 message=F.col("d.message"), url=F.when(F.startswith(code, F.lit("DL")), F.concat(F.lit("https://github.com/hadolint/hadolint/wiki/"), code)),
                 equivalents=_lists(HADOLINT_EQUIVALENTS, code))


def actionlint(raw: DataFrame) -> DataFrame:
    d = _items(raw, "array<struct<kind:string,message:string,line:string,column:string>>").filter(~F.col("d.kind").isin("shellcheck", "pyflakes"))
    kind, message = F.col("d.kind"), F.col("d.message")
    untrusted = F.contains(message, F.lit("potentially untrusted"))
    security = kind.isin("credentials", "permissions") | ((kind == "expression") & untrusted)
    return _emit(d, "actionlint", rule=kind, category=F.when(security, "security").otherwise("robustness"), severity=F.when(untrusted, "critical").otherwise("medium"),
                 line=_int(F.col("d.line")), column=_int(F.col("d.column")), message=F.substring_index(message, " see https://", 1),
                 url=F.lit("https://github.com/rhysd/actionlint/blob/main/docs/checks.md"),
                 equivalents=F.when(untrusted, _strings(("SEC023",))).otherwise(_strings(())))


def zizmor(raw: DataFrame) -> DataFrame:
    spot = "struct<symbolic:struct<kind:string,annotation:string>,concrete:struct<location:struct<start_point:struct<row:string,column:string>>>>"
    item = f"struct<ident:string,desc:string,url:string,determinations:struct<severity:string,confidence:string>,locations:array<{spot}>>"
    d = _items(raw, f"array<{item}>")
    primary = F.coalesce(F.try_element_at(F.filter("d.locations", lambda x: x["symbolic"]["kind"] == "Primary"), F.lit(1)), F.try_element_at("d.locations", F.lit(1)))
    d = d.withColumn("p", primary)
    own = F.when(F.col("d.determinations.severity") == "High", "high").when(F.col("d.determinations.severity") == "Medium", "medium").otherwise("low")
    plus = lambda c: (F.coalesce(S.json_int(c), F.lit(-1)) + 1).cast("int")
    note = F.col("p.symbolic.annotation")
    return _emit(d, "zizmor", rule=F.col("d.ident"), category=F.lit("security"), severity=F.when(F.col("d.determinations.confidence") == "Low", _lower(own)).otherwise(own),
                 line=plus(F.col("p.concrete.location.start_point.row")), column=plus(F.col("p.concrete.location.start_point.column")),
                 message=F.when(note.isNull(), F.col("d.desc")).otherwise(F.concat("d.desc", F.lit(" ("), note, F.lit(")"))), url=F.col("d.url"),
                 equivalents=_lists(ZIZMOR_EQUIVALENTS, F.col("d.ident")))


def gitleaks(raw: DataFrame) -> DataFrame:
    d = _items(raw, "array<struct<RuleID:string,Description:string,StartLine:string,StartColumn:string>>")
    return _emit(d, "gitleaks", rule=F.concat(F.lit("GL:"), "d.RuleID"), category=F.lit("security"), severity=F.lit("critical"), line=_int(F.col("d.StartLine")),
                 column=_int(F.col("d.StartColumn")), message=F.concat(F.lit("secret found: "), F.coalesce("d.Description", "d.RuleID")))


def trufflehog(raw: DataFrame) -> DataFrame:
    item = "struct<DetectorName:string,Verified:boolean,SourceMetadata:struct<Data:struct<Filesystem:struct<line:string>>>>"
    d = _text_lines(raw).filter(F.startswith("text", F.lit("{"))).select("path", "position", F.from_json("text", item).alias("d")).filter("d.DetectorName is not null")
    return _emit(d, "trufflehog", rule=F.concat(F.lit("TH:"), "d.DetectorName"), category=F.lit("security"),
                 severity=F.when(F.col("d.Verified"), "critical").otherwise("high"), line=_int(F.col("d.SourceMetadata.Data.Filesystem.line")),
                 message=F.concat(F.lit("secret found: "), "d.DetectorName"))


READERS = {
    "shellcheck": shellcheck, "syntax": syntax_errors, "python-syntax": python_syntax_errors, "shfmt-diff": format_diff,
    "ruff-format": lambda raw: format_diff(raw, "ruff"), "shfmt": shfmt_errors, "bashate": bashate, "checkbashisms": checkbashisms,
    "ruff": ruff, "bandit": bandit, "semgrep": semgrep, "mypy": mypy, "pyright": pyright, "pylint": pylint, "radon-cc": radon_complexity,
    "radon-mi": radon_index, "vermin": vermin, "hadolint": hadolint, "actionlint": actionlint, "zizmor": zizmor, "gitleaks": gitleaks,
    "trufflehog": trufflehog,
}


# Readers whose findings carry the name of another tool.
EMITTED = {"shfmt-diff": "shfmt", "ruff-format": "ruff", "python-syntax": "syntax", "radon-cc": "radon", "radon-mi": "radon"}


def read_outputs(raw: DataFrame, tools: tuple[str, ...] = tuple(READERS), imports: DataFrame | None = None) -> DataFrame:
    """Findings of all recorded outputs; each reader sees only the rows of its tool.

    Audits of dependencies are read where ``imports(path, dist, line)`` says what a file imports.
    """
    parts = [READERS[t](raw.filter(F.col("tool") == t)) for t in tools]
    if imports is not None:
        parts.append(pip_audit(raw.filter("tool = 'pip-audit'"), imports))
    return reduce(DataFrame.unionByName, parts)


def tool_runs(raw: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per (file, tool) with status, version and number of findings.

    Outputs of one tool in several forms are one run, named as its findings are; a form that
    failed makes the run a failed one.
    """
    counts = findings.groupBy("path", "tool").agg(F.count("*").alias("findings"))
    status = F.col("status") if "status" in raw.columns else F.lit("ok")
    version = F.col("version") if "version" in raw.columns else F.lit(None).cast("string")
    name = F.coalesce(F.try_element_at(dims.literal_map(EMITTED), F.col("tool")), F.col("tool"))
    worst = F.when(status == "ok", 1).otherwise(0)
    runs = raw.select("path", name.alias("tool"), status.alias("status"), version.alias("version"), worst.alias("_w"))
    runs = runs.groupBy("path", "tool").agg(F.min_by("status", F.struct("_w", "status")).alias("status"), F.max("version").alias("version"))
    return runs.join(counts, ["path", "tool"], "left").withColumn("findings", F.coalesce("findings", F.lit(0)))


def tool_status(runs: DataFrame) -> DataFrame:
    """Runs per tool and status, with the number of findings and, where runs tell them, the versions seen."""
    states = ("ok", "missing", "skipped", "failed", "disabled")
    return runs.groupBy("tool").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in states], F.sum("findings").alias("findings"),
        *([F.array_sort(F.collect_set("version")).alias("versions")] if "version" in runs.columns else []),
    )


def missing_core_tools(runs: DataFrame, core: tuple[str, ...] = ("shellcheck", "shfmt", "ruff", "bandit")) -> DataFrame:
    """Core tools that were missing in at least one run."""
    return runs.filter((F.col("status") == "missing") & F.col("tool").isin(*core)).select("tool").distinct()
