"""Algebra over findings: union, greedy dedup, suppression, enrichment, fingerprints, masking."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.catalog import RULES
from fleetgrade.functions import scalars as S
from fleetgrade.operators.graph import connected
from fleetgrade.operators.prefix import LINE_CHUNK, next_value, occurrence
from fleetgrade.session import cut

EDIT = "struct<line:int,column:int,end_line:int,end_column:int,replacement:string,rule:string>"
FINDING_SCHEMA = (
    "path string, tool string, rule string, category string, severity string, line int, end_line int, "
    "column int, message string, snippet string, hint string, url string, fingerprint string, "
    f"equivalents array<string>, refs array<string>, edits array<{EDIT}>, position bigint"
)
_DEFAULTS = {
    f.split(" ")[0]: f.split(" ")[1]
    for f in (
        "end_line int,column int,message string,snippet string,hint string,url string,fingerprint string,"
        "equivalents array<string>,refs array<string>"
    ).split(",")
}


def complete(df: DataFrame) -> DataFrame:
    """Give a partial findings frame every column of the findings schema."""
    for name, kind in _DEFAULTS.items():
        if name not in df.columns:
            empty = F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
            df = df.withColumn(name, empty)
    if "edits" not in df.columns:
        df = df.withColumn("edits", F.array().cast(f"array<{EDIT}>"))
    if "position" not in df.columns:
        df = df.withColumn("position", F.col("line").cast("bigint"))
    names = [part.strip().split(" ")[0] for part in
             "path,tool,rule,category,severity,line,end_line,column,message,snippet,hint,url,fingerprint,"
             "equivalents,refs,edits,position".split(",")]
    return df.select(*names)


def union_findings(frames: Iterable[DataFrame], priority: tuple[str, ...] = dims.TOOL_PRIORITY) -> DataFrame:
    """All findings with the rank of their tool; the rank decides who survives dedup."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return with_priority(merged, priority)


def with_priority(findings: DataFrame, priority: tuple[str, ...] = dims.TOOL_PRIORITY) -> DataFrame:
    rank = F.coalesce(
        dims.literal_map({t: i for i, t in enumerate(priority)})[F.col("tool")], F.lit(len(priority))
    )
    return findings.withColumn("tool_rank", rank)


# ---------------------------------------------------------------- dedup


def _pattern_targets(slim: DataFrame) -> DataFrame:
    """(pattern, target): which rule ids of the data each equivalence pattern names."""
    patterns = slim.select(F.explode("eqs").alias("pattern")).distinct()
    rules = slim.select("rule").distinct()
    exact = patterns.filter(~F.endswith("pattern", F.lit("*"))).join(
        rules.select(F.col("rule").alias("pattern"), F.col("rule").alias("target")), "pattern"
    )
    prefixes = rules.select(
        F.col("rule").alias("target"),
        F.explode(
            F.transform(F.sequence(F.lit(0), F.length("rule")), lambda n: F.substring(F.col("rule"), F.lit(1), n))
        ).alias("stem"),
    )
    wild = (
        patterns.filter(F.endswith("pattern", F.lit("*")))
        .withColumn("stem", F.expr("substring(pattern, 1, length(pattern) - 1)"))
        .join(prefixes, "stem")
        .select("pattern", "target")
    )
    return exact.select("pattern", "target").unionByName(wild)


def _levels(top: int) -> Column:
    return F.sequence(F.lit(0), F.lit(top))


def cover(first: str, last: str, top: int) -> Column:
    """The aligned segments (level k, number at) whose disjoint union is the span: two per level at most, so twice log2 of its length.

    At level k the span reaches from the first to the last whole segment of 2^k lines; an odd first one and an even last
    one are not halves of a larger segment of the span, and so are its own.
    """

    def at(k: Column) -> Column:
        low = F.ceil(F.col(first) / F.pow(F.lit(2.0), k)).cast("bigint")
        end = F.floor((F.col(last) + 1) / F.pow(F.lit(2.0), k)).cast("bigint")
        segment = lambda n: F.struct(k.cast("int").alias("k"), n.cast("bigint").alias("at"))
        return F.array_compact(F.array(F.when((low < end) & (low % 2 != 0), segment(low)), F.when((low < end) & (end % 2 != 0), segment(end - 1))))

    return F.flatten(F.transform(_levels(top), at))


def above(line: str, top: int) -> Column:
    """The segments that hold a line, one per level."""
    return F.transform(_levels(top), lambda k: F.struct(k.cast("int").alias("k"), F.floor(F.col(line) / F.pow(F.lit(2.0), k)).cast("bigint").alias("at")))


def _cross_tool_edges(slim: DataFrame) -> DataFrame:
    """Pairs of equivalent findings of two tools that touch, as unordered pairs (a, b) of classes.

    Two spans touch if one holds the first line of the other. The segments of a span are disjoint, so such a pair meets
    in one segment: that of the span among those that hold the line. Only files with findings of two tools have such pairs.
    """
    several = slim.groupBy("path").agg(F.min("tool").alias("low"), F.max("tool").alias("high")).filter("low <> high").select("path")
    slim = cut(slim.join(several, "path", "left_semi"))
    holders = (
        slim.withColumn("pattern", F.explode("eqs"))
        .join(_pattern_targets(slim), "pattern")
        .select("path", "cls", "tool", "line", "last", "wide", "target")
    )
    right = slim.select(
        "path",
        F.col("cls").alias("cls2"),
        F.col("tool").alias("tool2"),
        F.col("line").alias("line2"),
        F.col("last").alias("last2"),
        F.col("wide").alias("wide2"),
        F.col("rule").alias("target"),
    )
    longest = slim.filter("not wide").agg(F.max(F.col("last") - F.col("line") + 1)).first()[0] or 1
    top = int(longest).bit_length()
    lefts, rights = holders.filter(~F.col("wide")), right.filter(~F.col("wide2"))
    split = lambda df, segments: df.withColumn("s", F.explode(segments)).select("*", "s.k", "s.at").drop("s")
    keys = ["path", "target", "k", "at"]
    near = (
        split(lefts, cover("line", "last", top)).join(split(rights, above("line2", top)), keys)
        .unionByName(split(lefts, above("line", top)).join(split(rights, cover("line2", "last2", top)), keys).filter("line > line2"))
        .filter(F.col("tool") != F.col("tool2"))
        .select("cls", "cls2")
    )
    thin_left = holders.select("path", "cls", "tool", "wide", "target").distinct()
    thin_right = right.select("path", "cls2", "tool2", "wide2", "target").distinct()
    whole = (
        thin_right.join(thin_left.filter("wide"), ["path", "target"])
        .unionByName(thin_left.filter(~F.col("wide")).join(thin_right.filter("wide2"), ["path", "target"]))
        .filter(F.col("tool") != F.col("tool2"))
        .select("cls", "cls2")
    )
    return near.unionByName(whole).select(F.least("cls", "cls2").alias("a"), F.greatest("cls", "cls2").alias("b")).distinct()


def _same_tool_edges(slim: DataFrame) -> DataFrame:
    """Findings of one tool on one line with the same or an equivalent rule, as (src, dst), the earlier first."""
    a = slim.select("path", "tool", "line", F.col("prio").alias("p1"), F.col("id").alias("src"), F.col("rule").alias("r1"), F.col("eqs").alias("e1"))
    b = slim.select("path", "tool", "line", F.col("prio").alias("p2"), F.col("id").alias("dst"), F.col("rule").alias("r2"), F.col("eqs").alias("e2"))
    same = (
        (F.col("r1") == F.col("r2"))
        | F.exists("e1", lambda p: S.matches_code(p, F.col("r2")))
        | F.exists("e2", lambda p: S.matches_code(p, F.col("r1")))
    )
    return a.join(b, ["path", "tool", "line"]).filter((F.col("p1") < F.col("p2")) & same).select("src", "dst")


# A file with more conflicting findings than this is folded by connected part, so that no file is one long task.
FOLD_TOGETHER = 1 << 16


def _losers(rivals: DataFrame) -> DataFrame:
    """(id) of the findings that a kept one excludes; ``rivals(path, part, prio, id, cls, rows, classes)``.

    Each part is read in order, a batch at a time: what is held are the numbers of those kept so far.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kept, classes = None, set(), set()
        for batch in batches:
            gone = []
            for path, part, me, cls, rows, others in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "id", "cls", "rows", "classes")), strict=True):
                if (path, part) != here:
                    here, kept, classes = (path, part), set(), set()
                if kept.isdisjoint(rows) and classes.isdisjoint(others):
                    kept.add(me)
                    classes.add(cls)
                else:
                    gone.append(me)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], ["id"])

    dealt = rivals.repartition("path", "part").sortWithinPartitions("path", "part", "prio")
    return dealt.select("path", "part", "id", "cls", "rows", "classes").mapInArrow(fold, "id bigint")


def deduplicate(findings: DataFrame, max_span: int | None = None) -> DataFrame:
    """Keep each finding unless it duplicates one kept before it (tool rank, then position).

    The relation is not transitive, so the answer is the greedy one: conflicts are found by joins, and the conflicting
    findings of a file are folded in order. A file with very many is folded by connected parts of its conflicts, which
    cannot change each other. Findings that share a position
    are told apart by what they report. A finding of ``max_span`` lines or more counts
    as its first line, if a limit is given. Whole-file syntax errors conflict as one class, so pairs are
    only formed between findings that touch or between classes.
    """
    if "tool_rank" not in findings.columns:
        findings = with_priority(findings)
    columns = findings.columns
    ends = F.col("end_line") >= F.col("line")
    if max_span is not None:
        ends = ends & (F.col("end_line") - F.col("line") < max_span)
    span = F.when(ends, F.col("end_line")).otherwise(F.col("line"))
    eqs = F.array_sort(F.array_distinct(F.coalesce("equivalents", F.array().cast("array<string>"))))
    marked = findings.select(
        F.struct(*columns).alias("row"),
        "path",
        "tool",
        "rule",
        "line",
        span.alias("last"),
        eqs.alias("eqs"),
        F.struct(
            F.col("tool_rank").cast("int").alias("rank"), F.col("position").cast("bigint").alias("position"),
            F.xxhash64("tool", "rule", "line", span, eqs).alias("what"),
        ).alias("prio"),
    )
    # Rows alike in all that matters to dedup: only the first can survive. Stored, so that their numbers stay.
    reps = marked.groupBy("path", "tool", "rule", "line", "last", "eqs").agg(F.min_by("row", "prio").alias("row"), F.min("prio").alias("prio"))
    reps = cut(reps.withColumn("id", F.monotonically_increasing_id()))
    slim = reps.select("path", "tool", "rule", "line", "last", "eqs", "prio", "id", ((F.col("line") == 0) | (F.col("rule") == "SYNTAX")).alias("wide"))
    syntax = slim.filter("rule = 'SYNTAX'")
    classes = syntax.groupBy("path", "tool", "eqs").agg(F.min_by("id", "prio").alias("cls"))
    slim = slim.filter("rule <> 'SYNTAX'").withColumn("cls", F.col("id")).unionByName(syntax.join(classes, ["path", "tool", "eqs"]))
    rows, pairs = cut(_same_tool_edges(slim)), cut(_cross_tool_edges(slim))

    before = rows.groupBy("dst").agg(F.collect_list("src").alias("rows")).withColumnRenamed("dst", "id")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.groupBy("a").agg(F.collect_list("b").alias("classes")).withColumnRenamed("a", "cls")
    first = rows.select(F.col("src").alias("id"), F.lit(True).alias("first")).distinct()
    none = F.array().cast("array<bigint>")
    met = slim.select("path", "prio", "id", "cls").join(before, "id", "left").join(others, "cls", "left").join(first, "id", "left")
    met = met.filter("rows is not null or classes is not null or first")
    rivals = cut(met.select("path", "prio", "id", "cls", F.coalesce("rows", none).alias("rows"), F.coalesce("classes", none).alias("classes")))
    large = cut(rivals.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > FOLD_TOGETHER).select("path"))
    part = rivals.withColumn("part", F.lit(0).cast("bigint"))
    if not large.isEmpty():
        hot = rivals.join(large, "path", "left_semi")
        links = hot.select(F.col("id").alias("a"), F.explode(F.concat("rows", F.array("cls"))).alias("b")).unionByName(hot.select(F.col("cls").alias("a"), F.explode("classes").alias("b")))
        parts = connected(links).select(F.col("node").alias("id"), F.col("part").alias("mine"))
        part = rivals.join(large, "path", "left_anti").withColumn("part", F.lit(0).cast("bigint")).unionByName(
            hot.join(parts, "id", "left").withColumn("part", F.coalesce("mine", "id")).drop("mine"))
    return reps.join(_losers(part), "id", "left_anti").select("row.*")


# ---------------------------------------------------------------- suppression

DIRECTIVE_WORD = "fleetgrade"


def may_direct(content: Column, word: str = DIRECTIVE_WORD) -> Column:
    """Whether a text can hold a line that :func:`parse_directives` takes for a directive; no other lines are needed there."""
    return content.rlike(rf"(?i)#\s*({word}\s+disable|noqa\b|nosec\b)")


def parse_directives(lines: DataFrame, python_paths: DataFrame | None = None, word: str = DIRECTIVE_WORD) -> DataFrame:
    """Suppression comments of ``lines(path, line, raw)`` as (path, line, kind, ids, target).

    ``word`` is the marker in the comments. A directive alone on its line aims at the next
    code line. In files of ``python_paths`` the ``noqa`` and ``nosec`` comments count too.
    """
    code_line = F.when(~F.col("raw").rlike(r"^\s*(#|\z)"), F.col("line"))
    placed = next_value(lines.select("path", "line", "raw"), ["path"], "line", {"next_code": code_line})
    found = rf"(?i)#\s*{word}\s+(disable-next-line|disable-file|disable)\s*=\s*([\w*,\s-]+)"
    own = (
        placed.withColumn("kind", F.lower(F.regexp_extract("raw", found, 1)))
        .filter("kind <> ''")
        .withColumn("ids", F.filter(F.split(F.upper(F.regexp_extract("raw", found, 2)), r"[,\s]+"), lambda x: x != ""))
        .withColumn(
            "target",
            F.when(F.col("kind") == "disable-file", 0)
            .when(
                (F.col("kind") == "disable-next-line") | F.col("raw").rlike(r"^\s*#"),
                F.coalesce("next_code", F.lit(-1)),
            )
            .otherwise(F.col("line")),
        )
        .select("path", "line", "kind", F.array_distinct("ids").alias("ids"), F.col("target").cast("int").alias("target"))
    )
    if python_paths is None:
        return own
    py = lines.select("path", "line", "raw").join(python_paths.select("path"), "path", "left_semi")
    codes = F.regexp_extract("raw", r"(?i)#\s*noqa\b\s*:\s*([A-Za-z]+\d+([\s,]+[A-Za-z]+\d+)*)", 1)
    nosec = F.regexp_extract("raw", r"#\s*nosec\b[\s:]+([Bb]\d{3}([\s,]+[Bb]\d{3})*)", 1)

    def widened(text: Column) -> Column:
        ids = F.filter(F.split(F.upper(text), r"[\s,]+"), lambda x: x != "")
        return F.array_distinct(F.concat(ids, F.flatten(F.transform(ids, same_rule_ids))))

    noqa_rows = py.filter(F.col("raw").rlike(r"(?i)#\s*noqa\b")).select(
        "path", "line", F.lit("noqa").alias("kind"),
        F.when(codes == "", F.array(F.lit("ALL"))).otherwise(widened(codes)).alias("ids"),
        F.col("line").alias("target"),
    )
    nosec_rows = py.filter(F.col("raw").rlike(r"#\s*nosec\b")).select(
        "path", "line",
        F.when(nosec == "", "security").otherwise("noqa").alias("kind"),
        F.when(nosec == "", F.array(F.lit("ALL"))).otherwise(widened(nosec)).alias("ids"),
        F.col("line").alias("target"),
    )
    return own.unionByName(noqa_rows).unionByName(nosec_rows)


def _matches_of(findings: DataFrame, directives: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Directive patterns in three shapes: on a line, whole file, security line."""
    flat = directives.withColumn("pattern", F.explode("ids"))
    on_line = flat.filter("target <> 0 and kind <> 'security'").select("path", F.col("target").alias("line"), "pattern").distinct()
    whole = flat.filter("target = 0").select("path", "pattern").distinct()
    security = directives.filter("kind = 'security'").select("path", F.col("target").alias("line")).distinct()
    return on_line, whole, security


def suppress(findings: DataFrame, directives: DataFrame) -> DataFrame:
    """Drop the findings a directive silences."""
    on_line, whole, security = _matches_of(findings, directives)
    rule = F.upper(findings["rule"])
    kept = findings.join(
        on_line,
        (findings["path"] == on_line["path"]) & (findings["line"] == on_line["line"]) & S.matches_rule(on_line["pattern"], rule),
        "left_anti",
    )
    # Whole-file patterns meet the few distinct rules of a file, not its findings.
    rules = kept.select("path", "rule").distinct()
    silenced = rules.join(
        whole, (rules["path"] == whole["path"]) & S.matches_rule(whole["pattern"], F.upper(rules["rule"])), "left_semi"
    )
    kept = kept.join(silenced, ["path", "rule"], "left_anti")
    return kept.join(
        security,
        (kept["path"] == security["path"]) & (kept["line"] == security["line"]) & (kept["category"] == "security"),
        "left_anti",
    )


def stale_directives(directives: DataFrame, raw: DataFrame, runs: DataFrame, builtin_ids: Iterable[str]) -> DataFrame:
    """MNT011: directives that match no raw finding, when that is certain."""
    own = directives.filter(F.col("kind").startswith("disable"))
    flat = own.select("path", "line", "target", F.explode("ids").alias("pattern"))
    seen = raw.select("path", F.col("line").alias("target"), F.upper("rule").alias("rule")).distinct()
    used_line = (
        flat.filter("target <> 0").join(seen, ["path", "target"]).filter(S.matches_rule(F.col("pattern"), F.col("rule")))
        .select("path", "line")
    )
    used_file = (
        flat.filter("target = 0").join(seen.select("path", "rule").distinct(), "path")
        .filter(S.matches_rule(F.col("pattern"), F.col("rule"))).select("path", "line")
    )
    health = runs.groupBy("path").agg(
        F.bool_and(F.col("status").isin("ok", "disabled")).alias("all_ran"),
        F.bool_or((F.col("tool") == "builtin") & (F.col("status") == "ok")).alias("builtin_ran"),
    )
    known = F.array(*[F.lit(i) for i in builtin_ids])
    return (
        own.join(used_line.unionByName(used_file).distinct(), ["path", "line"], "left_anti")
        .join(health, "path")
        .filter(F.col("all_ran") | (F.col("builtin_ran") & (F.size(F.array_except("ids", known)) == 0)))
        .select(
            "path", F.lit("builtin").alias("tool"), F.lit("MNT011").alias("rule"),
            F.lit("maintainability").alias("category"), F.lit("low").alias("severity"), "line",
            F.concat(F.lit("suppression without effect ("), F.array_join("ids", ", "), F.lit(")")).alias("message"),
        )
    )


def suppressed_count(deduped: DataFrame, kept: DataFrame) -> DataFrame:
    """Findings silenced per file: dedup survivors minus those left."""
    both = deduped.select("path", F.lit(1).alias("n")).unionByName(kept.select("path", F.lit(-1).alias("n")))
    return both.groupBy("path").agg(F.sum("n").alias("suppressed"))


# ---------------------------------------------------------------- rule identities


def _same_pairs() -> dict[str, list[str]]:
    near: dict[str, list[str]] = {}
    for a, b in dims.SAME_PYTHON + dims.SAME_AS_BUILTIN:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out = {}
    builtin = {b for _, b in dims.SAME_AS_BUILTIN}
    for rule, ids in near.items():
        hop = [x for b in ids if b in builtin for x in near[b]]
        out[rule] = sorted({*ids, *hop} - {rule})
    return out


SAME_IDS = _same_pairs()


def same_rule_ids(rule: Column) -> Column:
    """Other ids of the same rule, upper case, sorted."""
    up = F.upper(rule)
    table = F.create_map(
        *[x for k, v in SAME_IDS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
    )
    guessed = F.array(
        F.when(up.rlike(r"^S[1-7]\d\d\z"), F.concat(F.lit("B"), F.substring(up, 2, 3))),
        F.when(up.rlike(r"^B[1-7]\d\d\z"), F.concat(F.lit("S"), F.substring(up, 2, 3))),
        F.when(up.rlike(r"^PL[CERW]\d{4}\z"), F.substring(up, 3, 5)),
        F.when(up.rlike(r"^[CERW]\d{4}\z"), F.concat(F.lit("PL"), up)),
    )
    return F.array_sort(F.array_distinct(F.concat(
        F.coalesce(F.try_element_at(table, up), F.array().cast("array<string>")), F.array_compact(guessed))))


def same_rules(rules: DataFrame) -> DataFrame:
    """(rule, same): every other id of each rule of ``rules(rule)``."""
    return rules.select("rule").distinct().select("rule", F.explode(same_rule_ids(F.col("rule"))).alias("same"))


# ---------------------------------------------------------------- enrichment

# Documentation addresses of the tools.
TOOL_URLS = {
    "bashate": "https://docs.openstack.org/bashate/latest/man/bashate.html",
    "checkbashisms": "https://manpages.debian.org/checkbashisms",
    "shfmt": "https://github.com/mvdan/sh/blob/master/cmd/shfmt/shfmt.1.scd",
    "gitleaks": "https://github.com/gitleaks/gitleaks",
    "trufflehog": "https://github.com/trufflesecurity/trufflehog",
}
HINTS = {
    ("shfmt", "FORMAT"): "Run the formatter over the file.",
    ("ruff", "FORMAT"): "Run the formatter over the file.",
    ("shfmt", "DIALECT"): "Use the POSIX form or declare bash in the first line.",
    ("shfmt", "PARSE"): "The file cannot run until its syntax is right.",
    ("radon", "CC"): "Move branches into helper functions and return early.",
    ("radon", "MI"): "Split the file into smaller modules.",
}
TOOL_HINTS = {
    "vermin": "Use a construct the target version has, or raise the target version.",
    "checkbashisms": "Use the POSIX form or declare bash in the first line.",
    "syntax": "The file cannot run until its syntax is right.",
    "gitleaks": "Remove the secret, revoke it and store it outside the code.",
    "trufflehog": "Remove the secret, revoke it and store it outside the code.",
}


def enrich(findings: DataFrame) -> DataFrame:
    """Fill missing hints and links; add references. Literal maps only, so no join."""
    hint = F.coalesce(
        "hint",
        F.try_element_at(dims.literal_map({f"{t}/{r}": h for (t, r), h in HINTS.items()}), F.concat_ws("/", "tool", "rule")),
        F.try_element_at(dims.literal_map(TOOL_HINTS), F.col("tool")),
    )
    url = F.coalesce(
        "url",
        F.when(F.col("tool") == "shellcheck", F.concat(F.lit("https://www.shellcheck.net/wiki/"), "rule")),
        F.try_element_at(dims.literal_map(TOOL_URLS), F.col("tool")),
    )
    return add_references(findings.withColumn("hint", hint).withColumn("url", url))


def rule_reference_map() -> dict[str, tuple[str, ...]]:
    out = dict(dims.RULE_REFERENCES)
    for rule, ids in SAME_IDS.items():
        for other in ids:
            if rule not in out and other in dims.RULE_REFERENCES:
                out[rule] = dims.RULE_REFERENCES[other]
    return out


def sort_references(refs: Column) -> Column:
    """CWE by number, then OWASP, then the rest by name."""
    keyed = F.transform(
        F.array_distinct(refs),
        lambda r: F.struct(
            F.when(F.startswith(r, F.lit("CWE-")), 0).when(F.startswith(r, F.lit("OWASP")), 1).otherwise(2).alias("k"),
            F.coalesce(F.regexp_extract(r, r"^CWE-(\d+)", 1).try_cast("int"), F.lit(0)).alias("n"),
            r.alias("r"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda s: s["r"])


def add_references(findings: DataFrame) -> DataFrame:
    """Own references, those of the rule, and those of exact equivalents."""
    table = F.create_map(
        *[x for k, v in rule_reference_map().items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
    )
    none = F.array().cast("array<string>")

    def of(rule: Column) -> Column:
        return F.coalesce(F.try_element_at(table, F.upper(rule)), none)

    exact = F.filter(F.coalesce("equivalents", none), lambda e: ~F.endswith(e, F.lit("*")))
    merged = F.concat(F.coalesce("refs", none), of(F.col("rule")), F.flatten(F.transform(exact, of)))
    return findings.withColumn("refs", sort_references(merged))


def escalate(findings: DataFrame, contexts: Iterable[str] | Column) -> DataFrame:
    """Raise severities by execution context, the same for all rows or a column of each; never lower them."""
    if isinstance(contexts, Column):
        by_context = F.create_map(*[x for c, rules in dims.ESCALATIONS.items() for x in (F.lit(c), dims.literal_map({r: dims.SEVERITIES.index(s) for r, s in rules.items()}))])
        ranks = F.transform(contexts, lambda c: F.try_element_at(F.try_element_at(by_context, c), F.col("rule")))
        return findings.withColumn("severity", dims.severity_name(F.least(dims.severity_rank(F.col("severity")), F.array_min(ranks))))
    raised: dict[str, int] = {}
    for c in contexts:
        for rule, sev in dims.ESCALATIONS[c].items():
            raised[rule] = min(raised.get(rule, 9), dims.SEVERITIES.index(sev))
    if not raised:
        return findings
    rank = F.least(dims.severity_rank(F.col("severity")), F.try_element_at(dims.literal_map(raised), F.col("rule")))
    return findings.withColumn("severity", dims.severity_name(rank))


def hide_by_context(findings: DataFrame, contexts: Column) -> DataFrame:
    """Drop built-in findings of rules that hold in other contexts only."""
    only = {r.rule: F.array(*[F.lit(c) for c in r.contexts]) for r in RULES if r.contexts}
    table = F.create_map(*[x for rule, where in only.items() for x in (F.lit(rule), where)])
    return findings.filter((F.col("tool") != "builtin") | F.coalesce(F.arrays_overlap(F.try_element_at(table, F.col("rule")), contexts), F.lit(True)))


def apply_config(findings: DataFrame, disabled: Iterable[str] | Column = (), overrides: dict[str, tuple] | Column | None = None) -> DataFrame:
    """Drop disabled rules, under any id of the same rule, then override category and severity.

    Both are the same for all rows, or columns: an array of rule ids, and a map from a rule to (category, severity).
    """
    off = F.transform(disabled, F.upper) if isinstance(disabled, Column) else F.array(*[F.lit(d.upper()) for d in disabled]).cast("array<string>")
    ids = F.concat(F.array(F.upper("rule")), same_rule_ids(F.col("rule")))
    out = findings.filter(~F.arrays_overlap(ids, off))
    if isinstance(overrides, Column):
        own = F.try_element_at(overrides, F.upper("rule"))
        return out.withColumns({name: F.coalesce(own[name], F.col(name)) for name in ("category", "severity")})
    for slot, name in enumerate(("category", "severity")):
        table = {r.upper(): v[slot] for r, v in (overrides or {}).items() if v[slot]}
        if table:
            out = out.withColumn(name, F.coalesce(F.try_element_at(dims.literal_map(table), F.upper("rule")), F.col(name)))
    return out


def fingerprint(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Line-independent fingerprint: tool, rule, squeezed text of the line, and its occurrence."""
    text = lines.select("path", "line", S.collapse_ws(F.col("raw")).alias("_text"))
    joined = findings.join(text, ["path", "line"], "left").withColumn("_text", F.coalesce("_text", F.lit("")))
    return _printed(occurrence(joined, _PRINTED, "position", name="_n", chunk=LINE_CHUNK))


_PRINTED = ["path", "tool", "rule", "_text"]


def _printed(ranked: DataFrame) -> DataFrame:
    key = F.concat_ws("|", "tool", "rule", "_text", F.col("_n").cast("string"))
    return ranked.withColumn("fingerprint", S.fnv1a64(key)).drop("_text", "_n")


# Rules that point at a secret, by tool.
SECRET_RULES = {
    "builtin": ("SEC002", "SEC010", "SEC021", "SEC022", "PYSEC001", "DKR005", "CI004"),
    "bandit": ("B105", "B106", "B107"),
    "ruff": ("S105", "S106", "S107"),
}
SEMGREP_SECRET = r"secret|password|passwd|token|credential|api-?key|private-key"


def reveals_secret() -> Column:
    by_rule = reduce(
        lambda a, b: a | b,
        [(F.col("tool") == t) & F.col("rule").isin(*rules) for t, rules in SECRET_RULES.items()],
    )
    return (
        by_rule
        | F.col("tool").isin("gitleaks", "trufflehog")
        | ((F.col("tool") == "semgrep") & F.lower("rule").rlike(SEMGREP_SECRET))
    )


def _secret_lines(detected: DataFrame) -> DataFrame:
    return detected.filter(reveals_secret()).select("path", "line").distinct().withColumn("_secret", F.lit(True))


def _shown(raw: str) -> Column:
    return F.regexp_replace(raw, r"(?U)\s+\z", "")


def _without_masked_edits(shown: DataFrame, findings: DataFrame, secret: DataFrame) -> DataFrame:
    """``shown`` without the edits that touch a masked line; ``findings`` has the same edits. They meet in buckets of lines."""
    wide = 64
    spans = findings.filter(F.size("edits") > 0).select("path", "tool", "position", F.explode("edits").alias("e"))
    near = spans.select(
        "path", "tool", "position", F.col("e.line").alias("a"), F.col("e.end_line").alias("b"),
        F.explode(F.sequence(F.floor(F.col("e.line") / wide), F.floor(F.col("e.end_line") / wide))).alias("bucket"),
    )
    hit = (
        near.join(secret.select("path", F.col("line").alias("s"), F.floor(F.col("line") / wide).alias("bucket")), ["path", "bucket"])
        .filter("s between a and b")
        .select("path", "tool", "position", F.lit(True).alias("_touch"))
        .distinct()
    )
    none = F.array().cast(f"array<{EDIT}>")
    return (
        shown.join(hit, ["path", "tool", "position"], "left")
        .withColumn("edits", F.when(F.col("_touch").isNull(), F.col("edits")).otherwise(none))
        .drop("_touch")
    )


def attach_source(findings: DataFrame, lines: DataFrame, detected: DataFrame) -> DataFrame:
    """Add the source line; lines where any raw finding saw a secret are masked and lose their edits."""
    secret = _secret_lines(detected)
    text = lines.select("path", "line", _shown("raw").alias("_text"))
    shown = (
        findings.drop("snippet")
        .join(text, ["path", "line"], "left")
        .join(secret, ["path", "line"], "left")
        .withColumn("snippet", F.when(F.col("_secret").isNull(), F.col("_text")))
        .drop("_text", "_secret")
    )
    return _without_masked_edits(shown, findings, secret)


def print_and_show(findings: DataFrame, lines: DataFrame, detected: DataFrame, large: DataFrame) -> DataFrame:
    """:func:`fingerprint`, then :func:`attach_source`: findings meet the lines and the masked lines in one join, and are numbered where they lie.

    ``large(path)`` are the files with more findings than one task should hold; these take the two steps one after the other.
    A line that comes several times counts as often in both steps.
    """
    secret, few = _secret_lines(detected), findings
    if several := not large.isEmpty():
        few = findings.join(large, "path", "left_anti")
    places = lines.groupBy("path", "line").agg(F.collect_list(F.struct("raw")).alias("_texts")).join(secret, ["path", "line"], "left")
    met = few.drop("snippet", "fingerprint").join(places, ["path", "line"], "left").select("*", F.explode_outer("_texts").alias("_own"))
    met = met.withColumn("_text", F.coalesce(S.collapse_ws(F.col("_own.raw")), F.lit(""))).drop("_own")
    ranked = met.withColumn("_n", F.row_number().over(Window.partitionBy(*_PRINTED).orderBy("position")))
    shown = _printed(ranked).select("*", F.explode_outer("_texts").alias("_own"))
    shown = shown.withColumn("snippet", F.when(F.col("_secret").isNull(), _shown("_own.raw"))).drop("_texts", "_own", "_secret")
    done = _without_masked_edits(shown, few, secret)
    if not several:
        return done
    many = findings.join(large, "path", "left_semi").repartition("path", "line")
    return done.unionByName(attach_source(fingerprint(many, lines), lines, detected))


# ---------------------------------------------------------------- selection


def number_sorted(findings: DataFrame, name: str = "n") -> DataFrame:
    """The rows numbered in the order of :func:`sort_findings`: ranges of the order are numbered inside, then moved by what stands before."""
    order = [
        F.col("path"), dims.category_rank(F.col("category")), dims.severity_rank(F.col("severity")), F.col("line"), F.col("tool"), F.col("position"),
    ]
    # Ranges are drawn from a sample, so they are stored before they are used twice.
    ranged = cut(findings.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_n", inside).join(sizes.select("_range", before.alias("_before")), "_range").withColumn(name, F.col("_n") + F.col("_before")).drop("_range", "_n", "_before")


def sort_findings(findings: DataFrame) -> DataFrame:
    """Category, severity, line; path first and ties by tool and position, so the order is total."""
    return findings.orderBy(
        "path", dims.category_rank(F.col("category")), dims.severity_rank(F.col("severity")), "line", "tool", "position"
    )


def filter_refs(findings: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Findings with a reference that starts with one of ``wanted``, with or without its family word."""
    starts = [w.strip().upper() for w in wanted]

    def hit(ref: Column) -> Column:
        up = F.upper(ref)
        bare = F.when(F.startswith(up, F.lit("OWASP ")), F.substr(up, F.lit(7))).otherwise(up)
        return reduce(lambda a, b: a | b, [F.startswith(up, F.lit(w)) | F.startswith(bare, F.lit(w)) for w in starts])

    return findings.filter(F.exists("refs", hit))


def filter_findings(findings: DataFrame, categories: Iterable[str] = (), severities: Iterable[str] = ()) -> DataFrame:
    out = findings
    if categories:
        out = out.filter(F.col("category").isin(*categories))
    if severities:
        out = out.filter(F.col("severity").isin(*severities))
    return out


def search_findings(findings: DataFrame, query: str) -> DataFrame:
    """Findings in which every word of the query occurs."""
    text = F.lower(F.concat_ws(
        " ", "rule", "message", "tool", "category", "hint", F.array_join(F.coalesce("refs", F.array().cast("array<string>")), " "),
        F.concat(F.lit("l"), F.col("line")),
    ))
    words = query.lower().split()
    return findings.filter(reduce(lambda a, b: a & b, [F.contains(text, F.lit(w)) for w in words], F.lit(True)))


def top_details(findings: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` findings per file and category (a report feature), worst first."""
    from pyspark.sql import Window

    w = Window.partitionBy("path", "category").orderBy(
        dims.severity_rank(F.col("severity")), "line", "tool", "position"
    )
    return findings.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
