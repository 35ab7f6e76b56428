"""User-defined line rules from a table, as many as one likes.

Every pattern gives the texts of which a matching line must hold one. They are searched in one pass over a line; only rules whose
text occurs are tried, by the JVM's regular expressions. What a fleet pays for a rule is what its text costs, not one pattern a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade.operators import custom as UD
from fleetgrade.operators.findings import EDIT

# Texts of one pass; a table that holds more is searched in several passes.
PASS_BYTES = 16 << 20
SHORTEST = 2
# Places in a line's order: more rules than this cannot be told apart in ``position``.
MOST_RULES = 1 << 20
_ZERO_WIDTH_OR_CLASS = "dDwWsSbBAzZGhHvVRXtnrfae"


class _Unknown(Exception):
    """The pattern uses something whose needed text is not worked out; the rule is tried on every line."""


def _group_end(p: str, i: int) -> int:
    """The place behind the group or class that opens at ``i``."""
    depth, inside = 0, 0
    while i < len(p):
        c = p[i]
        if c == "\\":
            i += 1
        elif c == "[":
            inside += 1
        elif c == "]" and inside:
            inside -= 1
        elif not inside and c in "()":
            depth += 1 if c == "(" else -1
        if not depth and not inside:
            return i + 1
        i += 1
    raise _Unknown


def _needed(p: str, i: int) -> tuple[list[str] | None, int]:
    """(texts, place behind): any match of the alternatives from ``i`` holds one of the texts; None if nothing is known."""
    branches: list[list[str] | None] = []
    best: list[str] | None = None
    run = ""

    def offer(texts: list[str] | None) -> None:
        nonlocal best
        if texts and min(map(len, texts)) > (min(map(len, best)) if best else 0):
            best = texts

    while True:
        c = p[i] if i < len(p) else ""
        if c in ("", ")", "|"):
            offer([run])
            branches.append(best)
            best, run = None, ""
            if c != "|":
                sure = all(b is not None for b in branches)
                return ([t for b in branches for t in b or []] if sure else None), i
            i += 1
            continue
        atom, texts = "", None
        if c == "\\":
            n = p[i + 1 : i + 2]
            if not n or n.isalnum() and n not in _ZERO_WIDTH_OR_CLASS:
                raise _Unknown
            atom, i = ("" if n.isalnum() else n), i + 2
        elif c == "[":
            if p[i + 1 : i + 2] == "]" or p[i + 1 : i + 3] == "^]":
                raise _Unknown
            i = _group_end(p, i)
        elif c == "(":
            kind = p[i + 1 : i + 4]
            if kind[:2] in ("?=", "?!") or kind in ("?<=", "?<!"):
                i = _group_end(p, i)
            else:
                start = i + 1
                if kind[:2] in ("?:", "?>"):
                    start += 2
                elif kind[:2] == "?<":
                    start = p.index(">", i) + 1
                elif kind[:1] == "?":
                    raise _Unknown
                texts, i = _needed(p, start)
                i += 1
        else:
            atom, i = ("" if c in ".^$" else c), i + 1
        many = p[i : i + 1]
        counted = p[i : p.index("}", i)] if many == "{" else ""
        optional = many in ("?", "*") or counted.partition(",")[0].strip("{ 0") == "" and many == "{"
        if many in ("?", "*", "+", "{") and many:
            i += len(counted) + 1
            i += p[i : i + 1] in ("?", "+")
            offer([run if optional else run + atom])
            run = ""
            offer(None if optional else texts)
        elif atom:
            run += atom
        else:
            offer([run])
            run = ""
            offer(texts)


def needed_texts(pattern: str) -> list[str] | None:
    """Texts of which every match holds one, with small ASCII letters; None if unknown."""
    body = pattern
    while body[:4] in ("(?i)", "(?s)", "(?m)"):
        body = body[4:]
    try:
        texts, end = _needed(body, 0)
    except (_Unknown, ValueError, RecursionError):
        return None
    if end < len(body) or not texts or min(map(len, texts)) < SHORTEST:
        return None
    return [t.encode().lower().decode() for t in texts]


def _candidates(lines: DataFrame, needles: list[tuple[str, list[int]]], always: list[int]) -> DataFrame:
    """(path, line, raw, dialect, i) of the rules that a line may match; a line leaves Python once, with a list of them."""
    sent = lines.sparkSession.sparkContext.broadcast((needles, always))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, tried = sent.value
        machine = ahocorasick.Automaton()
        for text, rules in texts:
            machine.add_word(text, rules)
        machine.make_automaton()
        for batch in batches:
            rows, found, ends = [], [], [0]
            for k, raw in enumerate(batch.column("raw").to_pylist()):
                if not raw:
                    continue
                here = set(tried)
                if texts:
                    for _, rules in machine.iter(raw.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
                        here.update(rules)
                if here:
                    rows.append(k)
                    found += sorted(here)
                    ends.append(len(found))
            picked = batch.take(pa.array(rows, pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*picked.columns, lists], names=["path", "line", "raw", "dialect", "found"])

    held = lines.select("path", "line", "raw", "dialect").mapInArrow(run, "path string, line int, raw string, dialect string, found array<int>")
    return held.select("path", "line", "raw", "dialect", F.explode("found").alias("i"))


def told(rules: DataFrame, name: str, language: str) -> Column:
    """A text of a rule: that of the language, else the plain one, else that of any language."""
    by_language = f"{name}s"
    if by_language not in rules.columns:
        return F.col(name)
    texts = F.col(by_language)
    return F.coalesce(F.try_element_at(texts, F.lit(language)), F.col(name), F.element_at(F.map_values(texts), 1))


def sound_rules(rules: DataFrame) -> DataFrame:
    """The rules without a problem of :func:`fleetgrade.operators.custom.validate_rules`."""
    return rules.join(UD.validate_rules(rules).select("id").distinct(), "id", "left_anti")


def custom_rules(lines: DataFrame, rules: DataFrame, files: DataFrame | None = None, language: str = "en", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Findings of a table of rules (``UD.RULE_SCHEMA``, texts also as ``messages`` and ``hints`` by language) over ``lines(path, line, raw[, dialect])``.

    Rules with a problem (:func:`broken_rules` and ``UD.validate_rules``) are left out. ``absent`` rules report line 0 of
    every file of ``files(path[, dialect])`` in which no line matches. An empty table gives no findings; null lines are empty.
    A table whose texts exceed ``pass_bytes`` is searched in several passes, each with a part of the rules.
    """
    spark = lines.sparkSession
    if "dialect" not in lines.columns:
        lines = lines.withColumn("dialect", F.lit("unknown"))
    base = files if files is not None else lines.select("path", "dialect").distinct()
    if "dialect" not in base.columns:
        base = base.withColumn("dialect", F.lit("unknown"))
    sound = sound_rules(rules)
    shown = [F.coalesce(F.octet_length(c), F.lit(0)) for c in (told(sound, "message", language), told(sound, "hint", language), F.col("replace"), F.col("url"))]
    size = sound.agg(F.sum(F.octet_length("pattern") + F.octet_length("id") + sum(shown, F.lit(0))).alias("n"), F.count("*").alias("rules")).first()
    if size.rules > MOST_RULES:
        raise ValueError(f"{size.rules} rules, at most {MOST_RULES}")
    parts, begin = max(1, -(-(size.n or 0) // pass_bytes)), 0
    out = None
    for part in range(parts):
        mine = sound if parts == 1 else sound.filter(F.pmod(F.crc32("id"), F.lit(parts)) == part)
        rows = mine.select("id", "pattern", "ignore_case", "replace", F.coalesce("absent", F.lit(False)).alias("absent")).collect()
        wrong = set(UD.broken_patterns(spark, [UD.CustomRule(r.id, r.pattern, "", bool(r.ignore_case)) for r in rows]))
        # Absent rules come first, so that those of a file are a range of numbers.
        rows = sorted((r for r in rows if r.id not in wrong), key=lambda r: (not r.absent, r.id))
        found = _one_pass(lines, base, mine, rows, begin, language)
        begin += len(rows)
        out = found if out is None else out.unionByName(found)
    return out


def _one_pass(lines: DataFrame, files: DataFrame, rules: DataFrame, rows: list, begin: int, language: str) -> DataFrame:
    spark = lines.sparkSession
    absent = sum(r.absent for r in rows)
    # Absent rules are searched apart: they only ask whether a file has a match.
    needles: tuple[dict[str, list[int]], ...] = ({}, {})
    always: tuple[list[int], ...] = ([], [])
    numbered = []
    for i, r in enumerate(rows):
        texts, part = needed_texts(r.pattern), i < absent
        for t in texts or ():
            needles[part].setdefault(t, []).append(i)
        if texts is None:
            always[part].append(i)
        filled = None if r.replace is None else UD.java_replacement(spark, r.pattern, r.replace)
        numbered.append((i, r.id, filled))
    named = spark.createDataFrame(numbered, "i int, id string, replacement string")
    about = rules.join(named, "id").select(
        "i", "id", "replacement", "absent", F.coalesce("language", F.lit("any")).alias("language"), F.coalesce("comments", F.lit(False)).alias("comments"),
        F.concat(F.when(F.col("ignore_case"), "(?i)").otherwise(""), "pattern").alias("regex"), "category", "severity",
        told(rules, "message", language).alias("message"), told(rules, "hint", language).alias("hint"), "url")
    applies = (F.col("language") == "any") | ((F.col("language") == "python") == (F.col("dialect") == "python"))
    none = F.array().cast(f"array<{EDIT}>")

    def hits(part: bool) -> DataFrame:
        # The rules of a pass are of bounded size; the lines stay where they are, whatever the number of rules they may match.
        return (
            _candidates(lines, sorted(needles[part].items()), always[part]).join(F.broadcast(about), "i")
            .filter(applies & (F.col("comments") | ~F.col("raw").rlike(r"^\s*#")))
            .withColumn("column", F.regexp_instr("raw", F.col("regex"))).filter("column > 0"))

    edits = F.when(F.col("replacement").isNotNull(), UD.edits_of(F.col("raw"), F.col("regex"), F.col("replacement"), F.col("id"), F.col("line")))
    shown = hits(False).withColumn("edits", F.coalesce(edits, none)).drop("raw", "dialect", "regex", "replacement")
    if absent:
        # One row per file meets the rules that the file has; pairs of file and rule are not moved.
        seen = hits(True).groupBy("path").agg(F.collect_set("i").alias("seen"))
        every = F.sequence(F.lit(0), F.lit(absent - 1))
        left = F.array_except(every, F.coalesce("seen", F.array().cast("array<int>")))
        lacking = files.select("path", "dialect").join(seen, "path", "left").select("path", "dialect", F.explode(left).alias("i"))
        lacking = lacking.join(F.broadcast(about), "i").filter(applies).drop("dialect", "regex", "replacement")
        shown = shown.unionByName(lacking.withColumns({"line": F.lit(0), "column": F.lit(0), "edits": none}))
    return shown.select(
        "path", F.lit("custom").alias("tool"), F.col("id").alias("rule"), "category", "severity", "line", "column", "message", "hint", "url", "edits",
        (F.col("line").cast("bigint") * MOST_RULES + begin + F.col("i")).alias("position"))


def broken_rules(rules: DataFrame) -> DataFrame:
    """(id, problem) of a table of rules, with the patterns the JVM refuses. Patterns pass the driver in parts."""
    spark = rules.sparkSession
    listed = rules.select("id", "pattern", "ignore_case").toLocalIterator(prefetchPartitions=True)
    wrong = [(r.id, "bad pattern") for r in listed if UD.broken_patterns(spark, [UD.CustomRule(r.id, r.pattern, "", bool(r.ignore_case))])]
    return UD.validate_rules(rules).unionByName(spark.createDataFrame(wrong, "id string, problem string"))
