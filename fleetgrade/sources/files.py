"""Where files come from: listing, text and script tests, ignore rules, globs, change lists, configs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.operators import lines as LN


def scan_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, content, length, modified) of the files under a folder; paths are relative to it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(root if recursive else root.rstrip("/") + "/*")
    base = root.rstrip("/").split("://")[-1]
    relative = F.regexp_replace("path", rf"^.*?{re.escape(base)}/", "")
    return files.select(relative.alias("path"), "content", "length", F.col("modificationTime").alias("modified"))


def keep_text(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``files(path, content binary)`` into text files and skipped paths."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = files.filter(valid).withColumn("content", F.col("content").cast("string"))
    return text, files.filter(~valid).select("path", F.lit("not UTF-8 text").alias("reason"))


SHEBANG = r"^#!.*\b((ba|da|k|mk|z)?sh|python[23]?(\.\d+)?)\b"


def keep_scripts(files: DataFrame) -> DataFrame:
    """Scripts by extension, host files, or an interpreter line when there is no extension."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    by_ext = F.lower("path").rlike(LN.SCRIPT_EXT)
    host = LN.detect_host_kind(F.col("path"), F.col("content")).isNotNull()
    bare = ~name.rlike(r"[^.].*\.|^[^.]+\.") & F.substring_index("content", "\n", 1).rlike(SHEBANG)
    return files.filter(by_ext | host | bare)


# Folders that hold other people's code, and hidden names that hold pipelines.
VENDOR = ("venv", "site-packages", "__pycache__", "node_modules")
HIDDEN_HOSTS = (".github", ".gitlab", ".gitlab-ci.yml")


def hidden_or_vendor(path: Column, embedded: bool = True) -> Column:
    def out(part: Column) -> Column:
        hidden = F.startswith(part, F.lit(".")) & (part != ".")
        if embedded:
            hidden = hidden & ~part.isin(*HIDDEN_HOSTS)
        return hidden | part.isin(*VENDOR)

    return F.exists(F.split(path, "/"), out)


def drop_hidden_vendor(files: DataFrame, embedded: bool = True) -> DataFrame:
    return files.filter(~hidden_or_vendor(F.col("path"), embedded))


def glob_regex(glob: str) -> str:
    """Regular expression of a glob with ``*``, ``?``, ``[…]`` and ``**``."""
    token = re.compile(r"\*\*/|\*\*|\*|\?|\[([^\]]+)\]|\\(.)|(.)", re.S)

    def one(m: re.Match) -> str:
        t = m.group(0)
        if t in ("**/", "**", "*", "?"):
            return {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}[t]
        if m.group(1) is not None:
            inner = m.group(1)
            inner = "^" + inner[1:] if inner.startswith("!") else inner
            return "[" + inner.replace("\\", "\\\\") + "]"
        return re.escape(m.group(2) or m.group(3))

    return token.sub(one, glob)


def parse_ignore(patterns: Iterable[str]) -> list[tuple[str, bool, bool]]:
    """(regex, negated, folders only) per line of an ignore file."""
    out = []
    for raw in patterns:
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated or line[:2] in ("\\!", "\\#") else line
        only = line.endswith("/")
        line = line[:-1] if only else line
        if line:
            body = glob_regex(line.removeprefix("/"))
            out.append((f"^{body}\\z" if "/" in line else f"^(?:.*/)?{body}\\z", negated, only))
    return out


def ignored(path: Column, patterns: Iterable[str]) -> Column:
    """Ignored by the last matching pattern, for the path or any folder above it."""
    rules = parse_ignore(patterns)
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    prefixes = F.transform(parts, lambda p, i: F.struct(
        F.array_join(F.slice(parts, F.lit(1), i + 1), "/").alias("p"), (i < F.size(parts) - 1).alias("folder")))

    def verdict(x: Column) -> Column:
        out = F.lit(False)
        for regex, negated, only in rules:
            hit = x["p"].rlike(regex)
            out = F.when(hit & x["folder"] if only else hit, F.lit(not negated)).otherwise(out)
        return out

    return F.exists(prefixes, verdict)


IGNORE_SCHEMA = "folder string, ord int, pattern string"
_WILD = re.compile(r"[*?\[\]\\]")


def ignore_table(rules: DataFrame) -> DataFrame:
    """(folder, ord, key, regex, negated, only): parsed lines of ``rules(folder, ord, pattern)``, one row per line that says something.

    ``key`` is what a path below the folder must show before the pattern is tried: its whole text (``=``) or its name (``/``) where the
    pattern is literal, its ending (``.``) for ``*.ending``, its first part (``^``) for a pattern that starts with one, nothing (empty) else.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for regex, negated, only in parse_ignore([r["pattern"] or ""]):
                    line = r["pattern"].rstrip().removeprefix("!").removeprefix("\\").rstrip("/")
                    rows.append((r["folder"] or "", r["ord"], _ignore_key(line), regex, negated, only))
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["folder", "ord", "key", "regex", "negated", "only"])

    return rules.select("folder", "ord", "pattern").mapInArrow(parse, "folder string, ord int, key string, regex string, negated boolean, only boolean")


def _ignore_key(line: str) -> str:
    body = line.removeprefix("/")
    if not _WILD.search(body):
        return ("=" if "/" in line else "/") + body
    if "/" not in line:
        end = re.fullmatch(r"\*\.([^.*?\[\]\\]+)", body)
        return "." + end.group(1) if end else ""
    head = body.split("/")[0]
    return "" if _WILD.search(head) or "/" not in body else "^" + head


def ignored_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (path) of the files that ignore files of the folders above them exclude: ``rules(folder, ord, pattern)``, paths and
    patterns relative to the folder; the folder of the whole tree is empty.

    For each folder with rules the last pattern that matches wins, for the path or any folder above it; what is excluded by one
    folder is not brought back by another. Folders, not files, carry the tests of what is above: each is tested once.
    A path meets only the patterns whose key it shows, by an equi-join.
    """
    parsed = ignore_table(rules)
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & (p != "."))
    named = files.select("path", parts.alias("parts")).distinct()
    upto = lambda n: F.array_join(F.slice(F.col("parts"), F.lit(1), n), "/")
    above = named.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.struct(upto(n).alias("at"), (n < F.size("parts")).alias("dir")))).alias("x")).select("path", "x.*")
    # Each folder and each file once, with every folder of rules that may stand above it.
    tested = above.select("at", "dir").distinct().withColumn("parts", F.split("at", "/"))
    holders = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda n: F.struct(upto(n).alias("folder"), F.array_join(F.slice(F.col("parts"), n + 1, F.lit(2**30)), "/").alias("below")))
    tested = tested.select("at", "dir", F.explode(holders).alias("h")).select("at", "dir", "h.*").join(parsed.select("folder").distinct(), "folder", "left_semi")
    name = F.element_at(F.split("below", "/"), -1)
    keys = F.array_compact(F.array(
        F.lit(""), F.concat(F.lit("="), "below"), F.concat(F.lit("/"), name), F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))),
        F.concat(F.lit("^"), F.substring_index("below", "/", 1))))
    met = tested.select("folder", "at", "dir", "below", F.explode(keys).alias("key")).join(parsed, ["folder", "key"])
    met = met.filter((F.col("dir") | ~F.col("only")) & F.rlike("below", F.col("regex")))
    verdict = met.groupBy("folder", "at", "dir").agg(F.max_by("negated", "ord").alias("negated")).filter(~F.col("negated")).select("at", "dir").distinct()
    return above.join(verdict, ["at", "dir"]).select("path").distinct()


def ignore_by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files that no ignore file above them excludes. No pattern enters the plan; a file with a null path stays."""
    return files.join(ignored_by_rules(files.select("path"), rules), "path", "left_anti")


def ignore_paths(files: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Drop ignored files. The patterns are a config list, so this is one filter without a join."""
    return files.filter(~ignored(F.col("path"), list(patterns)))


def glob_targets(files: DataFrame, globs: Iterable[str], recursive: bool = False) -> DataFrame:
    """Files a glob names; a pattern without a slash matches names anywhere when ``recursive``."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    keep = F.lit(False)
    for g in globs:
        last = g.split("/")[-1]
        anywhere = recursive and "/" not in g
        hit = name.rlike(f"^{glob_regex(g)}\\z") if anywhere else F.col("path").rlike(f"^{glob_regex(g)}\\z")
        if not last.startswith("."):
            hit = hit & ~F.startswith(name, F.lit("."))
        if anywhere or "**" in g.split("/"):
            above = F.regexp_extract("path", r"^(.*)/[^/]*\z", 1)
            hit = hit & ((above == "") | ~hidden_or_vendor(above))
        keep = keep | hit
    return files.filter(keep)


# States of a change list whose file still exists.
KEPT_STATES = ("A", "C", "M", "R", "T", "??")


def changed_since(files: DataFrame, changes: DataFrame, staged_only: bool = False) -> DataFrame:
    """Files named by ``changes(path, state[, staged])``; deleted ones are dropped."""
    kept = changes.filter(F.regexp_extract("state", r"^(\?\?|[A-Z])", 1).isin(*KEPT_STATES))
    if staged_only:
        kept = kept.filter("staged")
    return files.join(kept.select("path").distinct(), "path", "left_semi")


def nearest_marker(files: DataFrame, markers: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, folder): the deepest folder above each file that holds a marker, not beyond its root.

    Folders, not files, climb the tree: a folder with a third of all files costs one row.
    """
    dirs = files.select(F.regexp_extract("path", r"^(.*)/[^/]*\z", 1).alias("dir")).distinct()
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("depth", "folder"))
    marks = markers.select("folder", F.lit(True).alias("has")).unionByName(roots.select("folder", F.lit(False).alias("has"))).groupBy("folder").agg(F.bool_or("has").alias("has"))
    found = above.join(marks, "folder").groupBy("dir").agg(F.max_by(F.struct("folder", "has"), "depth").alias("m")).filter("m.has").select("dir", "m.folder")
    return files.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*\z", 1)).join(found, "dir").drop("dir")


def nearest_config(files: DataFrame, configs: DataFrame, roots: DataFrame) -> DataFrame:
    """Each file with the config row of its deepest folder; files without one keep nulls."""
    near = nearest_marker(files.select("path"), configs.select("folder").distinct(), roots)
    return files.join(near.join(configs, "folder"), "path", "left")
