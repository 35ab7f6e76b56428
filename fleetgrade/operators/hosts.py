"""Files that embed shell: pipelines, playbooks, container files, make files.

Host files above 1 MiB are not read (a rule of discovery), so one file always fits one task.
Small parsing helpers turn a file into flat rows where the file is; every rule after that is
a filter, an aggregation or a join over those rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import takewhile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgrade.functions import scalars as S
from fleetgrade.session import cut

# ---------------------------------------------------------------- YAML


NODE_SCHEMA = (
    "path string, keys array<string>, kind string, value string, line int, column int, key_line int, style string, text_line int, text_column int"
)

_BATCH = 8192


def yaml_nodes(files: DataFrame, *keep: str) -> DataFrame:
    """Every YAML node as (path, keys, kind, value, position, style) and text columns of its file; an invalid file gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        names = ["path", "keys", "kind", "value", "line", "column", "key_line", "style", "text_line", "text_column", *keep]
        types = [pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * len(keep)]
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        scalar, map_node = yaml.ScalarNode, yaml.MappingNode

        def walk(path, node, keys, key_line, source, kept, out):
            start = node.start_mark
            line, column = start.line + 1, start.column + 1
            if isinstance(node, scalar):
                first, at = start.line, start.column + (1 if node.style in ("'", '"') else 0)
                if node.style in ("|", ">"):
                    first += 1
                    body = next((s for s in source[first:] if s.strip()), "")
                    at = len(body) - len(body.lstrip())
                out.append((path, keys, "scalar", node.value, line, column, key_line, node.style or "", first + 1, at + 1, *kept))
                return
            mapping = isinstance(node, map_node)
            out.append((path, keys, "map" if mapping else "list", None, line, column, key_line, None, None, None, *kept))
            for i, item in enumerate(node.value):
                key, value = (str(item[0].value), item[1]) if mapping else (f"[{i}]", item)
                mark = item[0].start_mark if mapping else item.start_mark
                walk(path, value, [*keys, key], mark.line + 1, source, kept, out)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        # A batch holds thousands of files, each of them many nodes: rows leave as soon as they fill a batch of their own.
        rows: list[tuple] = []
        for batch in batches:
            for path, content, *kept in zip(*[batch.column(c).to_pylist() for c in ("path", "content", *keep)]):
                text = content.replace("\r\n", "\n")
                found: list[tuple] = []
                try:
                    root = yaml.compose(text, Loader=loader)
                    if root is not None:
                        walk(path, root, [], 1, text.split("\n"), kept, found)
                except (yaml.YAMLError, RecursionError):
                    continue
                rows += found
                if len(rows) >= _BATCH:
                    yield flush(rows)
                    rows = []
        if rows:
            yield flush(rows)

    return files.select("path", "content", *keep).mapInArrow(run, ", ".join([NODE_SCHEMA, *[f"{c} string" for c in keep]]))


def _key(n: int) -> Column:
    return F.try_element_at("keys", F.lit(n))


def _is(*pattern: str | None) -> Column:
    """Key path of exactly this shape; None stands for any key."""
    cond = F.size("keys") == len(pattern)
    for i, p in enumerate(pattern, 1):
        if p is not None:
            cond = cond & (_key(i) == p)
    return cond


def mask_expressions(text: Column, pattern: str) -> Column:
    """Each match becomes a neutral word of the same length."""
    parts = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.array_join(
        F.zip_with(parts, hits, lambda p, h: F.concat(F.coalesce(p, F.lit("")), F.coalesce(F.repeat(F.lit("x"), F.length(h)), F.lit("")))), ""
    )


EXPRESSION = r"\$\{\{.*?\}\}"
TEMPLATE = r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}"
UNTRUSTED = (
    r"github\.head_ref\b|github\.event\.[\w.*\[\]-]*\b"
    r"(title|body|message|head_ref|head_branch|label|ref|page_name|display_title|default_branch|email|name)\b"
)
FOREIGN_HEAD = r"github\.(event\.(pull_request\.head|workflow_run\.head)|head_ref)"
PRIVILEGED = ("pull_request_target", "workflow_run")


def _text_lines(nodes: DataFrame, *keep: str) -> DataFrame:
    """Lines of scalar nodes at their place in the file."""
    return nodes.select("path", *keep, "text_line", "text_column", F.posexplode(F.split("value", "\n")).alias("i", "text")).filter("text <> ''").select(
        "path", *keep, (F.col("text_line") + F.col("i")).cast("int").alias("line"), "text_column", "text"
    )


def _program(value: Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(F.trim(value), r"\s+"), 1), "/"), -1)


def workflow_steps(nodes: DataFrame) -> DataFrame:
    """One row per step of a workflow job or composite action, with the shell that runs it."""
    in_job = (F.size("keys") >= 4) & (_key(1) == "jobs") & (_key(3) == "steps")
    in_action = (F.size("keys") >= 3) & (_key(1) == "runs") & (_key(2) == "steps")
    shift = F.when(in_job, 2).otherwise(1)
    rows = nodes.filter(in_job | in_action).select(
        "*", F.when(in_job, _key(2)).alias("job"), F.element_at("keys", shift + 2).alias("step"),
        F.array_join(F.slice("keys", shift + 3, F.size("keys")), "/").alias("field"))
    pick = lambda field, col: F.max(F.when(F.col("field") == field, F.col(col)))
    steps = rows.groupBy("path", "job", "step").agg(
        pick("run", "value").alias("run"), pick("run", "text_line").alias("text_line"), pick("run", "text_column").alias("text_column"),
        pick("shell", "value").alias("shell"), pick("uses", "value").alias("uses"), pick("uses", "line").alias("uses_line"),
        pick("with/ref", "value").alias("ref"), pick("with", "line").alias("with_line"))
    jobs = nodes.filter((_key(1) == "jobs") & (F.size("keys") >= 3)).groupBy("path", _key(2).alias("job")).agg(
        F.max(F.when(_is("jobs", None, "defaults", "run", "shell"), F.col("value"))).alias("job_shell"),
        F.bool_or((_key(3) == "runs-on") & F.contains(F.lower("value"), F.lit("windows"))).alias("windows"))
    flow = nodes.filter(_is("defaults", "run", "shell")).select("path", F.col("value").alias("flow_shell"))
    joined = steps.join(jobs, ["path", "job"], "left").join(flow, "path", "left")
    named = lambda c: F.when(F.col(c).isNotNull(), _program(F.col(c)))
    inherited = F.coalesce(named("job_shell"), named("flow_shell"), F.when(F.col("windows"), "pwsh").otherwise("bash"))
    # A composite action inherits nothing from a workflow.
    default = F.when(F.col("job").isNull(), F.lit("bash")).otherwise(inherited)
    return joined.withColumn("shell", F.coalesce(named("shell"), default)).drop("job_shell", "windows", "flow_shell")


def workflow_run_blocks(nodes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Shell lines of run steps (path, line, text_column, text, shell), expressions still in place."""
    steps = (workflow_steps(nodes) if steps is None else steps).filter(F.col("run").isNotNull() & F.col("shell").isin("bash", "sh") & (F.trim("run") != ""))
    return _text_lines(steps.withColumnRenamed("run", "value"), "shell")


# Top-level keys of a GitLab file that are not jobs.
GITLAB_RESERVED = ("variables", "stages", "include", "workflow", "image", "services", "cache", "spec")
_SCRIPTS = ("before_script", "script", "after_script")


def gitlab_blocks(nodes: DataFrame) -> DataFrame:
    """Shell lines of GitLab scripts: global, default and per job; nested lists are skipped."""
    top = _key(1).isin(*_SCRIPTS) & ((F.size("keys") == 1) | ((F.size("keys") == 2) & F.startswith(_key(2), F.lit("["))))
    in_job = (
        ~_key(1).isin(*GITLAB_RESERVED) & ~F.endswith(_key(1), F.lit("_script")) & (_key(1) != "script") & _key(2).isin(*_SCRIPTS)
        & ((F.size("keys") == 2) | ((F.size("keys") == 3) & F.startswith(_key(3), F.lit("["))))
    )
    return _text_lines(nodes.filter((F.col("kind") == "scalar") & (top | in_job)).withColumn("shell", F.lit("bash")), "shell")


ANSIBLE_SHELL = ("shell", "ansible.builtin.shell", "ansible.legacy.shell")


def ansible_blocks(nodes: DataFrame) -> DataFrame:
    """Shell lines of Ansible shell tasks at any depth; the executable decides the dialect."""
    last = F.element_at("keys", -1)
    parent = F.array_join(F.slice("keys", F.lit(1), F.greatest(F.size("keys") - 1, F.lit(0))), "/")
    tasks = nodes.filter((F.size("keys") > 0) & (F.col("kind") == "scalar"))
    free = tasks.filter(last.isin(*ANSIBLE_SHELL)).withColumn("task", parent)
    grand = F.array_join(F.slice("keys", F.lit(1), F.greatest(F.size("keys") - 2, F.lit(0))), "/")
    held = F.try_element_at("keys", F.greatest(F.size("keys") - 1, F.lit(1)))
    cmd = tasks.filter((F.size("keys") > 1) & (last == "cmd") & held.isin(*ANSIBLE_SHELL)).withColumn("task", grand)
    exe = tasks.filter((F.size("keys") > 1) & (last == "executable") & (held.isin(*ANSIBLE_SHELL) | (held == "args"))).groupBy("path", grand.alias("task")).agg(
        F.max(_program(F.col("value"))).alias("exe"))
    both = free.unionByName(cmd).join(exe, ["path", "task"], "left")
    return _text_lines(both.withColumn("shell", F.when(F.contains("exe", F.lit("bash")), "bash").otherwise("sh")), "shell")


def _mark(rule: str, line: Column, extra: Column, severity: Column | None = None) -> list[Column]:
    return ["path", F.lit(rule).alias("rule"), line.cast("int").alias("line"), extra.alias("extra"),
            (severity if severity is not None else F.lit(None)).cast("string").alias("own_severity")]


def untrusted_expressions(nodes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """SEC023: text a stranger controls, placed in a run block."""
    lines = workflow_run_blocks(nodes, steps)
    hits = lines.select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(f"({EXPRESSION})"), F.lit(1))).alias("e"))
    return hits.filter(F.col("e").rlike(UNTRUSTED)).select(*_mark("SEC023", F.col("line"), F.trim("e")))


def _unpinned_images(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~S.is_pinned_image(F.col("value"))).select(*_mark("CI005", F.col("line"), F.col("value")))


def _plain_secrets(nodes: DataFrame) -> DataFrame:
    v = F.col("value")
    name = F.when(F.element_at("keys", -1) == "value", F.try_element_at("keys", F.greatest(F.size("keys") - 1, F.lit(1)))).otherwise(F.element_at("keys", -1))
    literal = (F.trim(v) != "") & ~F.contains(v, F.lit("${{")) & ~F.startswith(v, F.lit("$"))
    return nodes.filter((F.col("kind") == "scalar") & S.is_secret_name(name) & literal).select(*_mark("CI004", F.col("key_line"), name))


def workflow_rules(nodes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """CI001–CI005 of workflow files, as (path, rule, line, extra, own_severity).

    ``nodes`` and their ``steps``, if at hand, are read many times: hand over checkpointed frames.
    """
    steps = cut(workflow_steps(nodes)) if steps is None else steps
    uses = nodes.filter(_is("jobs", None, "uses")).select("path", F.col("value").alias("uses"), F.col("line").alias("uses_line")).unionByName(
        steps.filter("uses is not null").select("path", "uses", "uses_line"))
    remote = uses.filter(~F.startswith("uses", F.lit("./")))
    is_image = F.startswith("uses", F.lit("docker://"))
    owner = F.col("uses").rlike("^(actions|github)/")
    floating = ~F.col("uses").rlike(r"@[0-9a-f]{40}\z")
    actions = remote.filter(~is_image & floating).select(*_mark("CI001", F.col("uses_line"), F.col("uses"), F.when(owner, "low")))
    images = remote.filter(is_image).select("path", F.substr("uses", F.lit(10)).alias("value"), F.col("uses_line").alias("line"))
    boxes = nodes.filter((F.col("kind") == "scalar") & (
        _is("jobs", None, "container") | _is("jobs", None, "container", "image") | _is("jobs", None, "services", None) | _is("jobs", None, "services", None, "image")))
    write_all = nodes.filter((_is("permissions") | _is("jobs", None, "permissions")) & (F.col("value") == "write-all")).select(
        *_mark("CI002", F.col("line"), F.col("value"), F.lit("high")))
    job = _is("jobs", None) & (F.col("kind") == "map")
    limits = nodes.groupBy("path").agg(F.bool_or(_is("permissions")).alias("limited"))
    limited_jobs = nodes.filter(_is("jobs", None, "permissions")).select("path", _key(2).alias("job"))
    open_jobs = nodes.filter(job).select("path", _key(2).alias("job"), "key_line").join(limited_jobs, ["path", "job"], "left_anti").groupBy("path").agg(
        F.min("key_line").alias("key_line"), F.min_by("job", "key_line").alias("job"))
    missing = open_jobs.join(limits.filter("not limited"), "path").select(*_mark("CI002", F.col("key_line"), F.col("job")))
    triggers = nodes.filter((_is("on") | _is("on", None)) & (F.coalesce("value", F.lit("")).isin(*PRIVILEGED) | F.coalesce(_key(2), F.lit("")).isin(*PRIVILEGED)))
    foreign = steps.filter(F.startswith("uses", F.lit("actions/checkout")) & F.col("ref").rlike(FOREIGN_HEAD) & F.col("job").isNotNull()).join(
        triggers.select("path").distinct(), "path", "left_semi").select(*_mark("CI003", F.col("with_line"), F.trim("ref")))
    env = nodes.filter(_is("env", None) | _is("jobs", None, "env", None) | _is("jobs", None, "steps", None, "env", None) | _is("runs", "steps", None, "env", None))
    return (
        actions.unionByName(_unpinned_images(images)).unionByName(_unpinned_images(boxes)).unionByName(write_all)
        .unionByName(missing).unionByName(foreign).unionByName(_plain_secrets(env))
    )


def gitlab_rules(nodes: DataFrame) -> DataFrame:
    """CI004 and CI005 of GitLab files."""
    boxes = nodes.filter((F.col("kind") == "scalar") & (
        _is("image") | _is("image", "name") | _is(None, "image") | _is(None, "image", "name")
        | ((_is("services", None) | _is(None, "services", None)) & F.startswith(F.element_at("keys", -1), F.lit("[")))
        | (((_key(1) == "services") | (_key(2) == "services")) & (F.element_at("keys", -1) == "name") & (F.size("keys") >= 3))))
    env = nodes.filter(_is("variables", None) | _is("variables", None, "value") | _is(None, "variables", None) | _is(None, "variables", None, "value"))
    return _unpinned_images(boxes).unionByName(_plain_secrets(env))


# ---------------------------------------------------------------- container files

_INSTRUCTION = re.compile(r"^(\s*)([A-Za-z]+)(\s+|$)")
_ESCAPE = re.compile(r"^#\s*escape\s*=\s*(\S)", re.I)
_RUN_DOC = re.compile(r"""^<<(-?)(["']?)(\w+)\2""")
_RUN_OPTS = re.compile(r"^(?:--\S+\s+)+")

DOCKER_SCHEMA = (
    "path string, line int, end_line int, instr string, args string, shell string, pipefail boolean, "
    "code array<struct<line:int,text:string>>"
)


def _instructions(numbered: Iterator[tuple[int, str]], escape: str) -> Iterator[list[tuple[int, str]]]:
    """The lines of one instruction after the other; blank lines and comments are left out, also between continued lines."""
    group: list[tuple[int, str]] = []
    for n, s in numbered:
        if s.strip() and not s.lstrip().startswith("#"):
            group.append((n, s))
            if not s.rstrip().endswith(escape):
                yield group
                group = []
    if group:
        yield group


def _here_document(numbered: Iterator[tuple[int, str]], end: str, indented: bool) -> tuple[list[tuple[int, str]], int | None]:
    """The lines up to the end word, and the line of the end word if there is one."""
    body: list[tuple[int, str]] = []
    for n, s in numbered:
        if (s.strip() if indented else s) == end:
            return body, n
        body.append((n, s))
    return body, None


def _docker(text: str) -> Iterator[tuple]:
    """(line, end line, instruction, arguments, shell, pipefail, shell lines) of one file."""
    lines = text.replace("\r\n", "\n").removesuffix("\n").split("\n")
    named = [m.group(1) for m in map(_ESCAPE.match, takewhile(lambda s: s.startswith("#"), lines)) if m]
    escape = named[-1] if named else "\\"
    numbered = iter(enumerate(lines, 1))
    shell, pipefail = "sh", False
    for group in _instructions(numbered, escape):
        (line, head), last = group[0], group[-1][0]
        start = _INSTRUCTION.match(head)
        if not start:
            continue
        instr, whole = start.group(2).upper(), " ".join(s for _, s in group)
        used, code = shell, []
        if instr == "SHELL":
            words = re.findall(r'"([^"]*)"', whole)
            program = words[0].rpartition("/")[2] if words else ""
            used = shell = program if program in ("bash", "sh", "dash") else None
            pipefail = "pipefail" in words
        elif instr == "RUN" and shell:
            body = _RUN_OPTS.sub("", head[start.end():])
            doc = _RUN_DOC.match(body)
            if doc:
                code, closed = _here_document(numbered, doc.group(3), bool(doc.group(1)))
                last = closed or len(lines)
                first = code[0][1] if code else ""
                used = ("bash" if "bash" in first else "sh") if first.startswith("#!") else used
            elif not body.startswith("["):
                code = [(line, body.rjust(len(head))), *group[1:]]
        yield line, last, instr, whole.replace(f"{escape} ", " ")[start.end():].strip(), used, pipefail, code


def docker_instructions(files: DataFrame) -> DataFrame:
    """Instructions of container files, continuation lines joined, with their shell lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (path, line, end, instr, args, shell, pipefail, [{"line": n, "text": t} for n, t in code])
                for path, content in zip(pdf["path"], pdf["content"])
                for line, end, instr, args, shell, pipefail, code in _docker(content)
            ]
            yield pd.DataFrame(rows, columns=["path", "line", "end_line", "instr", "args", "shell", "pipefail", "code"])

    return files.select("path", "content").mapInPandas(run, DOCKER_SCHEMA)


def _words(args: Column) -> Column:
    return F.filter(F.split(F.trim(args), r"\s+"), lambda w: w != "")


def docker_rules(instructions: DataFrame) -> DataFrame:
    """DKR001–DKR007 as (path, rule, line, extra, own_severity)."""
    d = instructions.drop("code").withColumn("words", _words(F.col("args")))
    args = F.col("args")
    plain = F.filter("words", lambda w: ~F.startswith(w, F.lit("--")))
    upper = F.transform("plain", lambda w: F.upper(w))
    at = F.array_position(upper, "AS").cast("int")
    froms = d.filter("instr = 'FROM'").withColumn("plain", plain).filter(F.size("plain") > 0).select(
        "path", "line", F.element_at("plain", 1).alias("image"), F.when(at > 0, F.lower(F.try_element_at("plain", at + 1))).alias("stage"))
    stages = froms.filter("stage is not null").select(F.col("path").alias("p"), F.col("line").alias("l"), "stage").alias("s")
    f = froms.select("path", "line", "image").alias("f")
    base = f.join(stages, (F.col("f.path") == F.col("s.p")) & (F.lower("f.image") == F.col("s.stage")) & (F.col("s.l") <= F.col("f.line")), "left_anti")
    dkr001 = base.filter((F.col("image") != "scratch") & ~S.is_pinned_image(F.col("image"))).select(*_mark("DKR001", F.col("line"), F.col("image")))

    last = froms.groupBy("path").agg(F.max("line").alias("from_line"), F.max_by("image", "line").alias("image"))
    users = d.filter((F.col("instr") == "USER") & (F.size("words") > 0)).select("path", "line", F.element_at("words", 1).alias("user"))
    final = users.join(last, "path").filter("line > from_line").groupBy("path").agg(F.max("line").alias("user_line"), F.max_by("user", "line").alias("user"))
    ending = last.join(final, "path", "left").filter((F.col("image") != "scratch") & ~F.contains("image", F.lit("nonroot")))
    root = F.col("user").rlike(r"^(root|0)(:|\z)")
    dkr002 = ending.filter(F.col("user").isNull() | root).select(*_mark(
        "DKR002", F.coalesce("user_line", "from_line"), F.coalesce(F.concat(F.lit("USER "), "user"), F.col("image"))))

    add = d.filter("instr = 'ADD'").withColumn("plain", plain).filter(F.size("plain") >= 2).select(
        "path", "line", F.exists("words", lambda w: F.startswith(w, F.lit("--checksum"))).alias("checked"),
        F.explode(F.slice("plain", F.lit(1), F.size("plain") - 1)).alias("src"))
    remote = F.col("src").rlike(r"^(https?|git)://|^git@")
    dkr003 = add.filter(remote & ~F.col("checked") & ~F.endswith("src", F.lit(".git"))).select(*_mark("DKR003", F.col("line"), F.col("src")))
    dkr004 = add.filter(~remote & ~F.col("src").rlike(r"\.(tar(\.\w+)?|tgz|tbz2?|txz)\z")).select(*_mark("DKR004", F.col("line"), F.col("src")))

    old_form = (F.col("instr") == "ENV") & (F.size("words") >= 2) & ~F.contains(F.element_at("words", 1), F.lit("="))
    pair = lambda w: F.struct(
        F.substring_index(w, "=", 1).alias("name"), w.alias("w"))
    env = d.filter("instr in ('ENV', 'ARG')").select(
        "path", "line", "instr",
        F.explode(F.when(old_form, F.array(F.struct(F.element_at("words", 1).alias("name"),
                  F.concat(F.element_at("words", 1), F.lit("="), F.array_join(F.slice("words", F.lit(2), F.size("words")), " ")).alias("w")))).otherwise(F.transform("words", pair))).alias("p"))
    value = F.when(F.contains("p.w", F.lit("=")), F.expr("substring(p.w, length(p.name) + 2)"))
    literal = value.isNotNull() & (F.regexp_replace(value, r"""^["']|["']\z""", "") != "") & ~F.startswith(value, F.lit("$"))
    dkr005 = env.filter(S.is_secret_name(F.col("p.name")) & (F.coalesce(literal, F.lit(False)) | (F.col("instr") == "ARG"))).select(
        *_mark("DKR005", F.col("line"), F.col("p.name"), F.when(~F.coalesce(literal, F.lit(False)), "medium")))

    run = d.filter("instr = 'RUN'")
    apt = args.rlike(r"\bapt(-get)?\s+(-\S+\s+)*install\b")
    cached = F.contains(args, F.lit("--mount=type=cache"))
    dnf = args.rlike(r"\b(dnf|yum|microdnf)\s+(-\S+\s+)*install\b") & ~args.rlike(r"\b(dnf|yum|microdnf)\s+clean\s+all\b")
    apk = args.rlike(r"\bapk\s+(-\S+\s+)*add\b") & ~F.contains(args, F.lit("--no-cache"))
    hit = lambda rule, what: F.struct(F.lit(rule).alias("rule"), F.lit(what).alias("extra"))
    marks = F.array_compact(F.array(
        F.when(apt & ~F.contains(args, F.lit("--no-install-recommends")), hit("DKR006", "apt-get install")),
        F.when(apt & ~F.contains(args, F.lit("/var/lib/apt/lists")) & ~cached, hit("DKR007", "apt")),
        F.when(dnf & ~cached, hit("DKR007", "dnf / yum")), F.when(apk & ~cached, hit("DKR007", "apk"))))
    layers = run.select("path", "line", F.explode(marks).alias("h")).select(
        "path", "h.rule", "line", "h.extra", F.lit(None).cast("string").alias("own_severity"))
    out = dkr001
    for part in (dkr002, dkr003, dkr004, dkr005, layers):
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- make files

_MAKE_RULE = re.compile(r"^[^\s#=:][^=]*?::?(?!=)")
_MAKE_ASSIGN = re.compile(r"^[^\s#=]*\s*(?:[:?+!]|::)?=")
_MAKE_WORD = re.compile(r"^\s*(?:ifn?eq|ifn?def|else|endif|[-s]?include)\b")
_MAKE_SHELL = re.compile(r"^\s*(?:(?:override|export)\s+)?SHELL\s*[:?+!]?=\s*(\S+)")


_EXPANSION = re.compile(r"\$\((?:[^()]|\([^()]*\))*\)|\$\{[^{}]*\}")


def _unmake(text: str) -> str:
    """A recipe line as the shell gets it; make expansions, inner ones first, become a word of the same length."""
    text = text.replace("$$", "\0")
    same = lambda m: "x" * len(m[0])
    while _EXPANSION.search(text):
        text = _EXPANSION.sub(same, text)
    return re.sub(r"\$[({].*", same, re.sub(r"\$[^({]", "xx", text)).replace("\0", "$")


def _recipes(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(line, recipe text, shell text, shell) of the recipe lines of one make file."""
    shell, found = "sh", []
    in_rule = in_define = continued = False
    for n, s in enumerate(text.replace("\r\n", "\n").removesuffix("\n").split("\n"), 1):
        said = _MAKE_SHELL.match(s)
        if in_define:
            in_define = not re.match(r"\s*endef\b", s)
        elif continued or in_rule and s.startswith("\t"):
            body = s.removeprefix("\t")
            found.append((n, (body if continued else body.lstrip("@+- \t")).rjust(len(s))))
            continued = s.endswith("\\")
        elif re.match(r"\s*define\b", s):
            in_define = True
        elif s.strip() and not s.lstrip().startswith("#") and not _MAKE_WORD.match(s):
            in_rule = bool(_MAKE_RULE.match(s)) and not _MAKE_ASSIGN.match(s)
        if said and not in_define:
            shell = "sh" if said.group(1).rpartition("/")[2] in ("sh", "dash") else "bash"
    for n, recipe in found:
        yield n, recipe, _unmake(recipe), shell


def make_recipes(files: DataFrame) -> DataFrame:
    """Recipe lines of make files as (path, line, recipe, text, shell)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *r) for p, c in zip(pdf["path"], pdf["content"]) for r in _recipes(c)]
            yield pd.DataFrame(rows, columns=["path", "line", "recipe", "text", "shell"])

    return files.select("path", "content").mapInPandas(run, "path string, line int, recipe string, text string, shell string")


MAKE_RM = r"""\brm\s+(?:-\w+\s+)*-[a-zA-Z]*[rR][a-zA-Z]*\s+(?:\S+\s+)*?"?(\$[({]\w+[)}])/"""


def make_rules(recipes: DataFrame) -> DataFrame:
    """SEC007 of make files: recursive delete under a make variable that may be empty."""
    hit = F.regexp_extract("recipe", MAKE_RM, 1)
    return recipes.filter(hit != "").select(*_mark("SEC007", F.col("line"), hit))


# ---------------------------------------------------------------- virtual scripts


def shell_lines(files: DataFrame) -> DataFrame:
    """Shell text of host files at its own lines: (path, line, raw, shell, pipefail)."""
    hosts = files
    # Nodes carry the kind of their file, so they meet the files no second time.
    nodes = cut(yaml_nodes(hosts.filter(F.col("host_kind").isin("github_actions", "gitlab_ci", "ansible")), "host_kind"))

    def of(name: str) -> DataFrame:
        return nodes.filter(F.col("host_kind") == name).drop("host_kind")

    flow = workflow_run_blocks(of("github_actions")).select("path", "line", mask_expressions(F.col("text"), EXPRESSION).alias("raw"), "shell", F.lit(True).alias("pipefail"))
    lab = gitlab_blocks(of("gitlab_ci")).select("path", "line", F.col("text").alias("raw"), "shell", F.lit(False).alias("pipefail"))
    play = ansible_blocks(of("ansible")).select("path", "line", mask_expressions(F.col("text"), TEMPLATE).alias("raw"), "shell", F.lit(False).alias("pipefail"))
    docker = docker_instructions(hosts.filter("host_kind = 'dockerfile'")).select("path", "shell", "pipefail", F.explode("code").alias("c")).select(
        "path", "c.line", F.col("c.text").alias("raw"), "shell", "pipefail")
    make = make_recipes(hosts.filter("host_kind = 'makefile'")).select("path", "line", F.col("text").alias("raw"), "shell", F.lit(False).alias("pipefail"))
    return flow.unionByName(lab).unionByName(play).unionByName(docker).unionByName(make)


def virtual_scripts(files: DataFrame) -> DataFrame:
    """Host files as shell scripts with the same line numbers (path, content, dialect, pipefail).

    A script is one row, as its host file is: what is gathered per path is no larger than the file.
    """
    rows = shell_lines(files).groupBy("path").agg(
        F.collect_list(F.struct("line", "raw")).alias("rows"),
        F.max("line").alias("n"), F.bool_or(~F.col("shell").isin("sh", "dash")).alias("bash"), F.bool_or("pipefail").alias("pipefail"))
    rows = rows.withColumn("rows", F.array_sort("rows"))
    placed = F.transform(
        "rows",
        lambda r, i: F.concat(F.repeat(F.lit("\n"), r["line"] - F.coalesce(F.try_element_at("rows", F.nullif(i, F.lit(0)))["line"], F.lit(1))), r["raw"]),
    )
    return rows.select(
        "path", F.concat(F.array_join(placed, ""), F.lit("\n")).alias("content"), F.when(F.col("bash"), "bash").otherwise("sh").alias("dialect"), "pipefail"
    )


def host_rules(files: DataFrame) -> DataFrame:
    """Rules of host files that need no shell lexing."""
    hosts = files
    flow = cut(yaml_nodes(hosts.filter("host_kind = 'github_actions'")))
    lab = cut(yaml_nodes(hosts.filter("host_kind = 'gitlab_ci'")))
    docker = cut(docker_instructions(hosts.filter("host_kind = 'dockerfile'")))
    make = make_recipes(hosts.filter("host_kind = 'makefile'"))
    steps = cut(workflow_steps(flow))
    return (
        workflow_rules(flow, steps).unionByName(untrusted_expressions(flow, steps)).unionByName(gitlab_rules(lab))
        .unionByName(docker_rules(docker)).unionByName(make_rules(make))
    )


def host_directive_lines(shell: DataFrame, source: DataFrame) -> DataFrame:
    """Lines to search for directives: the shell text, else a comment of the host file."""
    joined = source.select("path", "line", F.col("raw").alias("host")).join(shell.select("path", "line", F.col("raw").alias("shell_text")), ["path", "line"], "left")
    comment = F.when(F.col("host").rlike(r"^\s*#"), F.col("host"))
    return joined.select("path", "line", F.coalesce(F.nullif("shell_text", F.lit("")), comment, F.lit("")).alias("raw"))
