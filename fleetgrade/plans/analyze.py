"""The whole analysis of a fleet: files to findings, scores and explanations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.catalog import BUILTIN_IDS, RULES
from fleetgrade.operators import commands as CM
from fleetgrade.operators import custom as UD
from fleetgrade.operators import explain as EX
from fleetgrade.operators import findings as FD
from fleetgrade.operators import fixes as FX
from fleetgrade.operators import hosts as HF
from fleetgrade.operators import lines as LN
from fleetgrade.operators import python as PY
from fleetgrade.operators import scoring as AG
from fleetgrade.operators import shell_rules as SR
from fleetgrade.session import broadcast_by_measure, cut, gathered, parted_by_file, sorted_shuffles
from fleetgrade.settings import only, repo_of, settings_of
from fleetgrade.sources.tools import read_outputs, tool_runs


# Rules that hold in some contexts only, or that a profile turns off.
HIDDEN = sorted({r.rule for r in RULES if r.contexts} | {rule for p in dims.PROFILES.values() for rule in p["disabled"]})


@dataclass(frozen=True)
class Options:
    profile: str = "standard"
    contexts: tuple[str, ...] = ()
    disabled: tuple[str, ...] = ()
    overrides: dict = field(default_factory=dict)
    custom: tuple[UD.CustomRule, ...] = ()
    directive_word: str = FD.DIRECTIVE_WORD
    # Findings of so many lines or more count as their first line in dedup; no limit by default.
    max_span: int | None = None


@dataclass(frozen=True)
class Report:
    files: DataFrame
    findings: DataFrame
    tool_runs: DataFrame
    suppressed: DataFrame
    penalties: DataFrame
    scores: DataFrame
    impacts: DataFrame


def raw_findings(model: DataFrame, labels: DataFrame, options: Options, inventory: DataFrame | None, settings: DataFrame, roots: DataFrame) -> DataFrame:
    """Built-in, command, dependency and custom findings of modelled files, before dedup."""
    shell = model.filter(F.col("host_kind").isNull() & (F.col("dialect") != "python"))
    python = model.filter(F.col("host_kind").isNull() & (F.col("dialect") == "python"))
    hosts = model.filter(F.col("host_kind").isNotNull())
    # The lowest limits of the fleet decide what is measured; each file's own limit decides what is found.
    low = settings.agg(*[F.coalesce(F.min(f"s.{k}"), F.lit(0)).alias(k) for k in ("max_line", "max_nesting")]).first()

    shell_lines = LN.mask_lines(shell, low.max_nesting)
    # Every part is stored as soon as it is known: findings are few, and later steps plan over plain scans.
    parts = [cut(SR.shell_findings(shell_lines, shell, settings=settings, max_line=low.max_line))]

    virtual = cut(HF.virtual_scripts(hosts).withColumn("has_crlf", F.lit(False)))
    inside = SR.shell_findings(LN.mask_lines(virtual, low.max_nesting), virtual, settings=settings, max_line=low.max_line)
    parts.append(cut(LN.drop_embedded_rules(inside, virtual.select("path", "pipefail"))))
    host_hits = HF.host_rules(hosts).withColumn("position", (F.lit(2) * 10**12 + F.col("line") * 10**5 + F.crc32(F.concat_ws("|", "rule", "extra")) % 10**5).cast("bigint"))
    parts.append(gathered(SR.as_findings(host_hits, None), labels))

    kinds = LN.python_lines(python)
    py_counts = cut(LN.count_python_lines(kinds))
    py_lines = LN.to_lines(python)
    facts = cut(PY.python_facts(python))
    # Files that the parser refuses are read line by line.
    refused = facts.filter(~F.col("parsed")).select("path")
    guessed = PY.lexical_facts(py_lines.join(refused, "path", "left_semi")).withColumn("parsed", F.lit(False))
    facts = cut(facts.filter("parsed").unionByName(guessed))
    py_hits = PY.python_rule_hits(py_lines, facts, py_counts)
    py_hits = py_hits.withColumn("position", (F.col("line").cast("bigint") * 1000 + F.crc32("rule") % 1000).cast("bigint"))
    parts.append(cut(SR.as_findings(py_hits, None)))

    if inventory is not None:
        missing = CM.missing_commands(CM.external_commands(shell_lines), CM.guarded_commands(shell_lines), inventory)
        missing = missing.withColumn("position", F.lit(3 * 10**12).cast("bigint") + F.crc32("extra"))
        parts.append(cut(SR.as_findings(missing, None)))
        imports = PY.python_imports(python, model, inventory)
        wrong = PY.check_imports(imports, PY.declared_for(python, PY.declared_deps(model), roots))
        wrong = SR.as_findings(wrong.withColumn("position", F.lit(4 * 10**12).cast("bigint") + F.crc32("extra")), None)
        parts.append(cut(wrong.withColumn("tool", F.lit("pydeps"))))
    if options.custom:
        text = LN.to_lines(model, "dialect")
        parts.append(cut(UD.custom_rules(text, options.custom, model.select("path", "dialect"))))
    found = FD.union_findings([FD.complete(p) for p in parts]).filter("path is not null")
    # Only rules that some context or profile hides ask for the settings of their file.
    hidden = F.coalesce(F.col("rule").isin(*HIDDEN), F.lit(True))
    asked = FD.hide_by_context(found.filter(hidden).join(only(settings, "contexts", "profile_off"), "path"), F.col("s.contexts"))
    shown = asked.filter((F.col("tool") != "builtin") | ~F.array_contains("s.profile_off", F.col("rule"))).drop("s")
    return found.filter(~hidden).unionByName(shown)


def analyze(
    files: DataFrame, options: Options = Options(), outputs: DataFrame | None = None, inventory: DataFrame | None = None,
    configs: DataFrame | None = None, roots: DataFrame | None = None,
) -> Report:
    """Analyse ``files(path, content)`` with recorded tool ``outputs(path, tool, output)``.

    ``configs(folder, …)`` give the files below a folder settings of their own (:mod:`fleetgrade.settings`); the options
    are those of all other files. ``roots(folder)`` are the repositories, by default the first parts of the paths.

    Order: dedup, suppression, stale directives on raw findings,
    enrichment, escalation, configuration, fingerprints, masking, corrections, scores.
    """
    broadcast_by_measure(files.sparkSession)
    sorted_shuffles(files.sparkSession)
    model = LN.with_model(files)
    labels = cut(model.select("path", "dialect", "host_kind"))
    if roots is None:
        roots = labels.select(repo_of().alias("folder")).distinct()
    settings = settings_of(labels, configs, roots, options.profile, options.contexts, options.disabled, options.overrides)
    raw = raw_findings(model, labels, options, inventory, settings, roots)
    built_in = labels.select("path", F.lit("builtin").alias("tool"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("version"), F.lit(0).cast("bigint").alias("findings"))
    runs = built_in
    if outputs is not None:
        none = files.sparkSession.createDataFrame([], "kind string, name string, dist string")
        python = model.filter(F.col("host_kind").isNull() & (F.col("dialect") == "python"))
        imports = PY.python_imports(python, model, inventory if inventory is not None else none)
        told = read_outputs(outputs, imports=PY.imported_dists(imports))
        hosts = labels.filter(F.col("host_kind").isNotNull()).select("path", F.lit(False).alias("pipefail"))
        told = LN.drop_embedded_rules(told, hosts)
        runs = built_in.unionByName(tool_runs(outputs, told))
        raw = FD.with_priority(raw.drop("tool_rank").unionByName(told))
    raw = gathered(raw, labels)

    # Only files that can hold a directive give their lines.
    commented = LN.to_lines(files.filter(FD.may_direct(F.col("content"), options.directive_word)))
    directives = cut(FD.parse_directives(commented, labels.filter("dialect = 'python'").select("path"), options.directive_word))
    deduped = cut(FD.deduplicate(raw, options.max_span))
    kept = cut(FD.suppress(deduped, directives))
    # Read three times: with the findings, for their lines and for the size of the files.
    stale = cut(FD.complete(FD.stale_directives(directives, raw, runs, BUILTIN_IDS).withColumn("position", F.lit(9 * 10**12).cast("bigint") + F.col("line"))))
    all_kept = FD.with_priority(kept.drop("tool_rank").unionByName(stale))

    # What is asked of a file's row meets its findings once; ``_hosts`` has an entry for each row of a host file.
    hosts = labels.groupBy("path").agg(F.collect_list(F.when(F.col("host_kind").isNotNull(), F.lit(True))).alias("_hosts"))
    asked = only(settings, "contexts", "disabled", "overrides").join(hosts, "path", "left")
    raised = FD.escalate(FD.enrich(all_kept).join(asked, "path"), F.col("s.contexts"))
    shaped = FD.apply_config(raised, F.col("s.disabled"), F.col("s.overrides")).drop("s")
    # The lines of the fleet meet the findings once; fingerprints and snippets read what that leaves.
    texts = cut(LN.lines_at(files, all_kept))
    large = cut(all_kept.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > FD.FOLD_TOGETHER).select("path"))
    with parted_by_file(files.sparkSession):
        marked = cut(FD.print_and_show(shaped, texts, raw, large))
    lexed = LN.mask_lines(model.filter(F.col("host_kind").isNull() & (F.col("dialect") != "python")))
    fixable = marked.filter(FX.has_fix())
    touched = fixable.select("path", "line").distinct()
    fixed = FX.attach_fixes(fixable, cut(lexed.join(touched, ["path", "line"], "left_semi"))).unionByName(marked.filter(~FX.has_fix()))
    final = fixed.select("*", F.explode_outer("_hosts").alias("_host")).withColumn(
        "edits", F.when(F.col("_host").isNull(), F.col("edits")).otherwise(F.slice("edits", 1, 0))).drop("_host", "_hosts", "tool_rank")
    final = cut(final)

    shell_counts = LN.content_flags(model).select("path", "dialect", "total_lines", "code_lines", "comment_lines").filter("dialect <> 'python'")
    py_counts = LN.count_python_lines(LN.python_lines(model.filter("dialect = 'python'"))).select("path", F.lit("python").alias("dialect"), "total_lines", "code_lines", "comment_lines")
    listed = cut(shell_counts.unionByName(py_counts))
    penalties = cut(AG.rule_penalties(final, listed.join(only(settings, "weights", "reference_lines"), "path")))
    return Report(
        files=listed, findings=final, tool_runs=runs, suppressed=FD.suppressed_count(deduped, kept), penalties=penalties,
        scores=AG.script_scores(listed, penalties), impacts=EX.rule_impacts(final, penalties))


def contexts_of(names: Iterable[str]) -> tuple[str, ...]:
    return tuple(n for n in names if n in dims.ESCALATIONS)
