"""Catalogue of the built-in rules, and operators over rule catalogues."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    rule: str
    category: str
    severity: str
    title: str
    hint: str
    contexts: tuple[str, ...] = ()

    @property
    def language(self) -> str:
        return "python" if self.rule.startswith("PY") else "shell"


def _family(category: str, rows: str) -> list[Rule]:
    """Rows of ``id | severity | title | hint [| contexts]``."""
    out = []
    for row in rows.strip().splitlines():
        cells = [c.strip() for c in row.split("|")]
        contexts = tuple(cells[4].split()) if len(cells) > 4 else ()
        out.append(Rule(cells[0], category, cells[1], cells[2].replace(" OR ", "|"), cells[3], contexts))
    return out


RULES: tuple[Rule, ...] = tuple(
    _family("security", """
    SEC001 | critical | a download is run by a shell | Save it, check its signature, then run it.
    SEC002 | critical | a secret is written in the script | Read it from a protected file or a vault and revoke it.
    SEC003 | high | eval runs expanded text | Use an array or a case statement.
    SEC004 | high | everyone may write the file | Give write access to the owner or a group only.
    SEC005 | high | certificate or host key check is off | Keep the check on and add the right authority.
    SEC006 | medium | download without encryption | Use https.
    SEC007 | high | recursive delete under a variable that may be empty | Guard the variable, as in ${VAR:?}.
    SEC008 | critical | recursive delete of a system folder | Name the exact subfolder to delete.
    SEC009 | medium | predictable name in a shared temporary folder | Create it with mktemp.
    SEC010 | high | password on a command line | Pass it by file, environment or standard input.
    SEC011 | medium | code sourced from a shared folder or the network | Source only protected local files.
    SEC012 | low | execution trace is on | Trace only while debugging.
    SEC013 | high | setuid or setgid bit is set | Use capabilities or a sudo rule.
    SEC014 | medium | a secret is typed in clear | Read it with hidden input.
    SEC015 | low | sudo runs a bare name while PATH is not set | Set PATH first or use a full path.
    SEC016 | high | PATH holds the current folder | Use absolute folders only.
    SEC017 | medium | PATH is not set | Set PATH at the top. | root systemd
    SEC018 | high | direct write to a sensitive system file | Use the proper tool or a drop-in file.
    SEC019 | medium | a download is unpacked unchecked | Save it, check it, then unpack it.
    SEC020 | medium | risky ssh option | Use a jump host instead.
    SEC021 | low | a secret is exported to every child process | Pass it to the one command that needs it.
    SEC022 | medium | random-looking token | If it is a secret, revoke it and store it elsewhere.
    SEC023 | critical | untrusted text is placed in a run block | Hand it over through an environment variable.
    SEC024 | medium | package installed without a version | Pin the version or use a lock file.
    SEC025 | high | package source without signature check | Import the key of the source.
    SEC026 | low | repository cloned without a fixed revision | Check out a tag or a commit.
    DKR001 | medium | base image without version | Pin a version or a digest.
    DKR002 | high | the image runs as root | End with an ordinary user.
    DKR003 | medium | remote file added without checksum | Add a checksum.
    DKR005 | critical | a secret is stored in the image | Use a build secret.
    CI001 | medium | action not pinned to a commit | Pin the full commit hash.
    CI002 | low | workflow token permissions are not limited | Declare the least permissions.
    CI003 | critical | privileged trigger checks out foreign code | Do not check out the pull request head there.
    CI004 | critical | a secret is written in the pipeline file | Use the secret store of the platform.
    CI005 | medium | container image unpinned | Pin a version or a digest.
    PYSEC001 | medium | random-looking token | If it is a secret, revoke it and store it elsewhere.
    """)
    + _family("robustness", """
    ROB001 | medium | errors do not stop the script | Add set -e.
    ROB002 | low | a failure inside a pipe is lost | Add set -o pipefail.
    ROB003 | low | unset variables are accepted | Add set -u.
    ROB004 | low | temporary file is never removed | Remove it in a trap.
    ROB005 | medium | cd may fail unnoticed | Leave when cd fails.
    ROB006 | medium | unquoted variable in a test | Quote the variable.
    ROB007 | low | read mangles backslashes | Add -r.
    ROB008 | medium | loop over the output of ls | Loop over a glob.
    ROB009 | high | Windows line ends | Convert to plain newlines.
    ROB010 | medium | unquoted argument list | Write it in double quotes.
    ROB011 | low | result of a critical command is ignored | Test it or add set -e.
    ROB012 | low | field separator is changed and never restored | Restore it, or change it for one command.
    ROB013 | low | cleanup trap misses EXIT | Add EXIT to the trap.
    ROB014 | medium | scheduled job without a lock | Take a lock first. | cron
    ROB015 | medium | waits for input when nobody is there | Take values from arguments. | cron systemd
    ROB016 | medium | scheduled job without PATH | Set PATH at the top. | cron
    ROB017 | medium | command is missing on the target | Install it or test for it.
    PYROB001 | low | subprocess without timeout | Pass a timeout.
    PYROB002 | medium | waits for input when nobody is there | Take values from arguments. | cron systemd
    PYROB003 | medium | scheduled job without a lock | Take a lock first. | cron
    PYROB004 | medium | result of the main function is dropped | Hand it to sys.exit.
    PYROB005 | high | import resolves nowhere | Install or declare the package.
    """)
    + _family("maintainability", """
    MNT001 | low | line too long | Break the line.
    MNT002 | low | function too long | Split the function.
    MNT003 | medium | control structures nested too deep | Return early or move blocks into functions.
    MNT004 | low | no comment at the top | Say what the script does.
    MNT005 | low | hardly any comments | Comment the difficult parts.
    MNT006 | low | unfinished work marker | Finish it or file an issue.
    MNT007 | low | backtick substitution | Use $( ).
    MNT008 | medium | long script without a function | Group the steps in functions.
    MNT009 | low | tabs and spaces are mixed | Use one of them.
    MNT010 | low | blanks at the end of the line | Remove them.
    MNT011 | low | suppression without effect | Remove the directive.
    DKR004 | low | ADD of a local file | Use COPY.
    PYMNT001 | low | module without docstring | Add a docstring.
    PYMNT002 | low | no main guard | Put the calls under a main guard.
    """)
    + _family("portability", """
    POR001 | medium | no interpreter line | Add one.
    POR002 | low | interpreter in an unusual place | Use env.
    POR003 | medium | bash construct in a POSIX script | Use the POSIX form or declare bash.
    POR004 | low | which is not portable | Use command -v.
    POR005 | low | obsolete grep variant | Use grep -E or grep -F.
    POR006 | low | tied to one package manager | Test which one exists.
    POR007 | low | obsolete network tool | Use ip or ss.
    PYPOR001 | high | ambiguous Python interpreter | Name python3.
    PYPOR002 | medium | import is not declared by the project | Declare the dependency.
    """)
    + _family("performance", """
    PERF001 | low | cat feeds a pipe | Give the file to the command.
    PERF002 | low | lines counted through a pipe | Use grep -c.
    PERF003 | low | expr starts a process | Use shell arithmetic.
    PERF004 | low | a process per loop turn | Use parameter expansion.
    PERF005 | low | chain of filters | Do it in one command.
    PERF006 | low | process list filtered by grep | Use pgrep.
    PERF007 | low | loop over seq | Use a counting loop.
    PERF008 | low | echo inside a substitution | Use the variable itself.
    PERF009 | low | cat inside a substitution | Use a redirection.
    DKR007 | low | package cache stays in the layer | Clean it in the same step.
    DKR006 | low | recommended packages are installed | Add --no-install-recommends.
    """)
)
# DKR006 is a security rule; it stands last only because its title fits there.
RULES = tuple(r._replace(category="security") if r.rule == "DKR006" else r for r in RULES)
BUILTIN_IDS = tuple(sorted(r.rule for r in RULES))


def builtin_rules(spark: SparkSession) -> DataFrame:
    rows = [("builtin", r.rule, r.category, r.severity, r.language, r.title, r.hint, list(r.contexts)) for r in RULES]
    return spark.createDataFrame(
        rows, "tool string, rule string, category string, severity string, language string, title string, hint string, contexts array<string>"
    )


def rule_catalog(*parts: DataFrame) -> DataFrame:
    """One catalogue out of several, sorted by tool and rule."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy("tool", "rule")


def find_rule(catalog: DataFrame, rule: str) -> DataFrame:
    return catalog.filter(F.upper("rule") == rule.strip().upper())


def similar_rules(catalog: DataFrame, text: str, limit: int = 8) -> DataFrame:
    """Rules whose id starts with, else holds, the text; at most ``limit`` (a lookup feature)."""
    t = text.strip().upper()
    ids = catalog.select("rule").distinct()
    up = F.upper("rule")
    rank = F.when(F.startswith(up, F.lit(t)), 0).when(F.contains(up, F.lit(t)), 1)
    return ids.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "rule").limit(limit).select("rule")


def search_rules(catalog: DataFrame, language: str | None = None, tool: str | None = None, category: str | None = None, text: str = "") -> DataFrame:
    out = catalog
    for name, value in (("language", language), ("tool", tool), ("category", category)):
        if value:
            out = out.filter(F.col(name) == value)
    if text:
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", "rule", "title", "hint")), F.lit(text.lower())))
    return out


def seen_rules(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules met in scans that the catalogue does not know."""
    return findings.select("tool", "rule").distinct().join(catalog.select("tool", "rule"), ["tool", "rule"], "left_anti")
