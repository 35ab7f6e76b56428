"""The line rules as Columns over the commands of a line.

A line has ``raw``, ``code`` (without comments), ``bare`` (without strings) and ``commands``, an array of
:data:`fleetgrade.operators.shell_words.COMMAND`. A rule names texts of which one must stand in the line, and a test that is
tried only then; lines that hold none of them are never read into commands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetgrade.operators.shell_words import SHELLS

DOWNLOADS = ("curl", "wget", "fetch")
UNPACKERS = ("tar", "unzip", "bsdtar", "cpio")
OLD_NET_TOOLS = ("arp", "ifconfig", "iwconfig", "netstat", "route")
CHANGES_FILES = ("chmod", "chown", "cp", "install", "ln", "mkdir", "mv", "rm", "rsync", "tar")
SYSTEM_FOLDERS = ("bin", "boot", "etc", "home", "lib", "lib64", "opt", "root", "sbin", "srv", "usr", "var")
ACCOUNT_FILES = ("/etc/passwd", "/etc/shadow", "/etc/crontab")
SECRET_WORDS = ("password", "passwd", "pass", "secret", "token", "apikey", "accesskey", "privatekey", "credential")
SECRET_NAMES = ("PASSWORD", "PASSWD", "SECRET", "TOKEN", "APIKEY", "API_KEY", "ACCESSKEY", "ACCESS_KEY", "CREDENTIAL")
UNSIGNED_OPTIONS = ("--allow-unauthenticated", "--allow-insecure-repositories", "--no-gpg-check", "--no-gpg-checks", "--nogpgcheck")
SETTERS = ("export", "local", "readonly", "declare", "typeset")
BEYOND_POSIX = ("[[", "function", "source", "let", "declare", "typeset", "select")
# How published keys and tokens begin, the characters that follow, and how many.
KEY_FORMATS = (
    (("AKIA",), "A-Z0-9", r"{16}\b"),
    (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "A-Za-z0-9", r"{36}\b"),
    (("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), "A-Za-z0-9-", "{10}"),
)
_ASSIGN = r"\A([A-Za-z_]\w*)(\[[^\]]*\])?\+?="
_VARIABLE = r"\$(\w+|\{\w+\})"
_MARKS = r"[\"']"

Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """``needles``: texts of which the line holds one if the test can hold. Tests of a ``command`` get one, others none."""

    needles: tuple[str, ...]
    command: Test | None = None
    line: Callable[[], Column] | None = None
    # What a command hands on to another shell is asked for what it endangers, not for how it is written.
    inner: bool = False
    # Needles are looked for in lower case.
    fold: bool = False


def plain(word: Column) -> Column:
    """A word without its outer quotes."""
    first = F.substring(word, 1, 1)
    quoted = (F.length(word) > 1) & first.isin("'", '"') & F.endswith(word, first)
    return F.when(quoted, F.substr(word, F.lit(2), F.length(word) - 2)).otherwise(word)


def either(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def has(words: Column, test: Test) -> Column:
    return F.exists(words, test)


def like(pattern: str) -> Test:
    return lambda w: w.rlike(pattern)


def option(words: Column, *letters: str) -> Column:
    """Whether one of the letters is a short option."""
    return has(words, like(rf"\A-(?=[A-Za-z]).*[{''.join(letters)}]"))


def operands(words: Column) -> Column:
    return F.filter(words, lambda w: ~F.startswith(w, F.lit("-")))


def nth(words: Column, at: int) -> Column:
    """The word at a place from 0, or an empty one."""
    return F.coalesce(F.get(words, F.lit(at)), F.lit(""))


def spaced(words: Column) -> Column:
    """The words in one text, each between spaces."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _equals_as_space(text: Column) -> Column:
    return F.replace(text, F.lit("="), F.lit(" "))


# ---------------------------------------------------------------- what a command does


def runs_download(c: Column) -> Column:
    loaded = has(c["args"], lambda a: plain(a).rlike(r"\A[<$]\(\s*(curl|wget)( |\z)"))
    shell = F.substring_index(c["name"], "/", -1).isin(*SHELLS) | c["name"].isin("source", ".")
    return (c["base"].isin(*DOWNLOADS) & has(c["down"], lambda n: n.isin(*SHELLS))) | (shell & loaded)


def sets(c: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Whether a variable and its value, which the command sets, pass the test."""
    words = F.concat(c["assigns"], F.when(c["name"].isin(*SETTERS), c["args"]).otherwise(F.slice(c["args"], 1, 0)))
    return has(words, lambda w: w.rlike(_ASSIGN) & test(F.regexp_extract(w, _ASSIGN, 1), F.regexp_replace(w, _ASSIGN, "")))


def literal_secret(c: Column) -> Column:
    name = rf"({'|'.join(SECRET_WORDS)})s?\z"
    return sets(c, lambda n, v: F.lower(F.replace(n, F.lit("_"), F.lit(""))).rlike(name) & plain(v).rlike(r"\A[^$`( \"'\s][^\s\"']{3,}\z"))


def key_format() -> Column:
    shapes = [rf"\b({'|'.join(begins)})[{letters}]{size}" for begins, letters, size in KEY_FORMATS]
    return F.col("raw").rlike("|".join([*shapes, r"-----BEGIN ([A-Z]+ )?PRIVATE KEY-----"]))


def evaluates(c: Column) -> Column:
    return (c["name"] == "eval") & has(c["args"], like(r"[$`]"))


def mode_like(c: Column, *patterns: str) -> Column:
    """Whether chmod gets a mode of which one part is like one of the patterns."""
    mode = F.split(nth(operands(c["bare"]), 0), ",")
    return (c["base"] == "chmod") & has(mode, like("|".join(rf"\A{p}\z" for p in patterns)))


def unchecked_peer(c: Column) -> Column:
    words = F.transform(F.concat(c["assigns"], c["words"]), lambda w: F.lower(plain(w)))
    said = _equals_as_space(F.array_join(words, " "))
    return either(
        (c["base"] == "curl") & (option(c["bare"], "k") | F.array_contains(words, "--insecure")),
        has(words, like(r"\A(--no-check-certificate\z|--trusted-host|git_ssl_no_verify=)")),
        said.rlike(r"stricthostkeychecking no|userknownhostsfile /dev/null|sslverify\s+false"))


def plain_http(c: Column) -> Column:
    asks = c["base"].isin("curl", "wget") | ((c["base"] == "git") & (nth(c["bare"], 0) == "clone"))
    return asks & has(c["bare"], lambda a: plain(a).rlike(r"\Ahttp://(?!localhost\b|127\.|\[::1\])"))


def removes(c: Column, test: Test) -> Column:
    return (c["base"] == "rm") & option(c["bare"], "r", "R") & has(operands(c["bare"]), test)


def removes_variable(c: Column) -> Column:
    """A path in which a variable that may be empty stands before a slash, or is all there is and not quoted."""
    def risky(w: Column) -> Column:
        return ~F.startswith(w, F.lit("'")) & (F.regexp_replace(w, _MARKS, "").rlike(_VARIABLE + "/") | w.rlike(rf"\A{_VARIABLE}\z"))

    return removes(c, risky) & ~removes(c, lambda w: F.contains(w, F.lit(":?")))


def removes_system(c: Column) -> Column:
    return removes(c, lambda w: F.regexp_replace(w, _MARKS, "").rlike(rf"\A/(\*|({'|'.join(SYSTEM_FOLDERS)})/?\*?)?\z"))


def writes(c: Column, pattern: str, *tools: str) -> Column:
    """Whether a file that the command writes, by redirection or as one of the tools, is like the pattern."""
    sent = F.exists(c["redirects"], lambda r: r["op"].rlike(r"\A&?>") & plain(r["to"]).rlike(pattern))
    return sent | (c["base"].isin(*tools) & has(operands(c["bare"]), lambda a: plain(a).rlike(pattern)))


def shown_password(c: Column) -> Column:
    fed = (c["name"] == "sudo") & option(c["args"], "S") & (c["before"] == "|") & (c["prev"] == "echo")
    given = F.startswith(c["base"], F.lit("mysql")) & has(c["bare"], like(r"\A-p[^-]"))
    said = F.array_contains(F.slice(c["bare"], F.lit(1), F.greatest(F.size(c["bare"]) - 1, F.lit(0))), "--password")
    return either(fed, given, said, has(c["bare"], like(r"\A--password=.")), (c["base"] == "sshpass") & has(c["bare"], like(r"\A-p")))


def sources_foreign(c: Column) -> Column:
    return c["name"].isin("source", ".") & plain(nth(c["args"], 0)).rlike(r"\A(/tmp/|/var/tmp/|https?://)")


def traces(c: Column) -> Column:
    return (c["name"] == "set") & (has(c["args"], like(r"\A-[A-Za-z]*x[A-Za-z]*\z")) | F.contains(spaced(c["args"]), F.lit(" -o xtrace ")))


def reads_openly(c: Column) -> Column:
    secret = has(operands(c["args"]), like(r"(?i)(?<!\w)(pass|passwd|password|secret|token|pin)(?!\w)"))
    return (c["name"] == "read") & secret & ~option(c["args"], "s")


def sudo_by_name(c: Column) -> Column:
    return (c["name"] == "sudo") & nth(operands(c["args"]), 0).rlike(r"\A\p{L}")


def open_path(c: Column) -> Column:
    return sets(c, lambda n, v: (n == "PATH") & (v != "") & plain(v).rlike(r"(\A|:)\.?(:|\z)"))


def forwards_agent(c: Column) -> Column:
    said = _equals_as_space(F.array_join(c["args"], " "))
    return c["base"].isin("ssh", "scp", "sftp") & (has(c["args"], like(r"\A-[A-Za-z]*A[A-Za-z]*\z")) | said.rlike("ForwardAgent yes|PermitLocalCommand yes"))


def exports_secret(c: Column) -> Column:
    return (c["name"] == "export") & has(c["args"], like(rf"\A[A-Z0-9_]*({'|'.join(SECRET_NAMES)})[A-Z0-9_]*(\W|\z)"))


def unsigned_packages() -> Column:
    words = F.transform(F.split("raw", r"[\s;|&]+"), lambda w: F.regexp_replace(w, r"\A[\"']+|[\"']+\z", ""))
    return either(
        F.arrays_overlap(words, F.array(*[F.lit(o) for o in UNSIGNED_OPTIONS])), F.col("raw").rlike(r"gpgcheck\s*=\s*0|\[[^\]]*trusted=yes[^\]]*\]"),
        F.array_contains(words, "rpm") & has(words, lambda w: w.isin("--nosignature", "--nodigest")),
        F.array_contains(words, "apk") & F.array_contains(words, "--allow-untrusted"))


def floating_clone(c: Column) -> Column:
    said = _equals_as_space(spaced(F.transform(c["args"], plain)))
    return (nth(c["words"], 0) == "git") & (nth(c["words"], 1) == "clone") & ~said.rlike(r" (-b|--branch) (v?\d|\$)")


# ---------------------------------------------------------------- how a command is written


def unguarded_cd(c: Column) -> Column:
    return (c["name"] == "cd") & (c["after"] == "") & (c["before"] != "$(")


def unquoted_test(c: Column) -> Column:
    binary = nth(c["args"], 1).isin("=", "==", "!=", "-eq", "-ne", "-lt", "-gt", "-le", "-ge")
    return (c["name"] == "[") & (F.size(c["args"]) > 2) & nth(c["args"], 0).rlike(rf"\A{_VARIABLE}\z") & binary


def raw_read(c: Column) -> Column:
    return (c["name"] == "read") & ~option(c["args"], "r")


def loops_over(name: str) -> Test:
    return lambda c: (c["name"] == "for") & (nth(c["args"], 1) == "in") & nth(c["args"], 2).rlike(rf"\A(\$\(|`)\s*{name}\b")


def unchecked_change() -> Column:
    code = F.col("code")
    return code.rlike(rf"\A\s*({'|'.join(CHANGES_FILES)})\s") & ~F.contains(code, F.lit("||")) & ~F.contains(code, F.lit("&&"))


def moves_ifs(c: Column) -> Column:
    return (F.size(c["words"]) == 0) & (F.size(c["assigns"]) == 1) & c["before"].isin("", ";") & nth(c["assigns"], 0).rlike(r"\AIFS=(?!\"?\$)")


def partial_trap(c: Column) -> Column:
    signals = F.transform(F.slice(c["args"], 2, 2**30), lambda s: F.regexp_replace(s, r"\ASIG", ""))
    some = has(signals, lambda s: s.isin("INT", "TERM", "HUP", "QUIT", "ERR"))
    return (c["name"] == "trap") & some & ~has(signals, lambda s: s.isin("EXIT", "0")) & (c["after"] == "")


def asks_terminal(c: Column) -> Column:
    return (c["name"] == "read") & ~c["before"].isin("|", "|&") & ~F.array_contains(c["keywords"], "while") & ~F.contains("code", F.lit("<"))


def bash_command(c: Column) -> Column:
    return either(
        c["name"].isin(*BEYOND_POSIX), nth(c["words"], 0).isin(*BEYOND_POSIX), F.exists(c["redirects"], lambda r: r["op"].isin("<<<", "&>", "&>>")),
        (c["name"] == "[") & F.array_contains(c["args"], "=="), (c["name"] == "echo") & nth(c["args"], 0).rlike(r"\A-[neE]+\z"),
        has(c["assigns"], like(r"\A\w+=\(")))


def bash_text() -> Column:
    code = F.col("code")
    return either(
        F.contains(code, F.lit("$'")), F.contains(code, F.lit("((")), F.contains(F.regexp_replace(code, "'[^']*'", ""), F.lit("[[")),
        code.rlike(r"\$\{\w+:-?\d|\$\{\w+//?[^}]|\$(RANDOM|BASH_\w+|PIPESTATUS)\b"))


def named(*names: str) -> Test:
    return lambda c: c["name"].isin(*names)


def piped(first: str, *second: str) -> Test:
    return lambda c: (c["name"] == first) & (c["after"] == "|") & c["next"].isin(*second)


def needless_cat(c: Column) -> Column:
    return (c["name"] == "cat") & (c["after"] == "|") & (F.size(c["args"]) == 1) & ~F.startswith(nth(c["args"], 0), F.lit("-")) & (F.size(c["redirects"]) == 0)


def alone_in_substitution(c: Column, name: str) -> Column:
    return (c["before"] == "$(") & (c["after"] == "") & (c["name"] == name)


def echo_of_variable(c: Column) -> Column:
    return alone_in_substitution(c, "echo") & (F.size(c["args"]) == 1) & nth(c["args"], 0).rlike(rf"\A[\"']?{_VARIABLE}[\"']?\z")


def cat_of_file(c: Column) -> Column:
    return alone_in_substitution(c, "cat") & (F.size(c["args"]) > 0) & (F.size(c["redirects"]) == 0)


def costly_substitution(c: Column) -> Column:
    """A process for what an expansion does."""
    return (c["before"] == "$(") & (c["name"].isin("basename", "dirname", "expr") | piped("echo", "cut", "tr", "sed", "awk")(c))


def _danger(needles: str, test: Test) -> Rule:
    return Rule(tuple(needles.split()), command=test, inner=True)


def _style(needles: str, test: Test) -> Rule:
    return Rule(tuple(needles.split()), command=test)


def _text(needles: str, test: Callable[[], Column]) -> Rule:
    return Rule(tuple(needles.split()), line=test)


CHECKS: dict[str, Rule] = {
    "SEC001": _danger("curl wget fetch", runs_download),
    "SEC002": _danger("=", literal_secret),
    "SEC002 shape": Rule((*[b for begins, _, _ in KEY_FORMATS for b in begins], "-----BEGIN"), line=key_format),
    "SEC003": _danger("eval", evaluates),
    "SEC004": _danger("chmod", lambda c: mode_like(c, "[0-7]{2,3}[2367]", "[ugoa]*[oa][ugoa]*[+=][rwxXst]*w[rwxXst]*")),
    "SEC005": Rule(("curl", "--no-check", "--trusted", "hostkeychecking", "hostsfile", "sslverify", "ssl_no_verify"), command=unchecked_peer, inner=True, fold=True),
    "SEC006": _danger("http://", plain_http),
    "SEC007": _danger("rm", removes_variable),
    "SEC008": _danger("rm", removes_system),
    "SEC009": _danger("tmp/", lambda c: writes(c, r"\A/(var/)?tmp/.", "tee", "touch")),
    "SEC010": _danger("sudo mysql --password sshpass", shown_password),
    "SEC011": _danger("/tmp/ :// ", sources_foreign),
    "SEC012": _danger("set", traces),
    "SEC013": _danger("chmod", lambda c: mode_like(c, "0*[2-7][0-7]{3}", r"[ugoa]*\+[rwxXst]*s[rwxXst]*")),
    "SEC014": _danger("read", reads_openly),
    "SEC015": _danger("sudo", sudo_by_name),
    "SEC016": _danger("PATH", open_path),
    "SEC018": _danger("/etc/ authorized_keys", lambda c: writes(c, rf"/etc/sudoers|authorized_keys|/etc/cron\.d/|({'|'.join(ACCOUNT_FILES)})\z", "tee")),
    "SEC019": _danger("curl wget", lambda c: c["base"].isin("curl", "wget") & has(c["down"], lambda n: n.isin(*UNPACKERS))),
    "SEC020": _danger("ssh scp sftp", forwards_agent),
    "SEC021": _danger("export", exports_secret),
    "SEC025": _text("--allow --no-gpg --nogpg gpgcheck trusted=yes --nosig --nodig", unsigned_packages),
    "SEC026": _danger("git", floating_clone),
    "ROB005": _style("cd", unguarded_cd),
    "ROB006": _style("[", unquoted_test),
    "ROB007": _style("read", raw_read),
    "ROB008": _style("ls", loops_over("ls")),
    "ROB010": _text("$@ $*", lambda: F.col("bare").rlike(r'(?<![\w$\\"])\$[@*](?![\w"])')),
    "ROB011": _text(" ".join(CHANGES_FILES), unchecked_change),
    "ROB012": _style("IFS=", moves_ifs),
    "ROB013": _style("trap", partial_trap),
    "ROB015": _style("read", asks_terminal),
    "MNT006": _text("TODO FIXME XXX HACK", lambda: F.substr("raw", F.instr("raw", "#") + 1).rlike(r"\b(TODO|FIXME|XXX|HACK)\b") & F.contains("raw", F.lit("#")) & ~F.startswith("raw", F.lit("#!"))),
    "MNT007": _text("`", lambda: (F.length("code") - F.length(F.replace("code", F.lit("`"), F.lit(""))) > 1) & ~F.contains("code", F.lit("``"))),
    "POR003": Rule((*BEYOND_POSIX, "<<<", "&>", "==", "echo", "=("), command=bash_command),
    "POR003 text": _text("$ (( [[", bash_text),
    "POR004": _style("which", named("which")),
    "POR005": _style("egrep fgrep", named("egrep", "fgrep")),
    "POR007": _style(" ".join(OLD_NET_TOOLS), named(*OLD_NET_TOOLS)),
    "PERF001": _style("cat", needless_cat),
    "PERF002": _style("grep", lambda c: piped("grep", "wc")(c) & F.array_contains(c["next_args"], "-l")),
    "PERF003": _style("expr", named("expr")),
    "PERF004": _style("$( `", costly_substitution),
    "PERF005": _style("grep sed", lambda c: piped("grep", "grep", "awk")(c) | piped("sed", "sed")(c)),
    "PERF006": _style("ps", piped("ps", "grep")),
    "PERF007": _style("seq", loops_over("seq")),
    "PERF008": _style("$( `", echo_of_variable),
    "PERF009": _style("$( `", cat_of_file),
}


def holds(text: Column, needles: tuple[str, ...]) -> Column:
    return either(*[F.contains(text, F.lit(n)) for n in needles])


def asked_code(checks: Iterable[str] = CHECKS) -> Column | None:
    """The code of lines that some of the checks on commands may concern, null for the others; none if no check reads commands."""
    def shortest(fold: bool) -> tuple[str, ...]:
        needles = {n for r in map(CHECKS.get, checks) if r.command and r.fold == fold for n in r.needles}
        return tuple(sorted(n for n in needles if not any(o != n and o in n for o in needles)))

    code = F.col("code")
    plain, folded = shortest(False), shortest(True)
    asked = [holds(text, needles) for text, needles in ((code, plain), (F.lower(code), folded)) if needles]
    return F.when(either(*asked), code) if asked else None


def failed(check: str) -> Column:
    """Whether a line fails a check: by its text, or by one of its ``commands``."""
    r = CHECKS[check]
    if r.line:
        return holds(F.col("raw"), r.needles) & r.line()
    found = F.exists("commands", r.command if r.inner else lambda c: ~c["inner"] & r.command(c))
    return holds(F.lower("code") if r.fold else F.col("code"), r.needles) & F.coalesce(found, F.lit(False))
