"""Shell lines as commands made of words.

A line is read once, in Arrow batches, into its simple commands, those inside substitutions and those handed to
another shell included. Every question about them is a Column (:mod:`fleetgrade.operators.command_rules`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = ("if", "then", "else", "elif", "do", "while", "until", "!", "time")
SHELLS = ("sh", "bash", "dash", "zsh", "ksh")
_ASSIGN = re.compile(r"([A-Za-z_]\w*)(\[[^\]]*\])?\+?=")
# Commands that run the command behind them, with their options that take a value and the operands before it.
WRAPPERS = {
    "builtin": ("", 0), "chroot": ("", 1), "command": ("", 0), "doas": ("uC", 0), "env": ("uC", 0), "exec": ("a", 0), "flock": ("wE", 1), "ionice": ("cnp", 0), "nice": ("n", 0),
    "nohup": ("", 0), "parallel": ("jP", 0), "setsid": ("", 0), "stdbuf": ("ioe", 0), "sudo": ("ugpCThURDrt", 0), "time": ("fo", 0), "timeout": ("ks", 1), "xargs": ("ILnPsdEa", 0),
}
DEEPEST = 64
# Characters that end or begin nothing, and those of a double-quoted string.
_RUN = re.compile(r"[^\s\"'\\$`<>&|;()]+")
_IN_QUOTES = re.compile(r'[^"\\$`]+')
# The first of the list that stands at a place wins.
_REDIRECT = re.compile("|".join(map(re.escape, ("<<<", "<<-", "&>>", ">>", "<<", ">|", ">&", "<&", "<>", "&>", ">", "<"))))
_OPERATOR = re.compile("|".join(map(re.escape, ("&&", "||", ";;", "|&", ";", "|", "&", "(", ")"))))
_BEFORE_WORDS = frozenset((*KEYWORDS, "{"))


class Command:
    """One simple command: ``words`` after keywords and assignments, and what stands around it."""

    __slots__ = ("keywords", "assigns", "words", "redirects", "before", "after", "prev", "next", "_bare")

    def __init__(self, before: str):
        self.keywords, self.assigns, self.words, self.redirects = [], [], [], []
        self.before, self.after, self.prev, self.next, self._bare = before, "", None, None, None

    def add(self, word: str) -> None:
        if self.words:
            self.words.append(word)
        elif not self.assigns and word in _BEFORE_WORDS:
            self.keywords.append(word)
        elif _ASSIGN.match(word):
            self.assigns.append(word)
        else:
            self.words.append(word)

    @property
    def name(self) -> str:
        return plain(self.words[0]) if self.words else ""

    @property
    def args(self) -> list[str]:
        return self.words[1:]

    def bare(self) -> tuple[str, list[str]]:
        """Base name and arguments behind whatever only runs the command; asked once its words are complete."""
        if self._bare is None:
            self._bare = self._unwrapped()
        return self._bare

    def _unwrapped(self) -> tuple[str, list[str]]:
        at, words = 0, self.words
        valued, skipped = ("fo", 0) if "time" in self.keywords else ("", None)
        while at < len(words):
            if skipped is not None:
                while at < len(words) and (words[at][:1] == "-" or _ASSIGN.match(words[at])):
                    at += 2 if len(words[at]) == 2 and words[at][1] in valued else 1
                at += skipped
            if at >= len(words):
                break
            name = base_name(words[at])
            if name not in WRAPPERS:
                return name, words[at + 1:]
            valued, skipped = WRAPPERS[name]
            at += 1
        return "", []

    def following(self) -> Iterator[Command]:
        """Commands further down the pipeline."""
        at = self
        while at.after in ("|", "|&") and at.next:
            at = at.next
            yield at


def plain(word: str) -> str:
    """A word without its outer quotes."""
    return word[1:-1] if len(word) > 1 and word[0] == word[-1] and word[0] in "\"'" else word


def base_name(word: str) -> str:
    """Name of a program without its folder, and without the backslash that passes over an alias."""
    return plain(word).removeprefix("\\").rsplit("/", 1)[-1]


def commands(code: str) -> list[Command]:
    """The commands of a line in the order in which they end."""
    found: list[Command] = []
    _level(code, 0, "", found, "")
    return found


def _handed_on(c: Command) -> Iterator[list[Command]]:
    """Commands in the arguments of a command: strings for a shell, for another user or host, and what find runs."""
    name, args = c.bare()
    if name in (*SHELLS, "su"):
        for flag, text in zip(args, args[1:]):
            if re.fullmatch(r"-[A-Za-z]*c", flag):
                yield commands(plain(text))
    elif name == "ssh":
        rest = iter(args)
        for word in rest:
            if not word.startswith("-"):
                yield commands(" ".join(map(plain, rest)))
            elif len(word) == 2 and word[1] in "BbcDEeFIiJLlmOopQRSWw":
                next(rest, None)
    elif name == "find":
        starts = [i + 1 for i, a in enumerate(args) if a in ("-exec", "-execdir", "-ok", "-okdir")]
        for start in starts:
            one = Command("")
            one.words = args[start:next((i for i in range(start, len(args)) if args[i] in (";", "\\;", "+", "';'")), len(args))]
            yield [one]


def with_inner(cmds: list[Command]) -> list[Command]:
    """The commands and those they hand on; each of these is shorter than what it stands in."""
    every = list(cmds)
    for c in every:
        for inner in _handed_on(c):
            every += inner
    return every


def _quoted(s: str, i: int, found: list[Command], depth: int) -> int:
    """End of a double-quoted string; substitutions in it are read."""
    i += 1
    while i < len(s) and s[i] != '"':
        run = _IN_QUOTES.match(s, i)
        if run:
            i = run.end()
        elif s[i] == "\\":
            i += 2
        elif depth >= DEEPEST:
            i += 1
        elif s.startswith("$(", i) and not s.startswith("$((", i):
            i = _level(s, i + 2, ")", found, "$(", depth + 1)
        elif s[i] == "`":
            i = _level(s, i + 1, "`", found, "$(", depth + 1)
        else:
            i += 1
    return min(i + 1, len(s))


def _word_part(s: str, i: int, found: list[Command], depth: int) -> int:
    """End of the part of a word that starts here, or ``i`` if none does. Beyond ``DEEPEST`` levels substitutions are not told apart."""
    if s[i] == "\\":
        return min(i + 2, len(s))
    if s[i] in "'":
        end = s.find("'", i + 1)
        return end + 1 if end >= 0 else len(s)
    if s[i] == '"':
        return _quoted(s, i, found, depth)
    if s.startswith("$((", i):
        end = s.find("))", i)
        return end + 2 if end >= 0 else len(s)
    if depth < DEEPEST and s.startswith(("$(", "<(", ">("), i):
        return _level(s, i + 2, ")", found, s[i : i + 2], depth + 1)
    if depth < DEEPEST and s[i] == "`":
        return _level(s, i + 1, "`", found, "$(", depth + 1)
    if s.startswith("${", i):
        end = s.find("}", i)
        return end + 1 if end >= 0 else len(s)
    return i


def _level(s: str, i: int, stop: str, found: list[Command], opener: str, depth: int = 0) -> int:
    """Read the commands of one nesting level; returns the place behind it."""
    command, word, redirect, here = Command(opener), "", "", []

    def end_word() -> None:
        nonlocal word, redirect
        if word:
            if redirect:
                command.redirects.append((redirect, word))
                redirect = ""
            else:
                command.add(word)
            word = ""

    def end_command(operator: str) -> None:
        nonlocal command
        end_word()
        command.after = operator
        if command.words or command.assigns or command.redirects or command.keywords:
            if here:
                here[-1].next, command.prev = command, here[-1]
            here.append(command)
            found.append(command)
        command = Command(operator)

    size = len(s)
    while i < size:
        run = _RUN.match(s, i)
        if run:
            word, i = word + run.group(), run.end()
            if i >= size:
                break
        # What may begin at a place is told by its character.
        char = s[i]
        if char in " \t":
            if word:
                end_word()
            i += 1
            continue
        if char == stop:
            end_command("")
            return i + 1
        if char == "(" and word and _ASSIGN.fullmatch(word):
            end = s.find(")", i)
            end = end + 1 if end >= 0 else size
            word, i = word + s[i:end], end
            continue
        if char in "<>&":
            operator = _REDIRECT.match(s, i)
            if operator and not s.startswith(("<(", ">("), i):
                if word.isdigit():
                    word = ""
                end_word()
                redirect, i = operator.group(), operator.end()
                continue
        if char not in "&|;()":
            part = _word_part(s, i, found, depth)
            if part > i:
                word, i = word + s[i:part], part
                continue
        operator = _OPERATOR.match(s, i)
        if operator:
            end_command(operator.group())
            i = operator.end()
        else:
            word, i = word + char, i + 1
    end_command("")
    return i


# ---------------------------------------------------------------- commands as data


COMMAND_FIELDS = (
    ("name", "string"), ("base", "string"), ("words", "array<string>"), ("args", "array<string>"), ("bare", "array<string>"), ("assigns", "array<string>"),
    ("keywords", "array<string>"), ("redirects", "array<struct<op:string,to:string>>"), ("before", "string"), ("after", "string"), ("prev", "string"),
    ("next", "string"), ("next_args", "array<string>"), ("down", "array<string>"), ("inner", "boolean"),
)
COMMAND = "struct<" + ",".join(f"{name}:{kind}" for name, kind in COMMAND_FIELDS) + ">"
_TEXTS = pa.list_(pa.string())
_ARROW = {"string": pa.string(), "array<string>": _TEXTS, "boolean": pa.bool_(), "array<struct<op:string,to:string>>": pa.list_(pa.struct([("op", pa.string()), ("to", pa.string())]))}
_STRUCT = pa.struct([(name, _ARROW[kind]) for name, kind in COMMAND_FIELDS])


def _fields(c: Command, inner: bool) -> tuple:
    base, bare = c.bare()
    beside = c.next if c.after in ("|", "|&") else None
    return (
        c.name, base, c.words, c.args, bare, c.assigns, c.keywords, [{"op": o, "to": t} for o, t in c.redirects], c.before, c.after, c.prev.name if c.prev else "",
        beside.name if beside else "", beside.args if beside else [], [n.bare()[0] for n in c.following()] if beside else [], inner)


def commands_of(code: Column) -> Column:
    """The commands of a line as an array of :data:`COMMAND`; null for a null line.

    ``name`` is the first word, ``base`` the program behind what only runs it, with its arguments ``bare``. ``before`` and
    ``after`` are the operators around it (``$(`` opens a substitution), ``prev`` and ``next`` its neighbours, ``down`` the programs
    further down the pipeline. ``inner`` commands are handed to another shell, user, host or to find.
    """

    def run(code: pa.Array) -> pa.Array:
        ends, rows, known = [0], [], []
        for line in code.to_pylist():
            known.append(line is not None)
            if line and not line.isspace():
                own = commands(line)
                rows += [_fields(c, i >= len(own)) for i, c in enumerate(with_inner(own))]
            ends.append(len(rows))
        columns = zip(*rows) if rows else [[] for _ in COMMAND_FIELDS]
        flat = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _STRUCT)], fields=list(_STRUCT))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([not k for k in known], pa.bool_()))

    return F.arrow_udf(run, f"array<{COMMAND}>")(code)


def command_rows(lines: DataFrame) -> DataFrame:
    """One row per command of ``lines(path, line, code)``: path, line, number in the line from 1, and the fields of :data:`COMMAND`."""
    found = lines.filter(F.trim("code") != "").select("path", "line", F.posexplode(commands_of(F.col("code"))).alias("number", "c"))
    return found.select("path", "line", (F.col("number") + 1).alias("number"), "c.*")
