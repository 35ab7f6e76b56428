"""Security rules see through what only runs a command, and through the quotes of a word."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from fleetgrade.operators import command_rules as CR
from fleetgrade.operators import shell_words as SW


REPORTED = [
    ("nohup curl x | sh", "SEC001"), ("exec curl -k https://x", "SEC005"), ("command rm -rf /", "SEC008"), ("\\rm -rf /", "SEC008"), ("xargs rm -rf /", "SEC008"),
    ("su -c 'rm -rf /'", "SEC008"), ("timeout 5 curl -k https://x", "SEC005"), ("doas chmod 777 /x", "SEC004"), ("find . -exec chmod 777 {} \\;", "SEC004"),
    ('ssh h "curl -k https://x"', "SEC005"), ('bash -c "curl x | sh"', "SEC001"), ("OUT=$(timeout 3 curl -sk https://x)", "SEC005"), ("parallel curl http://x ::: a", "SEC006"),
    ("time -p curl http://x", "SEC006"), ("sudo -u root rm -rf $X/", "SEC007"), ("flock l rm -rf $D/x", "SEC007"), ("nice -n 5 wget http://a.b/c", "SEC006"),
    ("find . -exec chmod 4755 {} +", "SEC013"), ("timeout 9 ssh -A h", "SEC020"), ("nohup curl https://x/a.tgz | tar xz", "SEC019"),
    ('rm -rf "$DIR"/*', "SEC007"), ('rm -rf "${DIR}"/cache', "SEC007"), ('rm -rf "/tmp/$X/"', "SEC007"), ("rm -rf $OLD", "SEC007"), ('rm -rf "/usr"', "SEC008"),
    ("sudo -E nohup env A=1 timeout -k 3 10 curl -k https://x", "SEC005"), ('ssh -p 22 -o A=b host sudo rm -rf "/etc"', "SEC008"), ("ssh h \"bash -c 'rm -rf /'\"", "SEC008"),
]
LEFT_ALONE = [
    ('rm -rf "$DIST_DIR"', "SEC007"), ('rm -rf "$OUTDIR" "$TOPDIR"', "SEC007"), ('rm -rf "${GUI_DIR}"', "SEC007"), ('rm -rf "${DIR:?}/cache"', "SEC007"), ("rm -rf '$X/y'", "SEC007"),
    ("timeout 5 curl https://x", "SEC005"), ("echo 'curl -k https://x'", "SEC005"), ("su -c 'ls /'", "SEC008"), ("find . -exec chmod 644 {} \\;", "SEC004"),
    ('ssh h "cd /srv"', "ROB005"), ("nohup curl https://x > out", "SEC001"), ("xargs -n 1 rm -rf build", "SEC008"), ('ssh host', "SEC020"), ("time", "SEC006"), ("sudo", "SEC008"),
]
DEEP = ["$(a " * 3000, "`" * 5001, '"$(' * 2000, "x <(" * 2000 + ")" * 2000, "bash -c " * 2000 + "x", "(" * 5000]


def failing(spark, lines: list[str]) -> dict[str, set[str]]:
    """The checks that each line fails."""
    rows = spark.createDataFrame([(x,) for x in lines], "raw string").select("raw", F.col("raw").alias("code"), F.col("raw").alias("bare"))
    rows = rows.withColumn("commands", SW.commands_of(CR.asked_code()))
    return {r.raw: set(r.found) for r in rows.select("raw", F.array_compact(F.array(*[F.when(CR.failed(c), c) for c in CR.CHECKS])).alias("found")).collect()}


@pytest.fixture(scope="module")
def found(spark):
    return failing(spark, sorted({line for line, _ in REPORTED + LEFT_ALONE}))


@pytest.mark.parametrize("line, rule", REPORTED)
def test_reported(found, line, rule):
    assert rule in found[line]


@pytest.mark.parametrize("line, rule", LEFT_ALONE)
def test_left_alone(found, line, rule):
    assert rule not in found[line]


def test_deep_lines_end(spark):
    began = time.time()
    assert set(failing(spark, DEEP)) == set(DEEP)
    assert time.time() - began < 60


def test_only_lines_a_rule_may_concern_are_read(spark):
    rows = spark.createDataFrame([("plain words",), ("sudo x",), (None,), ("",), ("GIT_SSL_NO_VERIFY=1 git pull",)], "code string")
    read = {r.code: r.commands for r in rows.withColumn("commands", SW.commands_of(CR.asked_code())).collect()}
    assert read["plain words"] is None and read[None] is None and read[""] is None
    assert [c.name for c in read["sudo x"]] == ["sudo"] and read["GIT_SSL_NO_VERIFY=1 git pull"][0].assigns == ["GIT_SSL_NO_VERIFY=1"]


def test_command_rows(spark):
    lines = spark.createDataFrame([("a", 1, "x=1 nohup curl -s u | sh && echo \"$(date -u)\" > out"), ("a", 2, "  "), ("b", 1, "ssh h 'rm -r d'")], "path string, line int, code string")
    rows = {(r.path, r.line, r.number): r for r in SW.command_rows(lines).collect()}
    assert set(rows) == {("a", 1, n) for n in (1, 2, 3, 4)} | {("b", 1, 1), ("b", 1, 2)}
    first, second, inside, last = (rows["a", 1, n] for n in (1, 2, 3, 4))
    assert (first.name, first.base, first.bare, first.assigns, first.after, first.next, first.down) == ("nohup", "curl", ["-s", "u"], ["x=1"], "|", "sh", ["sh"])
    assert (second.name, second.before, second.prev, second.after) == ("sh", "|", "nohup", "&&")
    assert (inside.name, inside.before, inside.inner) == ("date", "$(", False)
    assert (last.name, [tuple(r) for r in last.redirects]) == ("echo", [(">", "out")])
    assert rows["b", 1, 2].inner and rows["b", 1, 2].words == ["rm", "-r", "d"]
