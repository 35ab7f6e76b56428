"""Dedup against a plain greedy pass: long spans, long chains, files folded by connected parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetgrade.operators import findings as FD
from fleetgrade.operators.graph import connected

SCHEMA = "path string, tool string, rule string, line int, end_line int, equivalents array<string>, position bigint, tool_rank int"


def matches(pattern, rule):
    return rule.startswith(pattern[:-1]) if pattern.endswith("*") else pattern == rule


def greedy(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], r[7], r[6])):
        path, tool, rule, line, end, eqs, _, _ = r
        last = end if end is not None and end >= line else line

        def rival(o):
            end = o[4] if o[4] is not None and o[4] >= o[3] else o[3]
            alike = any(matches(p, o[2]) for p in eqs) or any(matches(p, rule) for p in o[5])
            if o[1] == tool:
                return o[3] == line and (o[2] == rule or alike)
            wide = 0 in (o[3], line) or "SYNTAX" in (o[2], rule)
            return alike and (wide or o[3] <= last and line <= end)

        if not any(o[0] == path and rival(o) for o in kept):
            kept.append(r)
    return sorted(k[6] for k in kept)


def kept(spark, rows):
    return sorted(r.position for r in FD.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())


@pytest.mark.parametrize("together", [1 << 16, 3])
def test_random_findings_equal_the_greedy_pass(spark, monkeypatch, together):
    monkeypatch.setattr(FD, "FOLD_TOGETHER", together)
    rng = random.Random(together)
    rules = {"A1": ["B1"], "A2": ["B*"], "B1": [], "B2": ["A1", "SYNTAX"], "SYNTAX": ["A2"], "C9": ["C*", "A2"]}
    rows = []
    for i in range(400):
        rule, line = rng.choice(list(rules)), rng.choice([0, *range(1, 40)])
        end = rng.choice([None, line, line + rng.randrange(60), line - 3, line + rng.choice([500, 40_000, 10_000_000])])
        tool = rng.randrange(4)
        rows.append((f"p{rng.randrange(5)}", f"t{tool}", rule, line, end, rules[rule], i, tool))
    assert kept(spark, rows) == greedy(rows)


def test_chain_of_five_thousand(spark, monkeypatch):
    monkeypatch.setattr(FD, "FOLD_TOGETHER", 100)
    rounds = []
    seen = FD.connected
    monkeypatch.setattr(FD, "connected", lambda links: rounds.append(links.count()) or seen(links))
    # Each finding touches the one before and the one after it; tools alternate, so every second one stays.
    rows = [("p", f"t{i % 2}", "X", 10 * i + 1, 10 * i + 11, ["X"], i, 0) for i in range(5000)]
    assert kept(spark, rows) == list(range(0, 5000, 2)) and rounds


def test_parts_of_a_graph(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(50)] + [(7, 7), (2000, 2001)]
    got = {}
    for r in connected(spark.createDataFrame(links, "a long, b long")).collect():
        got.setdefault(r.part, set()).add(r.node)
    assert sorted(map(sorted, got.values())) == [list(range(301)), list(range(1000, 1050)), [2000, 2001]]
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_segments_of_spans(spark):
    rng = random.Random(1)
    spans = [(i, a, a + rng.choice([0, 1, 7, 100, 3000])) for i, a in enumerate(rng.randrange(1, 2000) for _ in range(200))]
    df = spark.createDataFrame(spans, "i int, line long, last long")
    for r in df.select("*", FD.cover("line", "last", 12).alias("c")).collect():
        lines = [n for s in r.c for n in range(s["at"] << s.k, (s["at"] + 1) << s.k)]
        assert sorted(lines) == list(range(r.line, r.last + 1)) and len(r.c) <= 24
    giant = spark.range(1).select(F.lit(3).alias("line"), F.lit(10_000_002).alias("last"))
    assert giant.select(F.size(FD.cover("line", "last", 24))).first()[0] + giant.select(F.size(FD.above("line", 24))).first()[0] < 60
