"""Properties and brute-force comparisons of the order-dependent operators."""

import random

from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.functions import scalars as S
from fleetgrade.operators import compare as CP
from fleetgrade.operators import explain as EX
from fleetgrade.operators import findings as FD
from fleetgrade.operators import fixes as FX
from fleetgrade.operators import prefix as PX
from fleetgrade.operators import scoring as AG

TOOLS = ["shellcheck", "bandit", "ruff", "builtin", "shfmt"]
RULES = ["SYNTAX", "A1", "A2", "B1", "B2", "C1"]


def _random_findings(seed, n=250):
    r = random.Random(seed)
    out = []
    for i in range(n):
        line = r.randrange(0, 12)
        out.append((
            f"p{r.randrange(3)}", r.choice(TOOLS), r.choice(RULES), r.choice(dims.CATEGORIES), r.choice(dims.SEVERITIES), line,
            line + r.randrange(0, 9) if r.random() < 0.4 else None, r.sample(["A*", "B1", "SYNTAX", "C1", "A2"], r.randrange(0, 3)), i))
    return out


SCHEMA = "path string, tool string, rule string, category string, severity string, line int, end_line int, equivalents array<string>, position bigint"


def _naive_dedup(rows):
    match = lambda p, i: i.startswith(p[:-1]) if p.endswith("*") else p == i
    end = lambda f: f[6] if f[6] is not None and f[6] >= f[5] and f[6] - f[5] < 6 else f[5]

    def same(a, b):
        eq = any(match(p, b[2]) for p in a[7]) or any(match(p, a[2]) for p in b[7])
        if a[1] == b[1]:
            return a[5] == b[5] and (a[2] == b[2] or eq)
        near = a[5] == b[5] or (a[5] <= end(b) and b[5] <= end(a)) or 0 in (a[5], b[5]) or "SYNTAX" in (a[2], b[2])
        return near and eq

    kept = []
    for f in sorted(rows, key=lambda f: (dims.TOOL_PRIORITY.index(f[1]), f[8])):
        if not any(k[0] == f[0] and same(k, f) for k in kept):
            kept.append(f)
    return {f[8] for f in kept}


def test_dedup_equals_the_greedy_model_in_any_input_order(spark):
    for seed in (1, 2):
        rows = _random_findings(seed)
        want = _naive_dedup(rows)
        for shuffled in (rows, random.Random(seed).sample(rows, len(rows))):
            got = FD.deduplicate(spark.createDataFrame(shuffled, SCHEMA), 6).select("position").collect()
            assert {r.position for r in got} == want


def test_prefix_helpers_equal_plain_windows(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), i, r.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at int, v int")
    out = PX.running_sums(df, ["k"], "at", {"s": F.coalesce("v", F.lit(0))}, chunk=7)
    out = PX.carry_last(out, ["k"], "at", {"last": F.col("v")}, chunk=7)
    out = PX.next_value(out, ["k"], "at", {"after": F.col("v")}, chunk=7)
    got = {(x.k, x.at): (x.s, x.last, x.after) for x in out.collect()}
    for k in "ab":
        mine = [x for x in rows if x[0] == k]
        for n, (_, at, _v) in enumerate(mine):
            seen = [x[2] for x in mine[: n + 1] if x[2] is not None]
            later = [x[2] for x in mine[n + 1 :] if x[2] is not None]
            assert got[(k, at)] == (sum(seen), seen[-1] if seen else None, later[0] if later else None)


def _naive_match(before, after):
    left = list(before)
    out = {}
    for a in after:
        if a in left:
            left.remove(a)
            out[a] = a
    tail = lambda x, y: next((n for n, (p, q) in enumerate(zip(x[::-1], y[::-1])) if p != q), min(len(x), len(y)))
    for a in after:
        if a in out:
            continue
        same = [b for b in left if b.split("/")[-1] == a.split("/")[-1]]
        scores = [tail(b.split("/"), a.split("/")) for b in same]
        best = [b for b, s in zip(same, scores) if s == max(scores)]
        out[a] = best[0] if len(best) == 1 else None
        if out[a]:
            left.remove(out[a])
    return out


def test_match_reports_equals_the_sequential_model(spark):
    r = random.Random(5)
    for _ in range(3):
        make = lambda n: sorted({"/".join(r.choice("abc") for _ in range(r.randrange(1, 4))) + "/" + r.choice(["x", "y"]) for _ in range(n)})
        before, after = make(25), make(25)
        df = lambda ps: spark.createDataFrame([(p, i) for i, p in enumerate(ps)], "path string, ord bigint")
        got = {x.path: x.before_path for x in CP.match_reports(df(before), df(after)).collect()}
        assert got == _naive_match(before, after)


def _findings(spark, seed=7):
    df = spark.createDataFrame(_random_findings(seed), SCHEMA)
    return FD.complete(df)


def test_diff_with_itself_is_unchanged(spark):
    f = _findings(spark).withColumn("fingerprint", F.col("rule"))
    states = CP.multiset_states(f, f, ["path"], "fingerprint").groupBy("state").count().collect()
    assert [(s.state, s["count"]) for s in states] == [("unchanged", 250)]


def test_fingerprints_survive_inserted_lines(spark):
    lines = [("p", i, f"  text {i % 3}  ") for i in range(1, 10)]
    make = lambda shift: (
        FD.complete(spark.createDataFrame([("p", "t", "R", "security", "low", i + shift) for i in range(1, 10)], "path string, tool string, rule string, category string, severity string, line int")),
        spark.createDataFrame([("p", n + shift, t) for _, n, t in lines] + [("p", i + 1, "new") for i in range(shift)], "path string, line int, raw string"))
    a, b = ({r.fingerprint for r in FD.fingerprint(*make(s)).collect()} for s in (0, 4))
    assert a == b and len(a) == 9


def test_fnv_known_values(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",)] * 20, "t string").select("t", S.fnv1a64(F.col("t")).alias("h"))
    assert {r.t: r.h for r in df.collect()} == {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}


def test_scores_never_fall_when_a_finding_goes(spark):
    f = _findings(spark)
    files = spark.createDataFrame([("p0", 300), ("p1", 40), ("p2", 90), ("clean", 5)], "path string, code_lines int")
    score = lambda df: {r.path: r for r in AG.script_scores(files, AG.rule_penalties(df, files)).collect()}
    full, less = score(f), score(f.filter("position % 7 <> 0"))
    assert full["clean"]["global"] == 10.0 and full["clean"].grade == "A"
    assert all(less[p]["global"] >= full[p]["global"] for p in full)


def test_grade_plan_reaches_the_next_grade(spark):
    f = _findings(spark).filter("position < 60")
    files = spark.createDataFrame([("p0", 300), ("p1", 40), ("p2", 90)], "path string, code_lines int")
    pen = AG.rule_penalties(f, files)
    before = {r.path: r.grade for r in AG.script_scores(files, pen).collect()}
    steps = EX.grade_plan(EX.rule_impacts(f, pen)).collect()
    for path in {s.path for s in steps}:
        chosen = {(s.tool, s.rule) for s in steps if s.path == path}
        left = f.filter(f"path = '{path}'").collect()
        rest = [r for r in left if (r.tool, r.rule) not in chosen]
        df = spark.createDataFrame(rest, f.schema)
        after = {r.path: r.grade for r in AG.script_scores(files, AG.rule_penalties(df, files)).collect()}[path]
        assert after == next(s.grade for s in steps if s.path == path) and after < before[path]


def test_edits_do_not_overlap():
    edit = lambda l, a, b, t, r="R": {"line": l, "column": a, "end_line": l, "end_column": b, "replacement": t, "rule": r}
    text, counts = FX._apply("abc\ndef", [edit(1, 2, 4, "X"), edit(1, 1, 2, "Y"), edit(1, 3, 4, "lost"), edit(2, 4, 4, "!", "S")])
    assert (text, counts) == ("YX\ndef!", {"R": 1, "S": 1})


def test_dedup_of_one_hot_file(spark):
    r = random.Random(11)
    rows = [("hot", r.choice(TOOLS), r.choice(RULES), "security", "low", r.randrange(0, 300), None, r.sample(["A*", "B1", "SYNTAX"], r.randrange(0, 2)), i) for i in range(2500)]
    got = {x.position for x in FD.deduplicate(spark.createDataFrame(rows, SCHEMA), 6).select("position").collect()}
    assert got == _naive_dedup(rows)


def test_apply_config_drops_a_rule_under_any_of_its_ids(spark):
    f = _findings(spark).limit(1)
    rules = f.crossJoin(spark.createDataFrame([("S105",), ("B105",), ("SC2197",), ("POR005",), ("X",)], "r string")).withColumn("rule", F.col("r")).drop("r")
    left = {r.rule for r in FD.apply_config(rules, ("B105", "SC2196")).collect()}
    assert left == {"X"}
