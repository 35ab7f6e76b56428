"""Rules from a table: the same findings as trying every pattern on every line."""

from __future__ import annotations

import random
import re

import pytest

from fleetgrade.operators import custom as UD
from fleetgrade.operators import rule_table as RT

LINES = [
    ("a.sh", 1, "token = abc; Token = x", "bash"), ("a.sh", 2, "# token = commented", "bash"), ("a.sh", 3, "", "bash"), ("a.sh", 4, None, "bash"),
    ("b.py", 1, "secretary and secret-7", "python"), ("b.py", 2, "é\u0001token\u0002 = <|>", "python"), ("b.py", 3, "xx", "python"), ("c.sh", 1, "nothing here", "bash"),
]
RULES = [
    UD.CustomRule("TOKEN", r"token\s*=", "m", replace="<$0>2$12"), UD.CustomRule("ANYCASE", r"TOKEN", "m", ignore_case=True, comments=True),
    UD.CustomRule("EITHER", r"(secret|nothing)-?(?<n>\d)?", "m", replace="${n}$1\\${zz}$5$x"), UD.CustomRule("PYTHON", "secret", "m", language="python"),
    UD.CustomRule("SHELL", "token", "m", language="shell"), UD.CustomRule("EMPTY", "x*$", "m", replace="!"), UD.CustomRule("LACKS", "secret", "m", absent=True),
    UD.CustomRule("LACKSPY", "zzz", "m", absent=True, language="python"),
]


def lines(spark, rows=LINES):
    return spark.createDataFrame(rows, "path string, line int, raw string, dialect string")


def found(df):
    return {(r.path, r.line, r.rule, r.column, tuple((e.column, e.end_column, e.replacement) for e in r.edits)) for r in df.collect()}


def model(rows, rules):
    """Every rule on every line, one after the other."""
    out, paths = set(), {p: d for p, _, _, d in rows}
    for r in rules:
        applies = {p for p, d in paths.items() if r.language == "any" or (r.language == "python") == (d == "python")}
        pattern = re.compile(r.pattern.replace("(?<n>", "(?P<n>").replace("$", r"\Z"), re.I if r.ignore_case else 0)
        seen = set()
        for path, line, raw, _ in rows:
            if path not in applies or not raw or (not r.comments and raw.lstrip().startswith("#")):
                continue
            hits = list(pattern.finditer(raw))
            if not hits:
                continue
            seen.add(path)

            def fill(m):
                def one(t):
                    if t.group(1):
                        return (m.group(int(t.group(1))) or "") if int(t.group(1)) <= pattern.groups else ""
                    return (m.group(t.group(2)) or "") if t.group(2) in pattern.groupindex else ""
                return re.sub(r"\$(?:(\d)|\{(\w+)\})", one, r.replace)

            edits = tuple((m.start() + 1, m.end() + 1, fill(m)) for m in hits) if r.replace is not None else ()
            if not r.absent:
                out.add((path, line, r.id, hits[0].start() + 1, edits))
        if r.absent:
            out |= {(p, 0, r.id, 0, ()) for p in applies - seen}
    return out


@pytest.mark.parametrize("pass_bytes", [RT.PASS_BYTES, 20])
def test_equal_to_trying_all(spark, pass_bytes):
    got = RT.custom_rules(lines(spark), UD.rule_table(spark, RULES), pass_bytes=pass_bytes)
    assert found(got) == model(LINES, RULES)
    places = [(r.path, r.position) for r in got.collect()]
    assert len(places) == len(set(places))


def test_listed_rules_give_the_same(spark):
    """Rules given as a list write their edits by the same rule: marks in the line and empty matches included."""
    assert found(UD.custom_rules(lines(spark), RULES, lines(spark).select("path", "dialect").distinct())) == model(LINES, RULES)


def test_many_rules_on_random_lines(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 5))) for _ in range(150)]
    shapes = ["{0}", "{0}|{1}", "{0}+x?", "({0}|{1}){2}", "[a-c]{0}", "{0}.{1}", "(?:{0})?{1}", "{0}{{0,1}}{1}", "(?i){0}", "a", "(?={0}){0}"]
    rules = [UD.CustomRule(f"R{i}", rnd.choice(shapes).format(rnd.choice(words), rnd.choice(words), rnd.choice(words)), "m", ignore_case=rnd.random() < 0.3) for i in range(300)]
    rows = [(f"f{i % 7}", i, " ".join(rnd.choice((str.upper, str.lower))(rnd.choice(words)) for _ in range(8)), "bash") for i in range(120)]
    assert found(RT.custom_rules(lines(spark, rows), UD.rule_table(spark, rules))) == model(rows, rules)


def test_rules_with_problems_are_left_out_and_told(spark):
    rules = UD.rule_table(spark, [UD.CustomRule("OPEN", "(", "m"), UD.CustomRule("GOOD", "xx", "m"), UD.CustomRule("low", "xx", "m"), UD.CustomRule("TWICE", "xx", "m"), UD.CustomRule("TWICE", "yy", "m")])
    assert {r.rule for r in RT.custom_rules(lines(spark), rules).collect()} == {"GOOD"}
    assert {(r.id, r.problem) for r in RT.broken_rules(rules).collect()} == {("OPEN", "bad pattern"), ("low", "bad id"), ("TWICE", "duplicate id")}


def test_empty_tables(spark):
    assert RT.custom_rules(lines(spark), UD.rule_table(spark, [])).count() == 0
    assert found(RT.custom_rules(lines(spark, []), UD.rule_table(spark, RULES))) == set()


def test_texts_by_language(spark):
    rows = [("A", "xx", "plain", {"fr": "texte"}), ("B", "xx", "plain", {"en": "text", "fr": "texte"}), ("C", "xx", None, {"de": "Text"})]
    rules = UD.rule_table(spark, [UD.CustomRule(i, p, m or "m") for i, p, m, _ in rows])
    by = spark.createDataFrame([(i, t) for i, _, _, t in rows], "id string, messages map<string,string>")
    got = {r.rule: r.message for r in RT.custom_rules(lines(spark), rules.join(by, "id"), language="en").collect()}
    assert got == {"A": "plain", "B": "text", "C": "m"}


@pytest.mark.parametrize("pattern, texts", [
    ("foo", ["foo"]), ("(?i)Foo\\s+bar{2}c", ["foo"]), ("a|bcd", None), ("(secret|token)=\\d+", ["secret", "token"]), ("x?yz*w", None), ("(ab)?cd", ["cd"]), ("ab{0,2}cd", ["cd"]),
    ("(?x)a b", None), ("\\Qa\\E", None), ("(?:ab|c(de|fgh))+q", ["ab", "de", "fgh"]), ("a[b\\]c](def)", ["def"]), ("abc)", None), ("(" * 3000 + "ab" + ")" * 3000, None),
])
def test_needed_texts(pattern, texts):
    assert RT.needed_texts(pattern) == texts
