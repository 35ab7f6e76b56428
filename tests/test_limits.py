"""Inputs beyond what used to be cut off, and results that used to be lost."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from fleetgrade.operators import commands as CM
from fleetgrade.operators import explain as EX
from fleetgrade.operators import findings as FD
from fleetgrade.operators import hosts as HF
from fleetgrade.operators import lines as LN
from fleetgrade.plans.analyze import analyze
from fleetgrade.sources import tools as T
from fleetgrade.sources.files import keep_scripts
from fleetgrade.streaming import watch as SS


def test_large_workflow_is_read(spark):
    text = "on: push\njobs:\n  a:\n    steps:\n" + "      - run: echo a long enough line of text\n" * 50_000 + "      - uses: some/action@main\n"
    files = spark.createDataFrame([(".github/workflows/a.yml", text)], "path string, content string")
    assert len(text) > 2 << 20 and keep_scripts(files).count() == 1
    hits = HF.host_rules(LN.with_model(files)).select("rule", "line").collect()
    assert ("CI001", 50_005) in [tuple(h) for h in hits]


def test_escape_directive_after_comments(spark):
    text = "# a\n# b\n# c\n# d\n# e\n# f\n# escape=`\nFROM x:1\nRUN one `\n  two\n"
    got = HF.docker_instructions(spark.createDataFrame([("Dockerfile", text)], "path string, content string")).select("line", "end_line", "instr").collect()
    assert [tuple(r) for r in got] == [(8, 8, "FROM"), (9, 10, "RUN")]


def test_long_interpreter_line(spark):
    got = spark.range(1).select(LN.detect_dialect(F.lit("x"), F.lit("#!/usr/bin/env " + "-i " * 2000 + "bash"))).first()[0]
    assert got == "bash"


def test_findings_at_one_position_stay_apart(spark):
    out = {
        "bandit": json.dumps({"results": [{"test_id": "B307", "issue_severity": "MEDIUM", "issue_confidence": "HIGH", "issue_text": "eval", "line_number": 3, "line_range": [3]}]}),
        "ruff": json.dumps([{"code": "S307", "location": {"row": 3, "column": 1}, "end_location": {"row": 3, "column": 4}, "message": "eval"}]),
        "ruff-format": "--- a\n+++ b\n@@ -10,1 +10,1 @@\n-x\n+y\n",
    }
    raw = spark.createDataFrame([("a.py", t, o) for t, o in out.items()], "path string, tool string, output string")
    told = T.read_outputs(raw)
    assert {(r.tool, r.findings) for r in T.tool_runs(raw, told).collect()} == {("bandit", 1), ("ruff", 2)}
    kept = FD.deduplicate(FD.with_priority(told)).select("tool", "line").collect()
    assert sorted(map(tuple, kept)) == [("bandit", 3), ("ruff", 10)]


def test_plan_of_more_than_ten_steps():
    import numpy as np

    costs = np.full((40, 5), 0.25)
    chosen, _ = EX._plan(costs.sum(0), costs, np.ones(40))
    assert len(chosen) > 10 and EX._plan(costs.sum(0), costs, np.ones(40), 10)[0] == []


def test_guards_name_no_redirection(spark):
    lines = spark.createDataFrame([("a", 1, "command -v jq >/dev/null 2>&1 || exit"), ("a", 2, "hash curl wget > /dev/null"), ("a", 3, "which git 2> /dev/null")], "path string, line int, raw string")
    assert sorted(r.name for r in CM.guarded_commands(lines).collect()) == ["curl", "git", "jq", "wget"]


def test_stream_keeps_the_newest_over_late_rows_and_new_checkpoints(spark, tmp_path):
    schema = "path string, kind string, modified bigint"

    def send(rows, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        SS.upsert_stream(stream, lambda b: b, str(tmp_path / "table"), str(tmp_path / checkpoint)).awaitTermination()
        return sorted(map(tuple, SS.read_latest(spark, str(tmp_path / "table")).select("path", "kind", "modified").collect()))

    assert send([("a", "new", 10), ("b", "x", 1)], "one") == [("a", "new", 10), ("b", "x", 1)]
    assert send([("a", "late", 5), ("b", "y", 2)], "one") == [("a", "new", 10), ("b", "y", 2)]
    assert send([("c", "z", 1)], "two") == [("a", "new", 10), ("b", "y", 2), ("c", "z", 1)]


def test_analyze_reads_unparsed_python_and_filters_tools_in_hosts(spark):
    broken = "import subprocess\ndef f(:\n    subprocess.run(['x'])\n"
    files = spark.createDataFrame([("a/x.py", broken), ("a/Dockerfile", "FROM x:1\nRUN echo hi\n")], "path string, content string")
    comment = {"comments": [{"line": 1, "endLine": 1, "column": 1, "endColumn": 1, "level": "error", "code": c, "message": "m"} for c in (2148, 2086)]}
    outputs = spark.createDataFrame([("a/Dockerfile", "shellcheck", json.dumps(comment))], "path string, tool string, output string")
    found = {(r.path, r.rule) for r in analyze(files, outputs=outputs).findings.select("path", "rule").collect()}
    assert ("a/x.py", "PYROB001") in found
    assert ("a/Dockerfile", "SC2086") in found and ("a/Dockerfile", "SC2148") not in found
