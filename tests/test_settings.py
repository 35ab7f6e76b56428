"""Settings of files from folder configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgrade import dims
from fleetgrade.operators import findings as FD
from fleetgrade.operators import lines as LN
from fleetgrade.operators import shell_rules as SR
from fleetgrade.plans.analyze import Options, analyze
from fleetgrade.settings import settings_of

CONFIG = "folder string, profile string, contexts array<string>, disabled array<string>, limits map<string,int>"


def test_nearest_folder_wins_and_roots_end_the_search(spark):
    files = spark.createDataFrame([("a/x.sh",), ("a/b/y.sh",), ("a/b/c/z.sh",), ("a/lib/other/w.sh",), ("q.sh",), ("ab/x.sh",)], "path string")
    configs = spark.createDataFrame([("a", "strict", ["cron"], None, None), ("a/b", None, None, ["mnt001"], {"max_line": 7}), ("a/b/c", "missing", [], [], None)], CONFIG)
    roots = spark.createDataFrame([("a",), ("a/lib",), ("ab",)], "folder string")
    got = {r.path: r.s for r in settings_of(files, configs, roots, "legacy", ("root",), ("ROB001",)).collect()}
    assert got["a/x.sh"].max_line == 100 and got["a/x.sh"].contexts == ["cron"] and got["a/x.sh"].disabled == ["ROB001"]
    assert got["a/b/y.sh"].max_line == 7 and got["a/b/y.sh"].max_function == 150 and got["a/b/y.sh"].contexts == ["root"]
    assert got["a/b/y.sh"].disabled == ["MNT001", *[d for d in dims.PROFILES["legacy"]["disabled"] if d != "MNT001"]]
    assert got["a/b/c/z.sh"].max_line == 160 and got["a/b/c/z.sh"].contexts == []
    for path in ("a/lib/other/w.sh", "q.sh", "ab/x.sh"):
        assert got[path].max_line == 160 and got[path].contexts == ["root"] and "ROB001" in got[path].disabled
    assert settings_of(files.limit(0), configs, roots).count() == 0


def test_limits_of_rows_equal_limits_of_the_call(spark):
    text = "#!/bin/bash\nf() {\n" + "if true; then\n" * 7 + "echo " + "x" * 140 + "\n" + "fi\n" * 7 + "echo y\n" * 60 + "}\nif a; then if b; then if c; then if d; then echo; fi; fi; fi; if e; then if g; then echo; fi; fi; fi\n"
    files = LN.with_model(spark.createDataFrame([(f"{p}/x.sh", text) for p in dims.PROFILES], "path string, content string"))
    configs = spark.createDataFrame([(p, p, [], None, None) for p in dims.PROFILES], CONFIG)
    settings = settings_of(files, configs)
    columns = ["path", "line", "rule", "severity", "message"]
    mine = SR.shell_findings(LN.mask_lines(files, 3), files, settings=settings, max_line=100)
    mine = FD.hide_by_context(mine.join(settings, "path"), F.col("s.contexts")).filter("not array_contains(s.profile_off, rule)")
    want = []
    for p, profile in dims.PROFILES.items():
        own = files.filter(F.startswith("path", F.lit(f"{p}/")))
        want += SR.shell_findings(LN.mask_lines(own, profile["thresholds"]["max_nesting"]), own, p).select(columns).collect()
    assert sorted(map(tuple, mine.select(columns).collect())) == sorted(map(tuple, want))
    assert {r.rule for r in want} >= {"MNT001", "MNT002", "MNT003"}


def test_configured_folders_equal_runs_of_their_own(spark):
    text = "#!/bin/bash\nrm -rf $X/y\nchmod 777 /a\necho > /tmp/x\nread -r a\n" + "echo " + "x" * 110 + "\n"
    kinds = {"a": ("strict", ["cron"], ["SEC004"]), "b": ("legacy", ["root"], []), "c": ("standard", [], ["sc2115"])}
    files = spark.createDataFrame([(f"{k}/x.sh", text) for k in kinds], "path string, content string")
    configs = spark.createDataFrame([(k, p, c, d, None) for k, (p, c, d) in kinds.items()], CONFIG)
    both = analyze(files, configs=configs)
    found = sorted(map(tuple, both.findings.select("path", "line", "rule", "severity").collect()))
    scores = sorted(map(tuple, both.scores.collect()))
    want, own = [], []
    for k, (profile, contexts, disabled) in kinds.items():
        one = analyze(files.filter(F.startswith("path", F.lit(f"{k}/"))), Options(profile, tuple(contexts), tuple(disabled)))
        want += map(tuple, one.findings.select("path", "line", "rule", "severity").collect())
        own += map(tuple, one.scores.collect())
    assert found == sorted(want) and scores == sorted(own)
    assert len({s[1:] for s in scores}) == 3
