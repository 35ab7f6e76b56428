"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fleetgrade.session import build_session
from fleetgrade.workload import load_all

HEADLINE = (
    "to_lines", "document_scores", "custom_rules", "mask_lines", "file_flags", "line_rules_sec00", "file_rules", "shell_findings",
    "deduplicate", "suppress", "fingerprint", "script_scores", "rule_impacts", "grade_plan", "diff_baseline", "match_reports",
    "multiset_at_volume", "tool_shellcheck", "tool_ruff", "docker_rules", "workflow_rules", "python_facts", "external_commands",
    "builtin_fixes", "debounce",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "fleetgrade-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()[0]
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    scripts = spark.read.parquet(f"{sf}/part.parquet").count()
    rate = round(scripts / times["shell_findings"], 1) if "shell_findings" in times else None
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf.rstrip("/").split("sf")[-1], "scripts": scripts, "scripts_per_sec_all_rules": rate,
    }))


if __name__ == "__main__":
    main()
