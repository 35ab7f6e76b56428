"""The entry module with and without the training-data operators."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SHOW = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder: Path) -> tuple[set[str], set[str]]:
    run = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True)
    queries, oracles = json.loads(run.stdout.strip().splitlines()[-1])
    return set(queries), set(oracles)


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("left_behind", [True, False])
def test_queries_without_the_subpackage(tmp_path, pipeline, left_behind):
    shutil.copytree(REPO / "fleetgrade", tmp_path / "fleetgrade", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists() and (pipeline or name.startswith("__")):
            shutil.copy(REPO / name, tmp_path)
    if left_behind:
        (tmp_path / "fleetgrade/llm/__pycache__").mkdir(parents=True)
    queries, oracles = names(tmp_path)
    mine, own = names(REPO)
    assert queries == {n for n in mine if n != "pipeline" and not n.startswith("op")} | {n for n in mine if n.startswith("order")}
    assert oracles == own & queries and len(queries) > 190
