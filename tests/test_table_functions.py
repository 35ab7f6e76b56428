"""Table functions in SQL give what the DataFrame operators give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetgrade.functions.tables import register_tables
from fleetgrade.operators import shell_words as SW
from fleetgrade.workload.line_expectations import EXPECTED


def test_same_as_command_rows(spark):
    register_tables(spark)
    rows = [(f"f{i % 5}", i, code) for i, (code, _) in enumerate(EXPECTED)] + [("f1", 900, None), ("f1", 901, "  "), (None, 902, "ssh h 'rm -r d' | cat")]
    lines = spark.createDataFrame(rows, "path string, line int, code string")
    names = ("path", "line", "number", "name", "base", "words", "bare", "before", "after", "inner")
    want = sorted(map(repr, SW.command_rows(lines).select(*names).collect()))
    for cut in ("", " PARTITION BY path ORDER BY line"):
        got = spark.sql("SELECT * FROM shell_commands(TABLE({lines})" + cut + ")", lines=lines)
        assert got.columns == list(names)
        assert sorted(map(repr, got.collect())) == want


def test_named_column_and_refusals(spark):
    register_tables(spark)
    lines = spark.createDataFrame([("a | b", 1)], "text string, k int")
    got = spark.sql("SELECT k, name FROM shell_commands(TABLE({lines}), 'text')", lines=lines)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (1, "b")]
    for bad, column in ((lines, ""), (lines, ", 'k'"), (lines.withColumn("name", F.lit("x")), ", 'text'")):
        with pytest.raises(Exception, match="no text column|named like"):
            spark.sql("SELECT * FROM shell_commands(TABLE({lines})" + column + ")", lines=bad).collect()
    assert spark.sql("SELECT * FROM shell_commands(TABLE({lines}), 'text')", lines=lines.limit(0)).count() == 0
