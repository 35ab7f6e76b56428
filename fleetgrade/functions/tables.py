"""Table functions for SQL: the commands of shell lines, ``SELECT * FROM shell_commands(TABLE(lines))``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from fleetgrade.operators import shell_words as SW


class ShellCommands:
    """One row per command of each row: all columns of the row but the code, then number, name, base, words, bare, before, after, inner.

    ``column`` names the text, by default ``code``; null and blank texts give no rows. Rows stay where they are: a partitioning is
    only made when the query asks for one. A column of the row that has the name of a field of commands is refused.
    """

    FIELDS = (
        ("number", IntegerType()), ("name", StringType()), ("base", StringType()), ("words", ArrayType(StringType())), ("bare", ArrayType(StringType())),
        ("before", StringType()), ("after", StringType()), ("inner", BooleanType()))

    @staticmethod
    def analyze(lines: AnalyzeArgument, column: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not lines.isTable:
            raise ValueError("shell_commands needs TABLE(…)")
        text = "code"
        if column is not None:
            if column.value is None:
                raise ValueError("the name of the column must be a constant")
            text = column.value
        kinds = {f.name: f.dataType for f in lines.dataType.fields}
        if not isinstance(kinds.get(text), StringType):
            raise ValueError(f"no text column {text}")
        clash = sorted({name for name, _ in ShellCommands.FIELDS} & (set(kinds) - {text}))
        if clash:
            raise ValueError(f"columns named like fields of commands: {', '.join(clash)}")
        schema = StructType([f for f in lines.dataType.fields if f.name != text])
        for name, kind in ShellCommands.FIELDS:
            schema = schema.add(name, kind)
        return AnalyzeResult(schema=schema)

    def eval(self, row: Any, column: str | None = None) -> Iterator[tuple]:
        text = column or "code"
        code = row[text]
        if not code or code.isspace():
            return
        kept = tuple(v for name, v in zip(row.__fields__, row) if name != text)
        own = SW.commands(code)
        for i, c in enumerate(SW.with_inner(own)):
            base, bare = c.bare()
            yield (*kept, i + 1, c.name, base, c.words, bare, c.before, c.after, i >= len(own))


def register_tables(spark: SparkSession) -> None:
    spark.udtf.register("shell_commands", udtf(ShellCommands))
