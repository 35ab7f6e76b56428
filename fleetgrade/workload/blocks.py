"""Texts composed of blocks picked by a key, with the rows expected from each block.

Spark builds the text of every row of a table; the SQL never sees the text: it adds up block
lengths and looks up what a block must give, which is independent of the parser under test.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.workload.registry import dealt, table


def lit(text: object) -> str:
    return "NULL" if text is None else str(text) if isinstance(text, int) else "'" + str(text).replace("'", "''") + "'"


@dataclass
class Blocks:
    table: str
    key: str
    path: str  # prefix of the path
    suffix: str
    slots: tuple[tuple[tuple[str, tuple], ...], ...]  # per slot: (text, expected rows)
    columns: tuple[str, ...] = ("rule", "off", "extra")
    steps: tuple[int, ...] = field(default=(1, 3, 5, 7, 11, 13, 17, 19))

    def _pick(self, slot: int) -> str:
        return f"({self.key} * {self.steps[slot]} + {self.key} // 7 * {slot}) % {len(self.slots[slot])}"

    def files(self, spark: SparkSession, sf: str) -> DataFrame:
        k = F.col(self.key)
        parts = []
        for i, options in enumerate(self.slots):
            at = (k * self.steps[i] + F.floor(k / 7) * i) % len(options) + 1
            parts.append(F.element_at(F.array(*[F.lit(t) for t, _ in options]), at.cast("int")))
        return dealt(table(spark, sf, self.table).select(self.key)).select(
            F.concat(F.lit(self.path), k.cast("string"), F.lit(self.suffix)).alias("path"), F.concat(F.concat_ws("\n", *parts), F.lit("\n")).alias("content"))

    def ctes(self, name: str) -> str:
        """CTEs ``<name>`` (path, slot, ix, expected columns, line) and ``<name>_pos``."""
        sizes, expected = [], []
        for s, options in enumerate(self.slots):
            for i, (text, rows) in enumerate(options):
                sizes.append(f"({s},{i},{text.count(chr(10)) + 1})")
                expected += ["(" + ",".join(lit(v) for v in (s, i, *r)) + ")" for r in rows]
        picks = " UNION ALL ".join(f"SELECT '{self.path}' || {self.key} || '{self.suffix}' AS path, {self.key} AS k, {s} AS slot, {self._pick(s)} AS ix FROM {self.table}" for s in range(len(self.slots)))
        return f"""{name}_size(slot, ix, len) AS (VALUES {','.join(sizes)}), {name}_want(slot, ix, {', '.join(self.columns)}) AS (VALUES {','.join(expected)}),
{name}_pos AS (SELECT p.*, 1 + coalesce(sum(len) OVER (PARTITION BY path ORDER BY p.slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM ({picks}) p JOIN {name}_size z ON z.slot = p.slot AND z.ix = p.ix),
{name} AS (SELECT path, k, p.slot, p.ix, start, w.* EXCLUDE (slot, ix), CAST(start + off AS INTEGER) AS line FROM {name}_pos p JOIN {name}_want w ON w.slot = p.slot AND w.ix = p.ix)"""
