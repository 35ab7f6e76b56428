"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws ``-ln(u) / quality``; its order inside its source is a weighted
sample without replacement, so a prefix of any length is one. A source whose target
is ``e`` whole epochs and a rest takes each of its documents ``e`` times, and then
the prefix whose running size comes nearest to the rest.

The prefix is found without sorting a source in one task: keys are dealt into
``BINS`` fixed bins, sizes are summed by (source, bin) with map-side combine, running
sums go over bins, and only the documents of the one bin where the rest ends are
ordered one by one. ``u`` is fixed by the id and the seed, so reruns agree.

Defined cases: a null or blank text has size 0 and takes 0; a null source is a source
of its own, ordered last; a null id draws as the empty string; documents that draw
the same key (repeated ids of equal quality) are taken together; a source without
words has target 0; an empty table gives no rows. Quality is between 0.1 and 1.
The table of sources has one row per source and is ordered as a whole; only such
one-row-per-source tables are broadcast, after their size is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgrade.llm.common import cut, documents, text_of, unit_hash, within

BINS = 1 << 16
MOST_EPOCHS = 3
SEED = "mix"


def size_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def quality_of(text: Column) -> Column:
    """0.1 to 1: the share of characters that are lower-case ASCII letters."""
    letters = F.length(text) - F.length(F.translate(text, "abcdefghijklmnopqrstuvwxyz", ""))
    return F.lit(0.1) + F.lit(0.9) * letters / F.greatest(F.length(text), F.lit(1))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source.

    Weights repeat over the sources by code point, null last. Targets share the total
    by weight; none exceeds ``most`` times its source, and the excess is shared again.
    With sources ordered by the ratio at which they fill up, the shared level is the
    largest ``(total - filled before) / weights left``.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("fill", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    level = (F.sum("source_size").over(Window.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level)
    # The level rises while what stands before fills up below it, and falls from there on.
    leveled = leveled.withColumn("shared", F.max("level").over(Window.partitionBy()))
    target = F.when(F.col("fill") < F.col("shared"), F.col("source_size") * float(most)).otherwise(F.col("shared") * F.col("weight"))
    return leveled.select("source", "source_size", target.alias("target"))


def _drawn(docs: DataFrame, quality: Column | None, id_col: str, text_col: str) -> DataFrame:
    """The documents with their size, key and bin; a key is distributed as -ln(u) / quality, and key / (1 + key) spreads it over the bins."""
    text = text_of(F.col(f"`{text_col}`"))
    draw = -F.log(unit_hash(F.lit(SEED), F.col(f"`{id_col}`"))) / (quality if quality is not None else quality_of(text))
    return docs.withColumns({"__size": size_of(text), "__key": draw}).withColumn("__bin", F.floor(F.col("__key") / (1 + F.col("__key")) * BINS).cast("int"))


def plan_sources(drawn: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """(source, __size, __key, __bin) to one row per source: size, target, epochs, and where its last epoch ends (bin and key)."""
    by_bin = cut(drawn.groupBy("source", "__bin").agg(F.sum("__size").alias("in_bin")))
    targets = source_targets(by_bin.groupBy("source").agg(F.sum("in_bin").alias("source_size")), weights, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = cut(targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    up_to = F.coalesce(F.sum("in_bin").over(Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = targets.select(F.col("source").alias("s"), "rest")
    bins = by_bin.withColumn("before", up_to).join(within(rest), F.col("source").eqNullSafe(F.col("s")))
    # One bin of a source holds the point where the rest ends.
    last = bins.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("in_bin") > F.col("rest")))
    last = cut(last.select("s", F.col("__bin").alias("last_bin"), "before", "rest"))
    edge = drawn.join(within(last), F.col("source").eqNullSafe(F.col("s")) & (F.col("__bin") == F.col("last_bin")))
    edge = edge.groupBy("s", "before", "rest", "__key").agg(F.sum("__size").alias("n"))
    run = Window.partitionBy("s").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    # Nearest: what lies across the end belongs to the prefix if its middle is inside.
    edge = edge.filter(F.col("start") + F.col("n") / 2 <= F.col("rest")).groupBy("s").agg(F.max("__key").alias("last_key"))
    ends = last.select("s", "last_bin").join(edge.withColumnRenamed("s", "e"), F.col("s").eqNullSafe(F.col("e")), "left").drop("e")
    plan = targets.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    return cut(plan.select(F.col("source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "epochs", "last_bin", "last_key"))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS, quality: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    drawn = _drawn(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), quality, "doc_id", "text")
    drawn = cut(drawn.drop("text"))
    met = drawn.join(within(plan_sources(drawn, weights, most)), F.col("source").eqNullSafe(F.col("__source")))
    return met.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * _times()).alias("taken"))


def _times() -> Column:
    inside = (F.col("__bin") < F.col("__last_bin")) | ((F.col("__bin") == F.col("__last_bin")) & (F.col("__key") <= F.col("__last_key")))
    return F.col("__epochs") + F.when(inside, 1).otherwise(0)


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS, quality: Column | None = None,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns, once for each time they are taken. Texts are not shuffled."""
    named = {"id": id_col, "source": source_col, "text": text_col}
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *(F.col(f"`{c}`").alias(n) for n, c in named.items()), *([quality.alias("quality")] if quality is not None else []))
    drawn = _drawn(packed, F.col("quality") if quality is not None else None, "id", "text")
    slim = cut(drawn.select("source", "__size", "__key", "__bin"))
    met = drawn.join(within(plan_sources(slim, weights, most)), F.col("source").eqNullSafe(F.col("__source")))
    copies = met.filter(F.col("__size") > 0).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), _times().cast("int"))))
    return copies.select("__row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {
    "op6_mixing": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS x, len(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> '')) AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size, -ln((CAST('0x' || md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13] AS BIGINT) + 0.5) / 4503599627370496.0::DOUBLE)
    / (0.1::DOUBLE + 0.9::DOUBLE * length(regexp_replace(x, '[^a-z]', '', 'g')) / greatest(length(x), 1)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, ((n - 1) % 3 + 1)::DOUBLE AS weight FROM s),
fill (step, source, source_size, weight, full_up) AS (
  SELECT 0, source, source_size, weight, false FROM w
  UNION ALL
  SELECT step + 1, source, source_size, weight, full_up OR weight * (sum(source_size) OVER () - 3 * sum(CASE WHEN full_up THEN source_size ELSE 0 END) OVER ())
    / nullif(sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER (), 0) > 3 * source_size
  FROM fill WHERE step < (SELECT count(*) FROM w)),
t AS (
  SELECT source, source_size, CASE WHEN full_up THEN 3.0::DOUBLE * source_size
    ELSE (sum(source_size) OVER () - 3 * sum(CASE WHEN full_up THEN source_size ELSE 0 END) OVER ()) / sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM fill WHERE step = (SELECT count(*) FROM w)),
p AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN start + size / 2 <= target - epochs * source_size AND size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM p""",
}
