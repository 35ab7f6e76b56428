"""Exact deduplication: groups by a 128-bit content hash, bytes compared inside each group.

Rows are grouped on (hash, text), so two texts share a group only if their bytes
are equal; the hash decides where a group goes, the text whether it is one. Map-side
partial aggregation leaves at most one row per text and task before the shuffle,
so a text with a third of all rows is no hot group. Members meet their group by
hash alone; only hashes that stand for more than one text (collisions, normally
none) go through a second join that compares the texts again.

Defined cases: a null text counts as empty; a null id ranks behind every other id;
rows with the same id and text are one document given more than once (all of them
carry the same answer, :func:`drop_copies` leaves one); an empty table gives no
rows; other columns are untouched and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgrade.llm.common import cut, documents, text_of

Digest = Callable[[Column], Column]


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _chosen(keep: str) -> Callable[[Column], Column]:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    return F.min if keep == "smallest" else F.max


def mark_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", digest: Digest = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", digest(F.col("text")))
    member = rows.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
    texts = rows.groupBy("h", "text").agg(_chosen(keep)("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    slim = texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))
    groups = cut(slim)
    found = member.join(groups.filter("texts = 1"), "h").drop("h", "texts")
    collided = groups.filter("texts > 1").select("h")
    if not collided.isEmpty():
        few = rows.join(collided, "h", "left_semi")
        answers = few.groupBy("h", "text").agg(_chosen(keep)("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.unionByName(few.join(answers, ["h", "text"]).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", digest: Digest = content_hash) -> DataFrame:
    """The rows that stay, with all their columns: one per text, in one shuffle."""
    text = text_of(text_col)
    rest = [c for c in docs.columns if c != text_col]
    rank = F.struct(F.col(f"`{id_col}`").isNull() if keep == "smallest" else F.col(f"`{id_col}`").isNotNull(), F.col(f"`{id_col}`"))
    pick = F.min_by if keep == "smallest" else F.max_by
    _chosen(keep)
    row = F.struct(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`").isNull().alias("__no_text"))
    best = docs.groupBy(digest(text).alias("__h"), text.alias("__text")).agg(pick(row, rank).alias("__row"))
    whole = {c: F.col(f"__row.`{c}`") for c in rest} | {text_col: F.when(F.col("__row.__no_text"), F.lit(None)).otherwise(F.col("__text"))}
    return best.select(*(whole[c].alias(c) for c in docs.columns))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(documents(spark, sf_dir), keep="largest")


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLES = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
