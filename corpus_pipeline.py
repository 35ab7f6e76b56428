"""A training-data pipeline over the documents: quality, exact copies, near copies, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on all the stage before it kept, and gives a DataFrame
that is written and read again as the next stage's documents. All but the last keep the columns of documents.

Rows with a null id pass the stages like any other; the mix repeats a document as often as it takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetgrade.llm import exact_dedup, jaccard, mixing, pieces, quality
from fleetgrade.session import work_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(docs.select("doc_id", "text", "n_chars"), labels))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard similarity of 0.8 or more."""
    return jaccard.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each time they are taken."""
    return mixing.take_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding gives the text back."""
    return pieces.encoded(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", token_ids),
]
# The classifier, the components and the piece lattice are beyond SQL: tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        folder = work_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
