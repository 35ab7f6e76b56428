"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "fleetgrade", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; cluster settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session, as in tests, may fall back on a private folder: on a
    cluster a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="fleetgrade-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame, like: DataFrame) -> DataFrame:
    """:func:`cut` in as many tasks at most as ``like``, itself cut, has: a union of many stored frames has the tasks of all of them."""
    return cut(df.coalesce(max(1, like._jdf.queryExecution().toRdd().getNumPartitions())))


def broadcast_by_measure(spark: SparkSession) -> None:
    """Let the measured size of a side decide whether it is broadcast, not the estimate before the run.

    Spark counts 20 bytes for a text that a query builds or Python returns, so whole fleets pass for small tables. The
    limit in bytes stays what the session says; it is compared with what the shuffle has written.
    """
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit != "-1":
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def sorted_shuffles(spark: SparkSession) -> None:
    """Begin shuffles with a few partitions more where Spark would open a file for each of them in every task.

    Up to ``bypassMergeThreshold`` partitions a task writes as many files, which costs more than its rows where tasks are many and
    short; beyond it rows are sorted into one file. The measured sizes merge the partitions afterwards. This holds for the rest of the session.
    """
    first, n = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    merged = all(spark.conf.get(name, "true") == "true" for name in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled"))
    if merged and 64 < n <= files and spark.conf.get(first, None) is None:
        spark.conf.set(first, str(files + 56))


@contextmanager
def parted_by_file(spark: SparkSession) -> Iterator[None]:
    """What is planned inside joins rows by path and line where they lie by path, without a shuffle more; for files whose rows one task holds."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, for streams and written tables."""
    import uuid

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
