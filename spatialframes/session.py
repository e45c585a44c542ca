"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# What a cluster session should set besides its sizes: runtime re-planning, splitting of skewed
# partitions, enough initial partitions for it to merge, and streaming state that spills to disk.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: str = "*", app: str = "spatialframes", **extra: str) -> SparkSession:
    """A session for tests and benches; on a cluster pass your own session to the operators."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spatialframes-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write an aggregated side once and read it back.

    The side is computed a single time even when a plan uses it twice, it survives lost
    executors, and its measured size lets Catalyst decide between a broadcast and a shuffled
    join. Meant for aggregates that are small next to the rows they came from.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_and_tell(df: DataFrame, **largest: Column) -> tuple[DataFrame, dict]:
    """:func:`settle`, and the largest value of each named column, seen while writing: no job of its own.

    Only maxima are offered, as a task that runs twice does not change them. A frame without rows tells None.
    """
    seen = Observation()
    settled = settle(df.observe(seen, *[F.max(c).alias(name) for name, c in largest.items()]))
    return settled, {name: seen.get.get(name) for name in largest}


TASK_ROWS = 1 << 19  # fixed value: rows that a task sorts and groups


def task_count(*frames: DataFrame) -> int:
    """Partitions in which the longest of ``frames`` has about ``TASK_ROWS`` rows each; the session's number at least.

    Tasks that adaptive execution merges hold so many bytes as they were written, and short keys that repeat
    take ten times less room there than in a sort or a hash table. Each frame is counted by a job of its own.
    """
    least = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, *[-(-frame.count() // TASK_ROWS) for frame in frames])
