"""Running metrics over arriving rows. State is bounded by classes, markers or open windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialframes.functions.joins import null_safe_join
from spatialframes.operators.positivity import score_histogram
from spatialframes.operators.scoring import iqr_fences
from spatialframes.session import fresh_path


def run_available(stream: DataFrame, mode: str, out: str | None = None, log: str | None = None) -> DataFrame:
    """Process what has arrived and return the result table.

    ``append`` writes finished rows as they come; ``complete`` writes the full result of every batch
    beside the last one, which stands until the new one is whole, and returns the newest. ``out``
    holds the result, ``log`` offsets and state: a driver that is started again with the same folders
    goes on where the last one stopped. Without them both are new folders in the shared folder.
    """
    spark = stream.sparkSession
    out, log = out or fresh_path(spark, "stream"), log or fresh_path(spark, "stream-log")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        # a batch that is repeated after a failure writes its own folder again
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch-{number}"))
    writer.start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    try:
        newest = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{out}/batch-*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # nothing has arrived yet
        return spark.createDataFrame([], stream.schema)
    number = newest.agg(F.max(F.regexp_extract("path", "batch-([0-9]+)", 1).cast("long"))).first()[0]
    return spark.read.schema(stream.schema).parquet(f"{out}/batch-{number}")


def running_confusion(pairs: DataFrame) -> DataFrame:
    """Counts per (actual, pred) so far; the batch metrics take them from there."""
    return pairs.groupBy("actual", "pred").agg(F.count(F.lit(1)).alias("n"))


def running_counts(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    positive, truth = ~F.isnan("score") & (F.col("score") >= threshold), F.col("target") == 1
    return scores.groupBy("marker").agg(
        F.count_if(positive & truth).alias("tp"),
        F.count_if(positive & ~truth).alias("fp"),
        F.count_if(~positive & truth).alias("fn"),
        F.count_if(~positive & ~truth).alias("tn"),
    )


def running_histogram(scores: DataFrame, n_thresholds: int = 50) -> DataFrame:
    """Score bins per marker, enough to learn thresholds at any time without keeping the scores."""
    return score_histogram(scores, n_thresholds)


def running_moments(readings: DataFrame) -> DataFrame:
    return readings.groupBy("domain", "marker").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("s2")
    )


def dedup(feed: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """One row per key from an at-least-once feed; keys are forgotten after ``delay``."""
    return feed.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def qc_windows(feed: DataFrame, time: str, delay: str, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts of dropped channels and lost cells per window; ``slide`` makes the windows overlap."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return feed.withWatermark(time, delay).groupBy(window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("dropped").alias("n_dropped"), F.count_if("lost").alias("n_lost")
    )


def finished_fovs(feed: DataFrame, fov: Sequence[str], time: str, gap: str, delay: str) -> DataFrame:
    """Fields nothing more is expected of: a pause of ``gap`` closed their session, emitted once."""
    session = F.session_window(time, gap)
    closed = feed.withWatermark(time, delay).groupBy(*fov, session.alias("w")).agg(F.count(F.lit(1)).alias("n_cells"))
    return closed.select(*fov, F.col("w.start").alias("opened"), F.col("w.end").alias("closed"), "n_cells")


def fence_finished(finished: DataFrame, landed: DataFrame, fov: Sequence[str], time: str, score: str, k: float) -> DataFrame:
    """Fence of every finished session over the cells that landed in it.

    Cells are read from the table the feed lands in, so the quartiles are exact and the streaming
    state is one counter per open field. ``n_late`` counts cells of the session that were in the
    table but came too late for the stream.
    """
    joined = landed.join(finished, list(fov)).where((F.col(time) >= F.col("opened")) & (F.col(time) < F.col("closed")))
    group = [*fov, "opened", "closed"]
    total = joined.groupBy(*group).agg(F.count(F.lit(1)).alias("_landed"))
    fences = iqr_fences(joined, k, group, score)
    out = null_safe_join(null_safe_join(finished, total, group), fences, group)
    return out.withColumn("n_late", F.col("_landed") - F.col("n_cells")).drop("_landed")
