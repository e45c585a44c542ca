"""Streams that keep state of their own: fences of finished fields, and counts of rows that came too late."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spatialframes.session import fresh_path

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """The same session if its state spills to disk already, else one beside it that does.

    Timers need that store; the caller's settings stay as they are. Read the stream from this session.
    """
    if spark.conf.get(_STORE, "") == _ROCKS:
        return spark
    other = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        other.conf.set(name, spark.conf.get(name))
    other.conf.set(_STORE, _ROCKS)
    return other


# --- fences of finished fields ------------------------------------------------------------------------------


def _fence(values: np.ndarray, counts: np.ndarray, k: float) -> float | None:
    """Lower quartile less ``k`` ranges, from finite values with their counts; none for fewer than four."""
    n = int(counts.sum())
    if n < 4:
        return None
    order = np.argsort(values)
    values, upto = values[order], np.cumsum(counts[order])

    def quantile(p: float) -> float:
        at = (n - 1) * p
        low, high = (values[np.searchsorted(upto, np.floor(at) + i, side="right")] if np.floor(at) + i < n else values[-1] for i in (0, 1))
        return float(low + (high - low) * (at - np.floor(at)))

    return quantile(0.25) - k * (quantile(0.75) - quantile(0.25))


_BUCKETS = 1024  # fields share the keys of the state, as a call to the store costs more than the visits of hundreds of fields


class _Fences(StatefulProcessor):
    """Open visits of the fields of a bucket: their span, and how often each score came, in chunks that are only appended to.

    A visit ends when nothing came for ``gap`` of event time. One timer stands at the end of the bucket's first visit to
    end; when the watermark reaches it, every visit that is over has its row, its state goes, and the timer moves on.
    """

    def __init__(self, gap: int, k: float, fov: Sequence[T.StructField]):
        self.gap, self.k, self.fov = gap, k, list(fov)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = T.ArrayType(T.LongType())
        visits = [T.StructField("due", T.LongType()), *[T.StructField(f"field_{i}", T.ArrayType(c.dataType)) for i, c in enumerate(self.fov)]]
        visits += [T.StructField(c, longs) for c in ("ids", "starts", "lasts", "sizes")] + [T.StructField("parts", T.ArrayType(longs))]
        self.visits = handle.getValueState("visits", T.StructType(visits))
        self.chunks = handle.getListState("chunks", "id long, scores array<double>, counts array<long>")

    def _opened(self) -> tuple[int | None, dict]:
        """When the timer stands, and by field the visits ``id, start, last, n, parts``."""
        value, opened = self.visits.get(), {}
        if value is None:
            return None, opened
        due, *columns = value
        fields, visits = zip(*columns[: len(self.fov)], strict=True), zip(*columns[len(self.fov) :], strict=True)
        for field, visit in zip(fields, visits, strict=True):
            opened.setdefault(field, []).append(visit)
        return due, opened

    def _keep(self, opened: dict, standing: int | None) -> None:
        rows = [(*field, *visit) for field, visits in opened.items() for visit in visits]
        due = min((-(-(r[-3] + self.gap) // 1000) for r in rows), default=None)
        if standing is not None and standing != due:
            self.handle.deleteTimer(standing)
        if due is None:
            self.visits.clear()
            return
        if standing != due:
            self.handle.registerTimer(due)
        self.visits.update((due, *[list(c) for c in zip(*rows, strict=True)]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came, names = {}, [c.name for c in self.fov]
        for r in rows:
            score = math.nan if r.event_score is None else r.event_score
            came.setdefault(tuple(r[c] for c in names), []).append((r.event_micros, score))
        if not came:
            return
        standing, opened = self._opened()
        fresh, added = max((v[0] for visits in opened.values() for v in visits), default=0), []
        for field, cells in came.items():
            cells.sort()
            visits = list(opened.get(field, []))
            cuts = [i for i in range(1, len(cells)) if cells[i][0] - cells[i - 1][0] >= self.gap]
            for start, stop in zip([0, *cuts], [*cuts, len(cells)], strict=True):
                fresh += 1
                low, high, n, parts, apart = cells[start][0], cells[stop - 1][0], stop - start, [fresh], []
                for visit in visits:
                    _, first, last, m, ids = visit
                    if low < last + self.gap and first < high + self.gap:
                        low, high, n, parts = min(low, first), max(high, last), n + m, [*ids, *parts]
                    else:
                        apart.append(visit)
                visits = [*apart, (fresh, low, high, n, parts)]
                found = Counter(score for _, score in cells[start:stop] if math.isfinite(score))
                added.append((fresh, list(found), list(found.values())))
            opened[field] = visits
        self.chunks.appendList(added)
        self._keep(opened, standing)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # the store has taken this timer away already
        _, opened = self._opened()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        over = lambda v: v[2] + self.gap <= passed
        done = [(field, v) for field, visits in opened.items() for v in visits if over(v)]
        owner = {part: v[0] for _, v in done for part in v[4]}
        own, kept = {v[0]: [] for _, v in done}, []
        for chunk in self.chunks.get():
            own.get(owner.get(chunk[0]), kept).append(tuple(chunk))
        self.chunks.put(kept) if kept else self.chunks.clear()
        self._keep({field: [v for v in visits if not over(v)] for field, visits in opened.items()}, None)
        names = [*[c.name for c in self.fov], "opened", "closed", "n_cells", "fence"]
        for field, (number, start, last, n, _) in done:
            values = np.concatenate([np.asarray(c[1], dtype="float64") for c in own[number]])
            counts = np.concatenate([np.asarray(c[2], dtype="int64") for c in own[number]])
            yield Row(**dict(zip(names, (*field, start, last + self.gap, n, _fence(values, counts, self.k)), strict=True)))


def fence_fields(feed: DataFrame, fov: Sequence[str], time: str, score: str, gap_seconds: int, delay: str, k: float) -> DataFrame:
    """One row per finished visit of a field, ``opened, closed, n_cells, fence``, once the watermark has passed its end.

    The fence is that of :func:`~spatialframes.operators.scoring.iqr_fences`, exact, from counts of the scores kept as
    state: no table of landed cells is read. State is that of fields that are still open, and lies in the store of
    :func:`stateful_session`. Rows behind the watermark change nothing.
    """
    micros = F.unix_micros(F.col(time))
    rows = feed.withWatermark(time, delay).select(*fov, time, micros.alias("event_micros"), F.col(score).cast("double").alias("event_score"))
    keys = [rows.schema[c] for c in fov]
    numbers = [T.StructField(c, T.LongType()) for c in ("opened", "closed", "n_cells")]
    schema = T.StructType([*keys, *numbers, T.StructField("fence", T.DoubleType())])
    dealt = rows.withColumn("_bucket", F.pmod(F.hash(*fov), F.lit(_BUCKETS)))
    done = dealt.groupBy("_bucket").transformWithState(_Fences(gap_seconds * 1_000_000, k, keys), schema, "append", "EventTime")
    at = lambda c: F.timestamp_micros(F.col(c)).alias(c)
    return done.select(*fov, at("opened"), at("closed"), "n_cells", "fence")


# --- rows behind the watermark ------------------------------------------------------------------------------


def _written(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """Parts of all batches so far, or of those before one; a repeated batch has replaced its part."""
    try:
        parts = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return parts if before is None else parts.where(F.col("batch") < before)


def run_with_late(
    stream: DataFrame, time: str, delay_seconds: int, width: str, counts: dict[str, Column], ids: Sequence[str] = (), out: str | None = None, log: str | None = None
) -> DataFrame:
    """Counts per window with the rows that came behind the watermark told apart: ``w, n, <counts>, n_late``.

    The watermark of a batch is the latest time of all earlier batches less the delay; a row is late when its window
    had closed by then. Late rows are counted in ``n_late`` and nowhere else. With ``ids`` a row
    that repeats an earlier one on time counts once; ids are kept while their window is open.

    A batch writes one small part: its windows, the latest time it has seen, and the open ids. A batch that is
    repeated after a failure writes the same part again, and a driver that is started again with the same
    folders goes on. Closed windows are those that end at or before the final watermark, and are returned.
    """
    spark = stream.sparkSession
    out, log = out or fresh_path(spark, "late"), log or fresh_path(spark, "late-log")
    window = F.window(time, width)
    ids = list(ids)

    def mark(parts: DataFrame | None) -> Column:
        latest = None if parts is None else parts.agg(F.max("last")).first()[0]
        return F.lit(None).cast("timestamp") if latest is None else F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay_seconds} SECONDS")

    def one(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = _written(session, out, number)
        at = mark(earlier)
        rows = batch.select(window.alias("w"), F.col(time).alias("at"), *ids, *[c.cast("boolean").alias(n) for n, c in counts.items()])
        rows = rows.withColumn("late", F.coalesce(F.col("w.end") <= at, F.lit(False)))
        if ids:
            rows = rows.withColumn("again", ~F.col("late") & (F.row_number().over(Window.partitionBy(*ids, "late").orderBy("at")) > 1))
            if earlier is not None:
                known = earlier.where(F.col("kind") == "id").where(F.col("w.end") > at).select(*ids).distinct()
                rows = rows.join(known.withColumn("known", F.lit(True)), ids, "left").withColumn("again", F.col("again") | (~F.col("late") & F.col("known").isNotNull()))
        else:
            rows = rows.withColumn("again", F.lit(False))
        fresh = ~F.col("late") & ~F.col("again")
        sums = [F.count_if(fresh & F.col(n)).alias(n) for n in counts]
        per = rows.groupBy("w").agg(F.count_if(fresh).alias("n"), *sums, F.count_if("late").alias("n_late"), F.max("at").alias("last"))
        part = per.withColumn("kind", F.lit("window"))
        if ids:
            part = part.unionByName(rows.where(fresh).select("w", *ids, F.lit("id").alias("kind")), allowMissingColumns=True)
        part.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    parts = _written(spark, out)
    whole = ["n", *counts, "n_late"]
    if parts is None:
        return spark.createDataFrame([], T.StructType([T.StructField("w", T.StructType([T.StructField(c, T.TimestampType()) for c in ("start", "end")])), *[T.StructField(c, T.LongType()) for c in whole]]))
    found = parts.where(F.col("kind") == "window").groupBy("w").agg(*[F.sum(c).alias(c) for c in whole])
    return found.where(F.col("w.end") <= mark(parts))
