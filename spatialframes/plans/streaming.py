"""Queries on streams: the events arrive as a file stream, event time is ``ts``."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.operators import positivity
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6
from spatialframes.plans.registry import query, view
from spatialframes.session import fresh_path
from spatialframes.streaming import running as ops
from spatialframes.streaming import stateful as state


def arriving(spark, sf):
    schema = b.table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    k = F.get_json_object("props", "$.k").cast("int")
    return s.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", k)


view("feed", "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")


@query(
    "stream_confusion",
    "SELECT event_type AS actual, CASE WHEN k < 70 THEN event_type ELSE 'click' END AS pred, count(*) AS n FROM v_feed GROUP BY ALL",
)
def stream_confusion(spark, sf):
    guess = F.when(F.col("k") < 70, F.col("event_type")).otherwise(F.lit("click"))
    pairs = arriving(spark, sf).select(F.col("event_type").alias("actual"), guess.alias("pred"))
    return ops.run_available(ops.running_confusion(pairs), "complete")


def scored(spark, sf):
    return arriving(spark, sf).select(
        F.col("event_type").alias("marker"), (F.col("k") / 99).alias("score"), (F.col("value") > 50).cast("int").alias("target")
    )


@query(
    "stream_positivity",
    """SELECT event_type AS marker, count(*) FILTER (k / 99 >= 0.5 AND value > 50) AS tp, count(*) FILTER (k / 99 >= 0.5 AND value <= 50) AS fp,
       count(*) FILTER (k / 99 < 0.5 AND value > 50) AS fn, count(*) FILTER (k / 99 < 0.5 AND value <= 50) AS tn FROM v_feed GROUP BY ALL""",
)
def stream_positivity(spark, sf):
    return ops.run_available(ops.running_counts(scored(spark, sf)), "complete")


@query(
    "stream_thresholds",
    """, s AS (SELECT event_type AS marker, k / 99 AS score, value > 50 AS pos FROM v_feed),
       g AS (SELECT j, j * (0.98::DOUBLE / 49) + 0.01::DOUBLE AS t FROM range(0, 50) r(j)),
       f AS (SELECT marker, j, t, 2.0 * count(*) FILTER (score >= t AND pos) / nullif(count(*) FILTER (score >= t) + count(*) FILTER (pos), 0) AS f1 FROM s CROSS JOIN g GROUP BY ALL)
       SELECT marker, round(max(f1), 6) AS best_f1, round(arg_max(t, (f1, -j)), 6) AS threshold FROM f GROUP BY marker""",
)
def stream_thresholds(spark, sf):
    bins = ops.run_available(ops.running_histogram(scored(spark, sf)), "complete")
    return positivity.thresholds_of_histogram(bins).select("marker", r6("best_f1").alias("best_f1"), r6("threshold").alias("threshold"))


@query(
    "stream_moments",
    "SELECT k // 25 AS domain, event_type AS marker, count(*) AS n, round(sum(value), 6) AS s, round(sum(value * value), 4) AS s2 FROM v_feed GROUP BY ALL",
)
def stream_moments(spark, sf):
    readings = arriving(spark, sf).select(F.floor(F.col("k") / 25).cast("int").alias("domain"), F.col("event_type").alias("marker"), "value")
    out = ops.run_available(ops.running_moments(readings), "complete")
    return out.select("domain", "marker", "n", r6("s").alias("s"), F.round("s2", 4).alias("s2"))


@query("stream_dedup", "SELECT event_id, user_id, event_type, value FROM events")
def stream_dedup(spark, sf):
    twice = arriving(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = ops.run_available(ops.dedup(twice, ["event_id"], "ts", "1 hour"), "append")
    return out.select("event_id", "user_id", "event_type", "value")


WINDOW = """SELECT strftime(s, '%Y-%m-%d %H:%M') AS opened, count(*) AS n, count(*) FILTER (value < 5) AS n_dropped, count(*) FILTER (k < 3) AS n_lost FROM {rows}
       WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY s"""


def qc_feed(spark, sf):
    return arriving(spark, sf).select("ts", (F.col("value") < 5).alias("dropped"), (F.col("k") < 3).alias("lost"))


def windows(out):
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("opened"), "n", "n_dropped", "n_lost")


@query("stream_qc_window", WINDOW.format(rows="(SELECT *, date_trunc('hour', ts) AS s FROM v_feed)"))
def stream_qc_window(spark, sf):
    return windows(ops.run_available(ops.qc_windows(qc_feed(spark, sf), "ts", "10 minutes"), "append"))


@query(
    "stream_qc_sliding",
    WINDOW.format(rows="(SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - o * INTERVAL 30 MINUTE AS s FROM v_feed CROSS JOIN (VALUES (0), (1)) x(o))"),
)
def stream_qc_sliding(spark, sf):
    return windows(ops.run_available(ops.qc_windows(qc_feed(spark, sf), "ts", "10 minutes", slide="30 minutes"), "append"))


@query(
    "stream_fence",
    """, g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
       c AS (SELECT user_id AS fov_key, sid, min(ts) AS o, max(ts) + INTERVAL 1 DAY AS e, count(*) AS n_cells,
       CASE WHEN count(*) >= 4 THEN quantile_cont(value, 0.25) - 0.2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) END AS fence FROM s GROUP BY ALL)
       SELECT fov_key, strftime(o, '%Y-%m-%d %H:%M:%S') AS opened, n_cells, 0::BIGINT AS n_late, round(fence, 6) + 0 AS fence FROM c WHERE e <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_fence(spark, sf):
    feed = arriving(spark, sf).select(F.col("user_id").alias("fov_key"), "ts")
    done = ops.run_available(ops.finished_fovs(feed, ["fov_key"], "ts", "1 day", "1 hour"), "append")
    landed = b.table(spark, sf, "events").select(F.col("user_id").alias("fov_key"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = ops.fence_finished(done, landed, ["fov_key"], "ts", "value", 0.2)
    return out.select("fov_key", F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"), "n_cells", "n_late", r6("fence").alias("fence"))


# --- state of its own, and rows that come late --------------------------------------------------------------


@query(
    "stream_fence_state",
    """, g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
       c AS (SELECT user_id AS fov_key, sid, min(ts) AS o, max(ts) + INTERVAL 1 DAY AS e, count(*) AS n_cells,
       CASE WHEN count(*) >= 4 THEN quantile_cont(value, 0.25) - 0.2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) END AS fence FROM s GROUP BY ALL)
       SELECT fov_key, strftime(o, '%Y-%m-%d %H:%M:%S') AS opened, strftime(e, '%Y-%m-%d %H:%M:%S') AS closed, n_cells, round(fence, 6) + 0 AS fence FROM c
       WHERE e <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_fence_state(spark, sf):
    feed = arriving(state.stateful_session(spark), sf).select(F.col("user_id").alias("fov_key"), "ts", "value")
    done = ops.run_available(state.fence_fields(feed, ["fov_key"], "ts", "value", 86_400, "1 hour", 0.2), "append")
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("opened", "closed")]
    return done.select("fov_key", *shown, "n_cells", r6("fence").alias("fence"))


PARTS = 4


def landed_in_parts(spark, sf):
    """The events in four files that land one after the other, each over the whole time, every fifth event twice."""
    path = fresh_path(spark, "landing")
    e = b.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    # the first file ends early, so that the ones after it are late in part only
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    number = F.when(early, F.col("event_id") % 2).otherwise(2 + F.col("event_id") % 2)
    again = F.when(F.col("event_id") % 5 == 0, F.array(number, F.lit(PARTS - 1).cast("bigint"))).otherwise(F.array(number))
    e = e.withColumn("part", F.explode(again))
    for i in range(PARTS):
        e.where(F.col("part") == i).drop("part").coalesce(1).write.parquet(f"{path}/part={i}")
    stream = spark.readStream.schema(e.drop("part").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return stream.parquet(path)


@query(
    "stream_late",
    """, a AS (SELECT event_id, ts, value, k, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN event_id % 2 ELSE 2 + event_id % 2 END AS part FROM v_feed),
       f AS (SELECT * FROM a UNION ALL SELECT event_id, ts, value, k, 3 FROM a WHERE event_id % 5 = 0),
       m AS (SELECT p AS part, max(ts) - INTERVAL 1 HOUR AS mark FROM range(0, 5) r(p) LEFT JOIN f ON f.part < p GROUP BY p),
       t AS (SELECT f.*, date_trunc('day', ts) AS w, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark, false) AS late FROM f JOIN m USING (part)),
       r AS (SELECT *, row_number() OVER (PARTITION BY event_id, late ORDER BY part) AS copy FROM t)
       SELECT strftime(w, '%Y-%m-%d') AS opened, count(*) FILTER (NOT late AND copy = 1) AS n, count(*) FILTER (NOT late AND copy = 1 AND value < 5) AS n_dropped,
       count(*) FILTER (NOT late AND copy = 1 AND k < 3) AS n_lost, count(*) FILTER (late) AS n_late
       FROM r GROUP BY w HAVING w + INTERVAL 1 DAY <= (SELECT mark FROM m WHERE part = 4)""",
)
def stream_late(spark, sf):
    flags = {"n_dropped": F.col("value") < 5, "n_lost": F.col("k") < 3}
    out = state.run_with_late(landed_in_parts(spark, sf), "ts", 3600, "1 day", flags, ["event_id"])
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("opened"), "n", "n_dropped", "n_lost", "n_late")
