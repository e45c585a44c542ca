import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from spatialframes.streaming import running as ops
from spatialframes.streaming import stateful as state

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, fov_key string, ts timestamp, score double"


def feed(spark, path, *batches):
    """One file per micro-batch, in order."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(n, f, T0 + dt.timedelta(minutes=m), s) for n, f, m, s in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(path / f"b{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return stream.parquet(str(path)), spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(path))


def test_totals_run_over_batches(spark, tmp_path):
    stream, _ = feed(spark, tmp_path, [(1, "a", 0, 0.2), (2, "a", 1, 0.9)], [(3, "b", 2, 0.9)], [(4, "a", 3, 0.1)])
    pairs = stream.select(F.col("fov_key").alias("actual"), F.when(F.col("score") > 0.5, "a").otherwise("b").alias("pred"))
    got = {(r.actual, r.pred): r.n for r in ops.run_available(ops.running_confusion(pairs), "complete").collect()}
    assert got == {("a", "a"): 1, ("a", "b"): 2, ("b", "a"): 1}


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    stream, _ = feed(spark, tmp_path, [(1, "a", 0, 0.2), (2, "a", 1, 0.9)], [(1, "a", 0, 0.2), (3, "a", 2, 0.9)])
    out = ops.run_available(ops.dedup(stream, ["id"], "ts", "1 hour"), "append")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    stream, _ = feed(spark, tmp_path, [(1, "a", 0, 0.2), (2, "a", 59, 0.9), (3, "a", 61, 0.9)], [(4, "a", 135, 0.1)])
    flags = stream.select("ts", (F.col("score") < 0.5).alias("dropped"), F.lit(False).alias("lost"))
    out = ops.run_available(ops.qc_windows(flags, "ts", "10 minutes"), "append")
    assert sorted((r.w.start.hour, r.n, r.n_dropped) for r in out.collect()) == [(0, 2, 1), (1, 1, 0)]


def test_fence_once_per_finished_field_with_late_cells_counted(spark, tmp_path):
    scores = [0.1, 0.3, 0.5, 0.7, 0.9]
    stream, landed = feed(
        spark,
        tmp_path,
        [(i, "a", i, s) for i, s in enumerate(scores)] + [(9, "b", 0, 0.5)],
        [(20, "c", 500, 0.5)],
        [(22, "c", 501, 0.5)],  # the watermark reaches the sessions of a and b here
        [(21, "a", 2, 0.6)],
        [(23, "c", 505, 0.5)],
    )
    done = ops.run_available(ops.finished_fovs(stream, ["fov_key"], "ts", "1 hour", "10 minutes"), "append")
    assert sorted(r.fov_key for r in done.collect()) == ["a", "b"]
    out = {r.fov_key: r for r in ops.fence_finished(done, landed, ["fov_key"], "ts", "score", 0.2).collect()}
    assert (out["a"].n_cells, out["a"].n_late) == (5, 1) and out["a"].fence is not None
    assert (out["b"].n_cells, out["b"].n_late, out["b"].fence) == (1, 0, None)


def test_an_empty_source_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "nothing").mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "nothing"))
    pairs = stream.select(F.col("fov_key").alias("actual"), F.col("fov_key").alias("pred"))
    assert ops.run_available(ops.running_confusion(pairs), "complete").collect() == []
    late = state.run_with_late(stream, "ts", 60, "1 hour", {"low": F.col("score") < 0.5})
    assert late.columns == ["w", "n", "low", "n_late"] and late.count() == 0


def fences(spark, path, folder):
    session = state.stateful_session(spark)
    stream = session.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))
    done = state.fence_fields(stream, ["fov_key"], "ts", "score", 3600, "10 minutes", 0.2)
    rows = ops.run_available(done, "append", str(folder / "out"), str(folder / "log")).collect()
    assert len(rows) == len({(r.fov_key, r.opened) for r in rows})
    at = lambda t: int((t - T0).total_seconds() // 60)
    return {(r.fov_key, at(r.opened)): (at(r.closed), r.n_cells, r.fence and round(r.fence, 9)) for r in rows}


def test_a_fence_when_a_field_is_finished_and_after_a_restart(spark, tmp_path):
    scores = [0.1, 0.3, 0.5, 0.7, 0.9]
    want = round(float(np.quantile(scores, 0.25) - 0.2 * (np.quantile(scores, 0.75) - np.quantile(scores, 0.25))), 9)
    path, folder = tmp_path / "in", tmp_path / "run"
    # b is seen twice, a day apart, in one file; the rows of c meet out of order, the last one joins two visits
    feed(
        spark,
        path,
        [(i, "a", i, s) for i, s in enumerate(scores)] + [(10, "b", 0, 0.5), (11, "b", 1440, float("nan"))] + [(12, "c", 1400, 0.1), (13, "c", 1470, 0.3)],
        [(14, "c", 1440, 0.5), (15, "c", 1441, 0.7), (16, "c", 1500, 0.9)],
        [(17, "a", 3, 9.0)],
    )
    got = fences(spark, path, folder)
    # the second file closed the visits of the first day, so the late row of a changes nothing
    assert got == {("a", 0): (64, 5, want), ("b", 0): (60, 1, None)}
    more = spark.createDataFrame([(20, "d", T0 + dt.timedelta(days=2), 0.5)], SCHEMA)
    more.coalesce(1).write.mode("append").parquet(str(path / "b3"))
    got = fences(spark, path, folder)
    assert got[("c", 1400)] == (1560, 5, want) and got[("b", 1440)] == (1500, 1, None)
    assert got[("a", 0)] == (64, 5, want) and len(got) == 4
    assert fences(spark, path, folder) == got


def test_rows_behind_the_watermark_are_counted_by_window(spark, tmp_path):
    path, folder = tmp_path / "in", tmp_path / "run"
    run = lambda: state.run_with_late(
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path)),
        "ts", 600, "1 hour", {"low": F.col("score") < 0.5}, ["id"], str(folder / "out"), str(folder / "log"),
    )
    feed(
        spark,
        path,
        [(1, "a", 0, 0.2), (1, "a", 0, 0.2), (2, "a", 59, 0.9), (3, "a", 65, 0.9)],
        [(2, "a", 59, 0.9), (4, "a", 10, 0.1), (5, "a", 140, 0.1)],  # the first window is open still: 65 - 10 < 60
        [(6, "a", 20, 0.1), (1, "a", 0, 0.2), (3, "a", 65, 0.9), (7, "a", 70, 0.1)],  # at 130 the first two windows are closed
    )
    seen = lambda: sorted((r.w.start.hour, r.n, r.low, r.n_late) for r in run().collect())
    assert seen() == [(0, 3, 2, 2), (1, 1, 0, 2)]
    assert seen() == [(0, 3, 2, 2), (1, 1, 0, 2)]
    spark.createDataFrame([(8, "a", T0 + dt.timedelta(hours=9), 0.5), (9, "a", T0, 0.5)], SCHEMA).coalesce(1).write.parquet(str(path / "b3"))
    assert seen() == [(0, 3, 2, 3), (1, 1, 0, 2), (2, 1, 1, 0)]


def test_the_late_query_has_late_rows(spark):
    from spatialframes.plans.streaming import stream_late

    rows = stream_late(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_late for r in rows) > 0 and sum(r.n for r in rows) > 0


def test_fields_that_share_a_state_key_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "_BUCKETS", 1)
    path, folder = tmp_path / "in", tmp_path / "run"
    first = [(0, f"f{n}", n, s / 10) for n in range(5) for s in range(4 + n)] + [(1, None, 200, 0.5), (2, "f0", 300, 0.5)]
    feed(spark, path, first, [(3, "f0", 301, 0.7), (4, "f9", 305, 0.1)], [(5, "f9", 306, 0.1)])
    got = fences(spark, path, folder)
    fence = lambda n: round(float(np.quantile(x := np.arange(4 + n) / 10, 0.25) - 0.2 * (np.quantile(x, 0.75) - np.quantile(x, 0.25))), 9)
    assert got == {(f"f{n}", n): (n + 60, 4 + n, fence(n)) for n in range(5)} | {(None, 200): (260, 1, None)}
    more = spark.createDataFrame([(20, "d", T0 + dt.timedelta(days=2), 0.5)], SCHEMA)
    more.coalesce(1).write.mode("append").parquet(str(path / "b3"))
    assert fences(spark, path, folder) == got | {("f0", 300): (361, 2, None), ("f9", 305): (366, 2, None)}
