"""Tiles with halos, resampling and windows of tiles against whole images in numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframes.operators import patches, phenotype, signal, tile_ops, tile_patches, tile_signal
from spatialframes.operators.features import centroids
from spatialframes.sources.tiles import pixels_to_tiles, tiles_to_pixels

SHAPES = {"a": (11, 7), "b": (1, 9), "c": (6, 6)}


def picture(shape, seed):
    return np.random.default_rng(seed).normal(size=shape).round(3)


@pytest.fixture(scope="module")
def fields(spark):
    rows, masks = [], []
    for k, (name, shape) in enumerate(SHAPES.items()):
        labels = np.random.default_rng(50 + k).integers(0, 4, size=shape)
        masks += [(name, r, c, int(labels[r, c])) for r in range(shape[0]) for c in range(shape[1])]
        for j, channel in enumerate(["x", "y"]):
            image = picture(shape, 10 * k + j)
            rows += [(name, channel, r, c, float(image[r, c])) for r in range(shape[0]) for c in range(shape[1])]
    pixels = spark.createDataFrame(rows, "fov_key string, channel string, row int, col int, value double").cache()
    mask = spark.createDataFrame(masks, "fov_key string, row int, col int, cell_id long").cache()
    return pixels, mask


def labels_of(mask, h, w):
    as_pixels = mask.select("fov_key", F.lit("mask").alias("channel"), "row", "col", F.col("cell_id").alias("value"))
    return pixels_to_tiles(as_pixels, h, w).withColumnRenamed("values", "labels")


def by_place(df, value="value"):
    return {(r["fov_key"], r["channel"], r["row"], r["col"]): r[value] for r in df.collect()}


@pytest.mark.parametrize(("h", "w"), [(4, 3), (2, 2), (20, 20), (1, 5)])
@pytest.mark.parametrize("size", [3, 4, 1])
def test_median(fields, h, w, size):
    pixels, _ = fields
    got = by_place(tiles_to_pixels(tile_ops.denoise_tiles(pixels_to_tiles(pixels, h, w), "median", size)))
    for k, (name, shape) in enumerate(SHAPES.items()):
        image = picture(shape, 10 * k)
        full = np.pad(image, ((size // 2, size - 1 - size // 2),) * 2, mode="symmetric")
        for r in range(shape[0]):
            for c in range(shape[1]):
                assert got[name, "x", r, c] == np.sort(full[r : r + size, c : c + size].ravel())[size * size // 2]
    assert len(got) == pixels.count()


@pytest.mark.parametrize(("h", "w"), [(4, 3), (20, 20), (1, 5)])
def test_gaussian_equals_the_pixel_form(fields, h, w):
    pixels, _ = fields
    want = by_place(signal.denoise(pixels, "gaussian", 3))
    got = by_place(tiles_to_pixels(tile_ops.denoise_tiles(pixels_to_tiles(pixels, h, w), "gaussian", 3)))
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("scale", [0.31, 0.5, 0.97, 1.0, 1.6, 2.5])
@pytest.mark.parametrize(("h", "w"), [(4, 3), (20, 20)])
def test_resampling_equals_the_pixel_form(spark, fields, scale, h, w):
    pixels, mask = fields
    scales = spark.createDataFrame([(n, scale) for n in SHAPES], "fov_key string, scale double")
    out = tile_ops.resample_bilinear_tiles(pixels_to_tiles(pixels, h, w), scales)
    assert by_place(tiles_to_pixels(out)) == pytest.approx(by_place(patches.resample_bilinear(pixels, scales)), abs=1e-12)
    labels = tile_ops.resample_nearest_tiles(labels_of(mask, h, w), scales).withColumnRenamed("labels", "values")
    want = by_place(patches.resample_nearest(mask, scales).withColumn("channel", F.lit("mask")), "cell_id")
    assert by_place(tiles_to_pixels(labels)) == want


def test_a_gap_raises(fields):
    pixels, _ = fields
    holed = pixels_to_tiles(pixels.where("not (fov_key = 'a' and row = 5 and col = 2)"), 4, 3)
    with pytest.raises(Exception, match="missing pixels"):
        tile_ops.denoise_tiles(holed).collect()
    lost = pixels_to_tiles(pixels, 4, 3).where("not (fov_key = 'a' and tile_r = 1 and tile_c = 1)")
    with pytest.raises(Exception, match="missing neighbours"):
        tile_ops.denoise_tiles(lost).collect()
    with pytest.raises(ValueError, match="unknown denoise kind"):
        tile_ops.denoise_tiles(lost, "mean")


def exchanges(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    return [line for line in final.splitlines() if "Exchange hashpartitioning" in line]


def test_no_pixel_row_meets_a_shuffle(spark, fields, tmp_path):
    pixels, mask = fields
    pixels_to_tiles(pixels, 4, 3).write.parquet(str(tmp_path / "t"))
    tiles = spark.read.parquet(str(tmp_path / "t"))
    n = tiles.count()
    for df in (tile_ops.denoise_tiles(tiles, "median", 3), tile_ops.denoise_tiles(tiles, "gaussian", 2)):
        assert len(exchanges(df)) == 1
    sent = tile_ops.halos(tiles, 1).select(F.explode("pieces").alias("p"))
    # a tile and eight strips at most, whatever the number of its pixels
    assert sent.count() <= 9 * n
    largest = sent.where("p.rows = 1 or p.cols = 1").agg(F.max(F.size("p.values"))).first()[0]
    assert largest <= 4 * 3


def test_resize_weights():
    assert np.allclose(tile_patches.resize_weights(6, 6), np.eye(6))
    half = tile_patches.resize_weights(8, 4)
    assert half.shape == (4, 8) and np.allclose(half.sum(axis=1), 1)
    assert np.allclose(half, half[::-1, ::-1])
    # growing: nothing is smoothed, and beyond the ends the axis is mirrored
    grown = tile_patches.resize_weights(2, 4)
    assert np.allclose(grown, [[0.75, 0.25], [0.75, 0.25], [0.25, 0.75], [0.25, 0.75]])
    assert tile_patches.nearest_index(6, 3).tolist() == [1, 3, 5] and tile_patches.nearest_index(2, 4).tolist() == [0, 0, 1, 1]


@pytest.mark.parametrize(("h", "w", "crop"), [(4, 3, 6), (20, 20, 5), (2, 2, 4)])
def test_windows(spark, fields, h, w, crop):
    pixels, mask = fields
    far = spark.createDataFrame([("a", 99, 500.0, -70.0), ("a", 2, 0.0, 0.0), ("nowhere", 1, 1.0, 1.0)], "fov_key string, cell_id long, c_row double, c_col double")
    cells = centroids(mask).drop("area").unionByName(far.where("cell_id = 99 or fov_key = 'nowhere'"))
    got = {(r["fov_key"], r["cell_id"]): r for r in tile_patches.cell_windows(cells, pixels_to_tiles(pixels, h, w), labels_of(mask, h, w), crop).collect()}
    assert len(got) == cells.count()
    images = {(n, c): picture(s, 10 * k + j) for k, (n, s) in enumerate(SHAPES.items()) for j, c in enumerate(["x", "y"])}
    labels = {n: np.random.default_rng(50 + k).integers(0, 4, size=s) for k, (n, s) in enumerate(SHAPES.items())}
    for (name, cell), r in got.items():
        if name == "nowhere" or cell == 99:
            assert not any(r["stack"]) and not any(r["self_mask"]) and not any(r["distance"])
            assert r["panel"] == ([] if name == "nowhere" else ["x", "y"])
            continue
        at = np.argwhere(labels[name] == cell)
        r0, c0 = (int(np.round(m)) - crop // 2 for m in at.mean(axis=0))
        take = lambda image: np.pad(image, crop + 20)[crop + 20 + r0 :, crop + 20 + c0 :][:crop, :crop]  # noqa: E731, B023
        own = take(labels[name]) == cell
        assert r["panel"] == ["x", "y"]
        want = np.stack([take(images[name, c]) * own for c in ("x", "y")])
        assert np.allclose(np.reshape(r["stack"], want.shape), want)
        assert np.array_equal(np.reshape(r["self_mask"], own.shape) > 0, own)
        assert np.array_equal(np.reshape(r["neighbor_mask"], own.shape) > 0, (take(labels[name]) != 0) & ~own)
        assert np.allclose(np.reshape(r["distance"], own.shape), patches.distance_to_edge(own))


def test_windows_refuse_a_tile_without_a_channel(fields):
    pixels, mask = fields
    lost = pixels_to_tiles(pixels, 4, 3).where("not (fov_key = 'a' and channel = 'y' and tile_r = 1 and tile_c = 1)")
    with pytest.raises(Exception, match="without some channel"):
        tile_patches.cell_windows(centroids(mask), lost, labels_of(mask, 4, 3), 6).collect()


def test_scores_pad_only_inside_a_batch(spark):
    rows = [("a", 1, [3, 0], [1.0] * 4 + [2.0] * 4), ("a", 2, [5], [4.0] * 4), ("b", 3, [], [])]
    planes = [f"array(1d, 0d, 0d, 1d) as {p}" for p in tile_patches.PLANES]
    cells = spark.createDataFrame(rows, "fov_key string, cell_id long, positions array<int>, stack array<double>").selectExpr("*", *planes).coalesce(1)

    def load():
        def model(sample, context, places, absent):
            assert sample.shape[1:] == (2, 1, 2, 2) and context.shape[1:] == (3, 2, 2)
            assert ((places == -1) == absent).all() and (sample[absent] == -1.0).all()
            kept = np.where(absent[:, :, None, None, None], 0.0, sample)
            return np.stack([kept.sum(axis=(1, 2, 3, 4)), np.where(absent, 0, places).sum(axis=1)], axis=1)

        return model

    got = {r["cell_id"]: r["logits"] for r in tile_patches.score_windows(cells, load, 2).collect()}
    assert got == {1: [12.0, 3.0], 2: [16.0, 5.0], 3: [0.0, 0.0]}


def panel_of(spark):
    markers = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "name string, idx int")
    aliases = spark.createDataFrame([("why", "y", 0)], "alias string, target string, ord long")
    channels = spark.createDataFrame([(n, i, c) for n in SHAPES for i, c in enumerate(["why", "x", "DAPI"])], "fov_key string, pos int, channel string")
    return channels, markers, aliases


def field_tiles(pixels, factor=1.0):
    named = F.when(F.col("channel") == "y", F.lit("why")).otherwise(F.col("channel"))
    return pixels_to_tiles(pixels.withColumn("channel", named).withColumn("value", F.abs("value") * factor), 4, 3)


def test_predict_windows(spark, fields):
    def window_totals():
        def model(sample, context, positions, absent):
            assert positions.tolist() == [[1, 0]] * len(positions) and not absent.any()
            return np.stack([sample.sum(axis=(2, 3, 4))[:, 0], context.sum(axis=(2, 3))[:, 0]], axis=1)

        return model

    pixels, mask = fields
    fovs = spark.createDataFrame([(n, 0.5) for n in SHAPES], "fov_key string, native_mpp double")
    args = (labels_of(mask, 4, 3), *panel_of(spark)[:1], fovs, *panel_of(spark)[1:], window_totals, ["first", "second"])
    out = phenotype.predict_windows(field_tiles(pixels), *args, crop=6).collect()
    assert {(r["fov_key"], r["cell_id"]) for r in out} == {(r[0], r[1]) for r in mask.where("cell_id <> 0").select("fov_key", "cell_id").distinct().collect()}
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 and not r["abstained"] for r in out)
    with pytest.raises(ValueError, match="breaks the contract"):
        phenotype.predict_windows(field_tiles(pixels), *args, crop=6, preprocess=lambda t: t)
    with pytest.raises(ValueError, match="not finite"):
        phenotype.predict_windows(field_tiles(pixels, float("nan")), *args, crop=6)
    nothing = lambda: lambda sample, *rest: np.full((len(sample), 2), np.nan)
    with pytest.raises(ValueError, match="probabilities that are not finite"):
        phenotype.predict_windows(field_tiles(pixels), *args[:-2], nothing, ["first", "second"], crop=6)


def test_tiles_are_conditioned_like_pixels(fields):
    pixels, _ = fields
    for p in (99.9, 50.0, 0.0, 100.0):
        want = by_place(signal.clip_and_normalize(pixels, p))
        assert by_place(tiles_to_pixels(tile_signal.clip_and_normalize(pixels_to_tiles(pixels, 4, 3), p))) == pytest.approx(want, abs=1e-12)
    flat = pixels.withColumn("value", F.when(F.col("channel") == "x", F.lit(0.0)).otherwise(F.lit(7.0)))
    got = by_place(tiles_to_pixels(tile_signal.clip_and_normalize(pixels_to_tiles(flat, 4, 3), 99.0)))
    assert set(got.values()) == {0.0} and len(got) == pixels.count()


def test_a_profile_tells_range_zeros_and_what_is_not_finite(spark):
    rows = [("f", "a", v) for v in (0.0, 0.0, 3.0, -2.0)] + [("f", "b", 0.0), ("f", "c", float("nan")), ("f", "c", None), ("f", "c", 1.0)]
    known = signal.profile(spark.createDataFrame(rows, "fov_key string, channel string, value double"))
    spans = {r["channel"]: (r["_min"], r["_max"]) for r in signal.channel_range(known).collect()}
    assert spans == {"a": (-2.0, 3.0), "b": (0.0, 0.0), "c": (1.0, 1.0)}
    assert known.where("_octave is null").select("channel", "_count").collect() == [("c", 2)]
    assert known.where("channel = 'a' and _octave = 0").first()["_count"] == 2


def test_windows_are_scored_by_bytes_and_not_by_rows(spark):
    def load():
        return lambda sample, context, positions, absent: np.stack([np.full(len(sample), float(len(sample))), sample.sum(axis=(1, 2, 3, 4)), (~absent).sum(axis=1)], axis=1)

    depth = F.when(F.col("cell_id") % 3 == 0, 2).otherwise(1)
    cells = spark.range(600, numPartitions=1).select(F.col("id").alias("cell_id")).withColumn("positions", F.array_repeat(F.lit(0), depth))
    cells = cells.withColumn("stack", F.array_repeat(F.col("cell_id").cast("double"), depth * 1024))
    cells = cells.select("*", *[F.array_repeat(F.lit(0.0), 1024).alias(c) for c in ("self_mask", "neighbor_mask", "distance")])
    rows = tile_patches.score_windows(cells, load, 32).collect()
    assert [r.cell_id for r in rows] == list(range(600))
    # 600 cells of two channels and three planes take 24 MB; a batch takes 8 MB
    assert max(r.logits[0] for r in rows) <= 205
    one = [r for r in rows if r.cell_id % 3 == 0]
    assert all(r.logits[1] == 2048 * r.cell_id and r.logits[2] == 2 for r in one)
