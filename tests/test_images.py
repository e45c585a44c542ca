"""Cells, windows, tiles and resampling on the small archive of two fields and four cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframes.operators import features, patches, quality
from spatialframes.operators.annotations import annotation_collapse, ann_by_id
from spatialframes.functions.names import index_names
from spatialframes.sources.tiles import hook_on_tiles, pixels_to_tiles, read_tiles, tiles_to_pixels, write_tiles

PIXELS = "fov_key string, channel string, row int, col int, value double"
MASK = "fov_key string, row int, col int, cell_id bigint"


def pixel_rows(fov, channel, image):
    return [(fov, channel, i, j, float(v)) for (i, j), v in np.ndenumerate(image)]


@pytest.fixture(scope="module")
def archive(spark):
    rows, labels = [], []
    i, j = np.indices((64, 64))
    for fov in ("fov_a", "fov_b"):
        for k, channel in enumerate(("CD3", "CD20", "CD68")):
            image = np.zeros((64, 64)) if (fov, channel) == ("fov_a", "CD68") else (i * (k + 2) + j) % 17 / 16.0
            rows += pixel_rows(fov, channel, image)
        for cell, c0 in ((1, 10), (2, 42)):
            labels += [(fov, r, c, cell) for r in range(10, 22) for c in range(c0, c0 + 12)]
    return spark.createDataFrame(rows, PIXELS).cache(), spark.createDataFrame(labels, MASK).cache()


def test_end_to_end(spark, archive):
    pixels, mask = archive
    assert {(r.fov_key, r.channel) for r in quality.zero_channels(pixels).collect()} == {("fov_a", "CD68")}
    where = {(r.fov_key, r.cell_id): (r.c_row, r.c_col, r.area) for r in features.centroids(mask).collect()}
    assert where == {(f, c): (15.5, x, 144) for f in ("fov_a", "fov_b") for c, x in ((1, 15.5), (2, 47.5))}
    kept = quality.clear_channels(pixels, quality.zero_channels(pixels))
    means = features.cell_means(kept, mask)
    assert means.count() == 10 and means.where("n_pixels <> 144").count() == 0
    i, j = np.indices((64, 64))
    want = ((i * 3 + j) % 17 / 16.0)[10:22, 42:54].mean()
    assert means.where("fov_key = 'fov_b' AND cell_id = 2 AND channel = 'CD20'").first().mean_value == pytest.approx(want)
    notes = spark.createDataFrame([("fov_a", 1, "Bcell", 0), ("fov_a", 2, "Tumor", 0), ("fov_b", 1, "Tumor", 0), ("fov_b", 2, "Myeloid", 0)], "fov_key string, cell_id bigint, ct_name string, pos int")
    cells = features.centroids(mask)
    labels = annotation_collapse(ann_by_id(notes, cells).where("matched"))
    assert sorted(r.ct_name for r in labels.collect()) == ["Bcell", "Myeloid", "Tumor", "Tumor"]
    domains = spark.createDataFrame([("IMC",), ("CODEX",), ("IMC",)], "d string")
    assert {r.name: r.idx for r in index_names(domains, "d").collect()} == {"CODEX": 0, "IMC": 1}


def test_tiles_carry_the_same_cells(archive):
    pixels, mask = archive
    tiles = pixels_to_tiles(pixels, 24, 20)
    labels = mask.select("fov_key", F.lit("m").alias("channel"), "row", "col", F.col("cell_id").alias("value"))
    blank = pixels.where("channel = 'CD3'").select("fov_key", F.lit("m").alias("channel"), "row", "col")
    full = blank.join(labels, ["fov_key", "channel", "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    out = features.cell_means_of_tiles(tiles, pixels_to_tiles(full, 24, 20).withColumnRenamed("values", "labels"))
    plain = features.cell_means(pixels, mask)
    key = ["fov_key", "cell_id", "channel"]
    both = out.join(plain.select(*key, F.col("mean_value").alias("m"), F.col("n_pixels").alias("n")), key, "full")
    assert both.count() == 12 and both.where("abs(mean_value - m) > 1e-12 OR n <> n_pixels OR m IS NULL").count() == 0


def test_tiles_round_trip_with_holes(archive, tmp_path):
    pixels, _ = archive
    holed = pixels.where("NOT (row % 5 = 1 AND col % 3 = 0)")
    write_tiles(pixels_to_tiles(holed, 16, 24), str(tmp_path / "tiles"))
    tiles = read_tiles(pixels.sparkSession, str(tmp_path / "tiles"), ["CD20"])
    cols = ["fov_key", "channel", "row", "col", "value"]
    want = holed.where("channel = 'CD20'").select(cols)
    got = tiles_to_pixels(tiles).select(cols)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_channel_pruning_reaches_the_scan(archive, tmp_path, capsys):
    pixels, _ = archive
    write_tiles(pixels_to_tiles(pixels, 32, 32), str(tmp_path / "t"))
    read_tiles(pixels.sparkSession, str(tmp_path / "t"), ["CD3"]).select("fov_key").explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(channel" in plan
    assert "ReadSchema: struct<fov_key:string>" in plan


def crop_of(image, r, c, size, fill=0):
    out = np.full((size, size), fill, dtype=float)
    for a in range(size):
        for b in range(size):
            if 0 <= r + a < image.shape[0] and 0 <= c + b < image.shape[1]:
                out[a, b] = image[r + a, c + b]
    return out


def test_windows_at_the_border(spark):
    rng = np.random.default_rng(1)
    image, label = rng.uniform(0.1, 1, (20, 20)), rng.integers(0, 4, (20, 20))
    pixels = spark.createDataFrame(pixel_rows("f", "c", image), PIXELS)
    mask = spark.createDataFrame([("f", i, j, int(v)) for (i, j), v in np.ndenumerate(label)], MASK)
    cells = spark.createDataFrame([("f", 1, 0.5, 19.0), ("f", 2, 10.5, 2.5), ("f", 3, 9.6, 9.4)], "fov_key string, cell_id bigint, c_row double, c_col double")
    for center, middle in (("round", {1: (0, 19), 2: (10, 2), 3: (10, 9)}), ("trunc", {1: (0, 19), 2: (10, 2), 3: (9, 9)})):
        full = {r.cell_id: r.patch for r in patches.patch_arrays(cells, pixels, None, 8, center).collect()}
        own = {r.cell_id: r.patch for r in patches.patch_arrays(cells, pixels, mask, 8, center).collect()}
        area = {r.cell_id: (r.self_area, r.neighbor_area) for r in patches.neighbor_area(cells, mask, 8, center).collect()}
        for cell, (r, c) in middle.items():
            crop, lab = crop_of(image, r - 4, c - 4, 8), crop_of(label, r - 4, c - 4, 8)
            assert full[cell] == pytest.approx(crop.ravel())
            assert own[cell] == pytest.approx((crop * (lab == cell)).ravel())
            assert area[cell] == ((lab == cell).sum(), ((lab != cell) & (lab != 0)).sum())


def test_distance_map(spark):
    own = np.zeros((8, 8), dtype=int)
    own[2:6, 1:7] = 1
    own[3, 3] = 0
    mask = spark.createDataFrame([("f", i, j, int(v)) for (i, j), v in np.ndenumerate(own)], MASK)
    cells = spark.createDataFrame([("f", 1, 4.0, 4.0)], "fov_key string, cell_id bigint, c_row double, c_col double")
    got = np.array(patches.distance_map(cells, mask, 8).first().distance).reshape(8, 8)
    outside = np.argwhere(own == 0)
    want = np.array([[np.sqrt(((outside - (i, j)) ** 2).sum(1).min()) if own[i, j] else 0 for j in range(8)] for i in range(8)])
    assert got == pytest.approx(want / want.max())
    whole = spark.createDataFrame([("f", i, j, 1) for i in range(8) for j in range(8)], MASK)
    assert set(patches.distance_map(cells, whole, 8).first().distance) == {0.0}


def test_no_pairwise_join_for_windows(spark, archive, capsys):
    pixels, mask = archive
    patches.patch_pixels(features.centroids(mask), pixels).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("scale", [0.5, 0.7, 1.0, 1.6, 3.0])
def test_resampling(spark, scale):
    rng = np.random.default_rng(9)
    image, label = rng.uniform(size=(7, 10)), rng.integers(1, 9, (7, 10))
    scales = spark.createDataFrame([("f", scale)], "fov_key string, scale double")
    mask = spark.createDataFrame([("f", i, j, int(v)) for (i, j), v in np.ndenumerate(label)], MASK)
    got = {(r.row, r.col): r.cell_id for r in patches.resample_nearest(mask, scales).collect()}
    rows, cols = round(7 * scale), round(10 * scale)
    for i in range(rows):
        for j in range(cols):
            # positions follow the ratio of the rounded shape, not the nominal scale
            assert got[i, j] == label[int((i + 0.5) * 7 / rows), int((j + 0.5) * 10 / cols)]
    assert len(got) == rows * cols
    out = patches.resample_bilinear(spark.createDataFrame(pixel_rows("f", "c", image), PIXELS), scales)
    line = lambda n, size: np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    one = np.array([[np.interp(y, np.arange(7), image[:, j]) for j in range(10)] for y in line(7, rows)])
    want = np.array([[np.interp(x, np.arange(10), one[i]) for x in line(10, cols)] for i in range(rows)])
    assert {(r.row, r.col) for r in out.collect()} == {(i, j) for i in range(rows) for j in range(cols)}
    for r in out.collect():
        assert r.value == pytest.approx(want[r.row, r.col])


def test_recipe_rejects_bad_arguments(spark, archive):
    pixels, mask = archive
    fovs = lambda mpp: spark.createDataFrame([("fov_a", mpp), ("fov_b", 0.5)], "fov_key string, native_mpp double")
    for mpp in (0.0, -1.0, float("nan"), float("inf"), None):
        with pytest.raises(ValueError, match="native_mpp"):
            patches.fov_recipe(pixels, mask, fovs(mpp))
    with pytest.raises(ValueError, match="percentile"):
        patches.fov_recipe(pixels, mask, fovs(0.5), percentile=101)
    with pytest.raises(ValueError, match="target_mpp"):
        patches.fov_recipe(pixels, mask, fovs(0.5), target_mpp=0.0)


def test_recipe(spark, archive):
    pixels, mask = archive
    fovs = spark.createDataFrame([("fov_a", 0.25), ("fov_b", 0.502)], "fov_key string, native_mpp double")
    image, labels, where = patches.fov_recipe(pixels, mask, fovs)
    size = {r.fov_key: r.n for r in image.where("channel = 'CD3'").groupBy("fov_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert size == {"fov_a": 32 * 32, "fov_b": 64 * 64}  # 0.4 % off is not resampled
    assert image.agg(F.min("value"), F.max("value")).first() == (0.0, 1.0)
    area = {(r.fov_key, r.cell_id): r.area for r in where.collect()}
    assert area == {("fov_a", 1): 36, ("fov_a", 2): 36, ("fov_b", 1): 144, ("fov_b", 2): 144}
    assert patches.lost_cells(mask, labels).count() == 0


def test_array_hooks_run_per_tile_and_are_checked(spark, archive):
    pixels, _ = archive
    tiles = pixels_to_tiles(pixels, 32, 32)
    out = tiles_to_pixels(hook_on_tiles(tiles, lambda raw, names: raw * [[[0.5]], [[1.0]], [[0.0]]] if names == ["CD20", "CD3", "CD68"] else None))
    factor = F.when(F.col("channel") == "CD20", 0.5).when(F.col("channel") == "CD68", 0.0).otherwise(1.0)
    want = pixels.withColumn("value", F.col("value") * factor)
    cols = ["fov_key", "channel", "row", "col", "value"]
    assert out.count() == want.count() and out.select(cols).exceptAll(want.select(cols)).count() == 0
    for bad in (lambda raw, names: raw[:1], lambda raw, names: raw + 5, lambda raw, names: raw * float("nan")):
        with pytest.raises(Exception, match="hook"):
            hook_on_tiles(tiles, bad).collect()


def test_hooks_see_each_tile_of_a_batch_by_itself(spark):
    """Many tiles of different extent and with holes in one Arrow batch, and no call of pandas for each."""
    rows = [(f"f{n}", c, i, j, (n + 1) / 100 + (c == "b") / 2) for n in range(30) for c in "ab" for i in range(5) for j in range(3) if (n, c, i, j) != (7, "a", 0, 0)]
    tiles = pixels_to_tiles(spark.createDataFrame(rows, PIXELS), 2, 2).coalesce(1)

    def hook(raw, names):
        assert names == ["a", "b"] and raw.shape[1] in (1, 2) and raw.shape[2] in (1, 2)
        raw[0] = raw[1] - raw[0]
        return raw

    out = hook_on_tiles(tiles, hook)
    got = {(r.fov_key, r.channel, r.row, r.col): round(r.value, 9) for r in tiles_to_pixels(out).collect()}
    assert got == {(f, c, i, j): 0.5 if c == "a" else round(v, 9) for f, c, i, j, v in rows}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString() and out.schema == tiles.schema
