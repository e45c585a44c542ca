"""Cases off the usual path: gaps, odd sizes, empty windows, unfitted keys, extreme weights."""

import math

import pytest
from pyspark.sql import functions as F

from spatialframes.operators import features, metrics, patches, sampling, scoring, signal
from spatialframes.sources.tiles import hook_on_tiles, pixels_to_tiles, tiles_to_pixels

PIXELS = "fov_key string, channel string, row int, col int, value double"
MASK = "fov_key string, row int, col int, cell_id bigint"


def test_tiles_with_a_gap(spark):
    pixels = spark.createDataFrame([("f", "a", 0, 0, 10.0), ("f", "a", 1, 0, 20.0)] + [("f", "b", r, c, 1.0) for r in (0, 1) for c in (0, 1)], PIXELS)
    mask = spark.createDataFrame([("f", r, c, 1 if c == 0 else 2) for r in (0, 1) for c in (0, 1)], MASK)
    labels = mask.select("fov_key", F.lit("m").alias("channel"), "row", "col", F.col("cell_id").alias("value"))
    shapes = patches.field_shapes(mask)
    tiles = pixels_to_tiles(pixels, 4, 4, shapes)
    out = features.cell_means_of_tiles(tiles, pixels_to_tiles(labels, 4, 4).withColumnRenamed("values", "labels"))
    plain = features.cell_means(pixels, mask)
    columns = ["cell_id", "channel", "mean_value", "sum_value", "n_pixels"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows(out) == rows(plain)
    assert (1, "a", 15.0, 30.0, 2) in rows(out)
    hooked = tiles_to_pixels(hook_on_tiles(tiles, lambda raw, names: raw.clip(0, 1)))
    assert hooked.count() == pixels.count() and hooked.where("value <> 1").count() == 0
    other = pixels_to_tiles(labels, 4, 4, shapes.withColumn("n_cols", F.lit(3)))
    with pytest.raises(Exception, match="differ in size"):
        features.cell_means_of_tiles(tiles, other.withColumnRenamed("values", "labels")).collect()


def test_ring_cells_have_windows(spark):
    ring = [(r, c) for r in range(9) for c in range(9) if r in (0, 8) or c in (0, 8)]
    mask = spark.createDataFrame([("f", r, c, 1 if (r, c) in ring else 0) for r in range(9) for c in range(9)], MASK)
    pixels = spark.createDataFrame([("f", "a", r, c, 1.0) for r in range(9) for c in range(9)], PIXELS)
    cells = features.centroids(mask)
    crop = 4
    assert [r.patch for r in patches.patch_arrays(cells, pixels, mask, crop).collect()] == [[0.0] * 16]
    assert [r.patch for r in patches.patch_arrays(cells, pixels, None, crop).collect()] == [[1.0] * 16]
    assert [r.distance for r in patches.distance_map(cells, mask, crop).collect()] == [[0.0] * 16]
    assert [(r.self_area, r.neighbor_area) for r in patches.neighbor_area(cells, mask, crop).collect()] == [(0, 0)]


@pytest.mark.parametrize("n", [1, 3, 7, 11])
@pytest.mark.parametrize("scale", [0.3, 0.5, 0.9, 1.7])
def test_image_and_mask_keep_one_shape(spark, n, scale):
    pixels = spark.createDataFrame([("f", "a", r, c, float(r)) for r in range(n) for c in range(n)], PIXELS)
    mask = spark.createDataFrame([("f", r, c, 1) for r in range(n) for c in range(n)], MASK)
    scales = spark.createDataFrame([("f", scale)], "fov_key string, scale double")
    place = lambda df: sorted((r.row, r.col) for r in df.collect())
    image, labels = place(patches.resample_bilinear(pixels, scales)), place(patches.resample_nearest(mask, scales))
    assert image == labels
    size = max(1, round(n * scale))
    assert image == [(r, c) for r in range(size) for c in range(size)]


def test_normalisers_keep_what_was_not_fitted(spark):
    readings = spark.createDataFrame([("d", "m", 1e8 + v) for v in (0.0, 0.5, 1.0)] + [("new", "m", 7.0)], "domain string, marker string, value double")
    moments = features.domain_moments(readings.where("domain = 'd'"))
    assert moments.first()["std"] == pytest.approx(math.sqrt(1 / 6))
    out = features.apply_domain_norm(readings, moments)
    assert out.count() == 4 and out.where("domain = 'new'").first()["value"] == 7.0
    cells = spark.createDataFrame([(1, "a", 255.0), (1, "b", 510.0)], "cell_id int, marker string, mean_value double")
    scaled = features.zscore_features(cells, cells.where("marker = 'a'")).where("marker = 'b'").collect()
    assert [r["scaled"] for r in scaled] == [2.0]


def test_no_known_class_gives_none(spark):
    df = spark.createDataFrame([("t", [0.7, 0.3]), ("u", [0.2, 0.8])], "tissue string, probs array<double>")
    allowed = spark.createDataFrame([("t", "Z")], "tissue string, name string")
    assert {r.tissue: r.predicted_ct for r in scoring.tissue_argmax(df, ["A", "B"], allowed).collect()} == {"t": None, "u": "B"}


def test_focal_loss_at_zero(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (None,)], "p double")
    row = metrics.reduce_loss(df, metrics.focal_loss(F.col("p"))).first()
    assert row["n_rows"] == 2 and 300 < row["mean_loss"] < 400


def test_gap_inside_a_line_raises(spark):
    pixels = spark.createDataFrame([("f", "a", 0, c, 1.0) for c in (0, 1, 1, 3)], PIXELS)
    with pytest.raises(Exception, match="missing pixels"):
        signal.on_lines(pixels, "col", lambda line, n, i: F.get(line, i)).collect()


@pytest.mark.parametrize("unit", [1e-13, 1e-30, 1e17, 1e290])
def test_draws_at_any_scale_of_weights(spark, unit):
    df = spark.createDataFrame([(i, unit * (1 + i % 3)) for i in range(300)], "id int, w double")
    drawn = sampling.weighted_draw(df, "w", 3000, ["id"]).withColumn("k", F.col("id") % 3).groupBy("k").count().collect()
    counts = {r["k"]: r["count"] for r in drawn}
    assert sum(counts.values()) == 3000 and all(abs(counts[k] - 500 * (k + 1)) < 120 for k in range(3))


def test_draws_over_thirty_orders_of_magnitude(spark):
    df = spark.createDataFrame([(i, 10.0 ** (15 - i)) for i in range(31)] + [(99, float("nan")), (98, -1.0), (97, float("inf"))], "id int, w double")
    drawn = {r["id"] for r in sampling.weighted_draw(df, "w", 1000, ["id"]).collect()}
    assert sampling.weighted_draw(df, "w", 1000, ["id"]).count() == 1000 and drawn <= set(range(31))
    assert sampling.weighted_draw(df.where("id > 90"), "w", 10, ["id"]).count() == 10 - 10


def test_auroc_of_any_range(spark):
    from spatialframes.operators.positivity import marker_auroc

    values = [-1e300, -5.0, -1e-9, 0.0, 1e-300, 1e-12, 1.1e-12, 0.3, 0.3, 7.0, 1e20, float("inf")]
    rows = [(m, v, (i * k) % 3 == 1) for m, k in (("a", 1), ("b", 2), ("c", 5)) for i, v in enumerate(values)]
    rows += [("a", float("nan"), True), ("b", float("nan"), False)]
    df = spark.createDataFrame([(m, v, int(t)) for m, v, t in rows], "marker string, score double, target int")
    got = {r.marker: r.auroc for r in marker_auroc(df).collect()}
    rank = lambda v: -math.inf if math.isnan(v) else v
    for marker in "abc":
        pos = [rank(v) for m, v, t in rows if m == marker and t]
        neg = [rank(v) for m, v, t in rows if m == marker and not t]
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert got[marker] == pytest.approx(wins / len(pos) / len(neg))


def test_last_spelling_in_list_order(spark):
    from spatialframes.operators.positivity import positivity_lookup

    truth = spark.createDataFrame(
        [("d", "T", "CD3", "0", 0, 1), ("d", "T", "Cd3", "1", 0, 0)], "dataset_name string, cell_type string, marker string, value string, cell_type_pos int, marker_pos int"
    )
    wanted = spark.createDataFrame([("d", "T", "cd3")], "dataset_name string, cell_type string, marker string")
    by_place = positivity_lookup(wanted, truth).first()
    by_name = positivity_lookup(wanted, truth.drop("cell_type_pos", "marker_pos")).first()
    assert (by_place["positive"], by_name["positive"]) == (0, 1)


def test_unknown_dataset_is_refused(spark):
    from spatialframes.operators import annotations

    df = spark.createDataFrame([("nowhere",)], "dataset_key string")
    with pytest.raises(ValueError, match="nowhere"):
        annotations.canonical_metadata(df, annotations.dataset_canonical(spark))


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from spatialframes.streaming import running

    source, out, log = (str(tmp_path / x) for x in ("source", "out", "log"))
    part = lambda *rows: spark.createDataFrame(rows, "actual string, pred string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: {
        (r.actual, r.pred): r.n
        for r in running.run_available(running.running_confusion(spark.readStream.schema("actual string, pred string").parquet(source)), "complete", out, log).collect()
    }
    part(("a", "a"), ("a", "b"))
    assert run() == {("a", "a"): 1, ("a", "b"): 1}
    part(("a", "b"))
    assert run() == {("a", "a"): 1, ("a", "b"): 2}
    assert run() == {("a", "a"): 1, ("a", "b"): 2}
