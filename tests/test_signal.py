import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframes.operators import signal as ops

SCHEMA = "fov_key string, channel string, row int, col int, value double"


def frame(spark, channels, fov="a"):
    rows = [(fov, c, i, j, float(v)) for c, x in channels.items() for (i, j), v in np.ndenumerate(x)]
    return spark.createDataFrame(rows, SCHEMA)


def back(df, channel, shape):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("channel") == channel).collect():
        out[r.row, r.col] = r.value
    return out


@pytest.fixture
def panel(spark):
    i, j = np.indices((24, 24))
    x = {"CD3": (i * 7 + j * 3) % 50 + 1.0, "CD8": (i + j) % 9 * 1.0, "DAPI": np.zeros((24, 24))}
    x["CD8"][:5, :5] = 5000.0
    return x, frame(spark, x)


def test_default_chain_stays_in_unit_range(spark, panel):
    x, df = panel
    out = ops.apply_config(df, ops.DEFAULT_CONFIG)
    for c, image in x.items():
        got = back(out, c, image.shape)
        assert not np.isnan(got).any()
        clipped = np.minimum(image, np.percentile(image[image != 0], 99.9)) if image.any() else image
        span = np.ptp(clipped) or 1.0
        assert got == pytest.approx((clipped - clipped.min()) / span)
    assert (back(out, "DAPI", (24, 24)) == 0).all()
    assert ops.value_contract(out).count() == 0


def test_zeros_do_not_enter_the_percentile_but_negatives_do(spark):
    image = np.array([[0, 0, 0, 0], [-4, 1, 2, 3]], dtype=float)
    out = ops.clip_percentile(frame(spark, {"c": image}), 50.0)
    assert back(out, "c", image.shape) == pytest.approx(np.minimum(image, np.percentile([-4, 1, 2, 3], 50)))


def test_background_per_channel_touches_only_the_named(spark, panel):
    x, df = panel
    out = ops.background_subtract_per_channel(df, 25.0, ["CD3"])
    floor = np.percentile(x["CD3"][x["CD3"] != 0], 25)
    assert back(out, "CD3", (24, 24)) == pytest.approx(np.clip(x["CD3"] - floor, 0, None))
    assert back(out, "CD8", (24, 24)) == pytest.approx(x["CD8"])
    every = ops.background_subtract_per_channel(df, 25.0, [])
    assert back(every, "DAPI", (24, 24)) == pytest.approx(x["DAPI"])


def test_drop_and_weight(spark, panel):
    _, df = panel
    chain = [{"op": "min_max_normalize"}, {"op": "channel_weight", "weights": {"CD8": 0.25}}, {"op": "channel_drop", "names": ["CD3"]}]
    out = ops.make_preprocessor(chain)(df)
    assert back(out, "CD8", (24, 24)).max() == pytest.approx(0.25)
    assert (back(out, "CD3", (24, 24)) == 0).all()


@pytest.mark.parametrize("op", [{"op": "channel_drop", "names": ["nope"]}, {"op": "channel_weight", "weights": {"nope": 1}}, {"op": "sharpen"}, {"op": "denoise", "kind": "wavelet"}])
def test_unknown_names_and_operations_raise(panel, op):
    with pytest.raises(ValueError, match="unknown"):
        ops.apply_config(panel[1], [op])


def test_gamma_and_hot_pixels(spark, panel):
    x, df = panel
    out = ops.gamma(df, 0.5)
    assert back(out, "CD3", (24, 24)) == pytest.approx(np.sqrt(x["CD3"] / x["CD3"].max()) * x["CD3"].max())
    assert (back(out, "DAPI", (24, 24)) == 0).all()
    out = ops.hot_pixel_removal(df, 5.0)
    med = np.median(x["CD8"])
    mad = np.median(np.abs(x["CD8"] - med))
    assert back(out, "CD8", (24, 24)) == pytest.approx(np.minimum(x["CD8"], med + 5 * 1.4826 * mad))


def reflected(image, r, c):
    def fold(i, n):
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i

    return image[fold(r, image.shape[0]), fold(c, image.shape[1])]


@pytest.mark.parametrize("size", [2, 3, 5])
def test_median_filter(spark, size):
    image = np.random.default_rng(1).normal(size=(6, 9))
    got = back(ops.denoise(frame(spark, {"c": image}), "median", size), "c", image.shape)
    offsets = [d - size // 2 for d in range(size)]
    for (r, c), v in np.ndenumerate(got):
        window = sorted(reflected(image, r + a, c + b) for a in offsets for b in offsets)
        assert v == window[len(window) // 2]


def test_gaussian_filter_keeps_the_mean_of_a_flat_image_and_smooths(spark):
    image = np.random.default_rng(2).normal(size=(7, 5))
    got = back(ops.denoise(frame(spark, {"c": image}), "gaussian", 3), "c", image.shape)
    w = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    w /= w.sum()
    want = np.zeros_like(image)
    for (r, c), _ in np.ndenumerate(image):
        want[r, c] = sum(w[a + 6] * w[b + 6] * reflected(image, r + a, c + b) for a in range(-6, 7) for b in range(-6, 7))
    assert got == pytest.approx(want)


def test_a_gap_in_the_image_raises(spark):
    df = frame(spark, {"c": np.ones((4, 4))}).where("NOT (row = 1 AND col = 2)")
    with pytest.raises(Exception, match="missing pixels"):
        ops.denoise(df, "median", 3).collect()


def test_hooks_are_held_to_the_contract(spark, panel):
    _, df = panel
    good = ops.run_hook(df, ops.make_preprocessor(ops.DEFAULT_CONFIG))
    assert good.columns == df.columns
    with pytest.raises(ValueError, match="out_of_range"):
        ops.run_hook(df, lambda d: d)
    with pytest.raises(ValueError, match="not_finite"):
        ops.run_hook(df, lambda d: d.withColumn("value", F.lit(float("nan"))))
    with pytest.raises(ValueError, match="columns"):
        ops.run_hook(df, lambda d: d.drop("row"))
