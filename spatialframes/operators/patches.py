"""Windows of pixels round each cell, and resampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from spatialframes.functions.arrays import scatter
from spatialframes.operators.features import centroids
from spatialframes.operators.signal import CHANNEL, clip_and_normalize, on_lines
from spatialframes.session import settle, settle_and_tell

CROP = 32  # fixed value: edge of the window a model sees


def window_origin(centroid: Column, crop: int, center: str) -> Column:
    """First pixel of the window: the centre is rounded half to even, or truncated."""
    if center not in ("round", "trunc"):
        raise ValueError(f"center is 'round' or 'trunc', not {center!r}")
    middle = F.bround(centroid, 0) if center == "round" else F.when(centroid < 0, F.ceil(centroid)).otherwise(F.floor(centroid))
    return middle.cast("int") - F.lit(crop // 2)


def windows(cells: DataFrame, crop: int = CROP, center: str = "round") -> DataFrame:
    return cells.select(
        "fov_key", "cell_id", window_origin(F.col("c_row"), crop, center).alias("r0"), window_origin(F.col("c_col"), crop, center).alias("c0")
    )


def _inside(boxes: DataFrame, pixels: DataFrame, crop: int) -> DataFrame:
    """Pixels of every window: both sides meet in squares as wide as the window, at most four each."""
    square = lambda c: F.floor(c / crop)
    spread = boxes.withColumn("_br", F.explode(F.sequence(square(F.col("r0")), square(F.col("r0") + crop - 1))))
    spread = spread.withColumn("_bc", F.explode(F.sequence(square(F.col("c0")), square(F.col("c0") + crop - 1))))
    placed = pixels.withColumn("_br", square(F.col("row"))).withColumn("_bc", square(F.col("col")))
    met = spread.join(placed, ["fov_key", "_br", "_bc"])
    pr, pc = F.col("row") - F.col("r0"), F.col("col") - F.col("c0")
    met = met.where((pr >= 0) & (pr < crop) & (pc >= 0) & (pc < crop))
    return met.withColumn("pr", pr.cast("int")).withColumn("pc", pc.cast("int")).drop("_br", "_bc", "r0", "c0", "row", "col")


def patch_pixels(cells: DataFrame, pixels: DataFrame, crop: int = CROP, center: str = "round") -> DataFrame:
    """Every pixel of the window of every cell, at its place ``(pr, pc)`` inside the window."""
    return _inside(windows(cells, crop, center), pixels, crop)


def patch_labels(cells: DataFrame, mask: DataFrame, crop: int = CROP, center: str = "round") -> DataFrame:
    """Labelled pixels in the window of each cell; ``is_self`` tells its own from a neighbour's."""
    labels = mask.where(F.col("cell_id") != 0).withColumnRenamed("cell_id", "label")
    met = _inside(windows(cells, crop, center), labels, crop)
    return met.withColumn("is_self", F.col("label") == F.col("cell_id"))


def self_pixels(cells: DataFrame, mask: DataFrame, crop: int = CROP, center: str = "round") -> DataFrame:
    """A cell's own pixels in its window: an equi join on the cell, before any channel is read."""
    own = mask.join(windows(cells, crop, center), ["fov_key", "cell_id"])
    pr, pc = F.col("row") - F.col("r0"), F.col("col") - F.col("c0")
    own = own.where((pr >= 0) & (pr < crop) & (pc >= 0) & (pc < crop))
    return own.select("fov_key", "cell_id", "row", "col", pr.cast("int").alias("pr"), pc.cast("int").alias("pc"))


def neighbor_area(cells: DataFrame, mask: DataFrame, crop: int = CROP, center: str = "round") -> DataFrame:
    """Pixels of the cell itself and of all other cells in its window."""
    areas = patch_labels(cells, mask, crop, center).groupBy("fov_key", "cell_id").agg(
        F.count_if("is_self").alias("self_area"), F.count_if(~F.col("is_self")).alias("neighbor_area")
    )
    every = cells.select("fov_key", "cell_id").join(areas, ["fov_key", "cell_id"], "left")
    return every.select("fov_key", "cell_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("self_area", "neighbor_area")])


def patch_arrays(
    cells: DataFrame, pixels: DataFrame, mask: DataFrame | None, crop: int = CROP, center: str = "round"
) -> DataFrame:
    """One window per (cell, channel) as a row-major array, zero outside the image.

    With a mask only the cell's own pixels keep their value; without one the whole window does.
    Every cell has a window for every channel of its field, of zeros where nothing lies in it.
    """
    if mask is not None:
        rows = pixels.join(self_pixels(cells, mask, crop, center), ["fov_key", "row", "col"])
    else:
        rows = patch_pixels(cells, pixels, crop, center)
    entry = F.struct((F.col("pr") * crop + F.col("pc")).alias("at"), F.col("value").cast("double").alias("value"))
    packed = rows.groupBy("fov_key", "cell_id", "channel").agg(F.collect_list(entry).alias("_entries"))
    panel = settle(pixels.select("fov_key", "channel").distinct())
    every = cells.select("fov_key", "cell_id").join(panel, "fov_key").join(packed, ["fov_key", "cell_id", "channel"], "left")
    return every.select("fov_key", "cell_id", "channel", scatter(_or_none(F.col("_entries")), crop * crop).alias("patch"))


def _or_none(entries: Column) -> Column:
    return F.coalesce(entries, F.array().cast("array<struct<at:int,value:double>>"))


def distance_to_edge(own):
    """Distance of each pixel of a square window to the nearest pixel outside the cell, over its maximum."""
    import numpy as np

    n = len(own)
    if own.all() or not own.any():
        return np.zeros((n, n))
    steps = np.arange(n)
    apart = (steps[:, None] - steps[None, :]) ** 2
    # down each column to the nearest outside pixel, then across the columns
    down = np.where(own[None, :, :], np.inf, apart[:, :, None]).min(axis=1)
    squared = (down[:, None, :] + apart[None, :, :]).min(axis=2)
    distance = np.sqrt(squared)
    return distance / distance.max()


@F.pandas_udf(ArrayType(DoubleType()))
def _distance(masks: pd.Series, crop: pd.Series) -> pd.Series:
    import numpy as np

    return pd.Series([distance_to_edge(np.asarray(flat).reshape(n, n) > 0).ravel() for flat, n in zip(masks, crop)])


def distance_map(cells: DataFrame, mask: DataFrame, crop: int = CROP, center: str = "round") -> DataFrame:
    """Normalised distance to the cell's boundary inside its window, as a row-major array.

    A window without one outside pixel has no boundary and gives zeros, and so does one without a
    pixel of the cell.
    """
    own = self_pixels(cells, mask, crop, center)
    entry = F.struct((F.col("pr") * crop + F.col("pc")).alias("at"), F.lit(1.0).alias("value"))
    packed = own.groupBy("fov_key", "cell_id").agg(F.collect_list(entry).alias("_entries"))
    packed = cells.select("fov_key", "cell_id").join(packed, ["fov_key", "cell_id"], "left")
    packed = packed.withColumn("_own", scatter(_or_none(F.col("_entries")), crop * crop))
    return packed.select("fov_key", "cell_id", _distance(F.col("_own"), F.lit(crop)).alias("distance"))


# --- resampling ---------------------------------------------------------------------------------------------

SCALE_SLACK = 0.01  # fixed value: closer than this to 1 a field is not resampled


def _targets(at: Column, scale: Column) -> Column:
    """Output positions whose centre falls on source pixel ``at``."""
    low = F.ceil(at * scale - 0.5) - 1
    high = F.ceil((at + 1) * scale - 0.5)
    return F.filter(F.sequence(low, high), lambda i: (i >= 0) & (F.floor((i + 0.5) / scale) == at))


def field_shapes(pixels: DataFrame) -> DataFrame:
    """``fov_key, n_rows, n_cols`` of the fields, from the last pixel any channel has."""
    return pixels.groupBy("fov_key").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


def new_length(n: Column, scale: Column) -> Column:
    """Pixels of an axis of ``n`` pixels at another resolution, one at least."""
    return F.greatest(F.bround(n * scale, 0), F.lit(1)).cast("int")


def resample_nearest(mask: DataFrame, scales: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Labels at another resolution: every source pixel fans out to the targets it is nearest to.

    ``scales(fov_key, scale)``, and ``shapes(fov_key, n_rows, n_cols)`` if the mask does not hold
    every pixel. The new shape is rounded, and positions follow the ratio of the two shapes, as they
    do for the image. No neighbouring pixel is needed, so no pixel is shuffled.
    """
    sizes = settle((field_shapes(mask) if shapes is None else shapes).join(scales.select("fov_key", "scale"), "fov_key"))
    scaled = mask.join(sizes, "fov_key")
    ratio = lambda n: new_length(F.col(n), F.col("scale")) / F.col(n)
    scaled = scaled.withColumn("_row", F.explode(_targets(F.col("row"), ratio("n_rows"))))
    scaled = scaled.withColumn("_col", F.explode(_targets(F.col("col"), ratio("n_cols"))))
    rest = [c for c in mask.columns if c not in ("row", "col")]
    return scaled.select(*rest, F.col("_row").cast("int").alias("row"), F.col("_col").cast("int").alias("col")).select(mask.columns)


def _bilinear(line: Column, n: Column, i: Column, scale: Column) -> Column:
    at = (i + 0.5) * n / new_length(n, scale) - 0.5
    low = F.floor(at)
    part = at - low
    clamp = lambda x: F.greatest(F.least(x, n - 1), F.lit(0)).cast("int")
    return F.get(line, clamp(low)) * (1.0 - part) + F.get(line, clamp(low + 1)) * part


def resample_bilinear(pixels: DataFrame, scales: DataFrame) -> DataFrame:
    """Linear interpolation at pixel centres, edges held, one pass per axis; no smoothing first."""
    scaled = pixels.join(scales.select("fov_key", "scale"), "fov_key")
    for axis in ("row", "col"):
        scaled = on_lines(scaled, axis, _bilinear, ["scale"], new_length)
    return scaled.select(*CHANNEL, "row", "col", "value")


def needs_resampling(scale: Column, slack: float = SCALE_SLACK) -> Column:
    return F.abs(scale - 1.0) > slack


def resolution_scales(fovs: DataFrame, target_mpp: float, slack: float) -> tuple[DataFrame, bool]:
    """``fov_key, scale`` of the fields, and whether any is farther from 1 than ``slack``; bad resolutions raise."""
    mpp = F.col("native_mpp")
    bad = mpp.isNull() | F.isnan(mpp) | (mpp <= 0) | (mpp == float("inf"))
    scales = fovs.select("fov_key", F.when(~bad, mpp / F.lit(float(target_mpp))).alias("scale"))
    scales, told = settle_and_tell(scales, bad=F.col("scale").isNull(), moves=needs_resampling(F.col("scale"), slack))
    if told["bad"]:
        raise ValueError("native_mpp must be positive and finite")
    return scales, bool(told["moves"])


def to_resolution(
    pixels: DataFrame, mask: DataFrame, fovs: DataFrame, target_mpp: float, slack: float = SCALE_SLACK
) -> tuple[DataFrame, DataFrame]:
    """Pixels and labels at ``target_mpp``; fields closer to it than ``slack`` stay as they are.

    Resampled pixels are written once: the conditioning that follows reads them several times.
    """
    scales, any_moves = resolution_scales(fovs, target_mpp, slack)
    if not any_moves:
        return pixels, mask
    moves = needs_resampling(F.col("scale"), slack)
    moved, kept = scales.where(moves), scales.where(~moves).select("fov_key")
    cols = ["fov_key", "channel", "row", "col", "value"]
    scaled = settle(resample_bilinear(pixels, moved)).unionByName(pixels.join(kept, "fov_key", "left_semi").select(cols))
    labels = resample_nearest(mask, moved, field_shapes(pixels)).unionByName(mask.join(kept, "fov_key", "left_semi"))
    return scaled, labels


def lost_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells of the first mask without a pixel in the second."""
    ids = lambda m: m.where(F.col("cell_id") != 0).select("fov_key", "cell_id").distinct()
    return ids(before).join(ids(after), ["fov_key", "cell_id"], "left_anti")


def fov_recipe(
    pixels: DataFrame, mask: DataFrame, fovs: DataFrame, percentile: float = 99.9, target_mpp: float = 0.5
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resample to ``target_mpp``, clip and normalise every channel, and find the centroids.

    ``fovs(fov_key, native_mpp)``. Returns (pixels, mask, centroids).
    """
    if not 0.0 <= percentile <= 100.0:
        raise ValueError(f"percentile must lie in [0, 100], got {percentile}")
    if not 0.0 < target_mpp < float("inf"):
        raise ValueError(f"target_mpp must be positive and finite, got {target_mpp}")
    scaled, labels = to_resolution(pixels, mask, fovs, target_mpp)
    return clip_and_normalize(scaled, percentile), labels, centroids(labels)
