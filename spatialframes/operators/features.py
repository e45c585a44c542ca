"""Per-cell features from pixel and label tables, and their normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialframes.functions.arrays import scatter
from spatialframes.functions.ordering import seeded_rank
from spatialframes.functions.quantiles import exact_quantiles
from spatialframes.session import settle

PIXEL = ["fov_key", "row", "col"]


def foreground(mask: DataFrame) -> DataFrame:
    """Label 0 is background and never reaches a shuffle."""
    return mask.where(F.col("cell_id") != 0)


def cell_areas(mask: DataFrame) -> DataFrame:
    return foreground(mask).groupBy("fov_key", "cell_id").agg(F.count(F.lit(1)).alias("area"))


def centroids(mask: DataFrame) -> DataFrame:
    """Mean pixel position and area of each label."""
    return foreground(mask).groupBy("fov_key", "cell_id").agg(
        F.avg("row").alias("c_row"), F.avg("col").alias("c_col"), F.count(F.lit(1)).alias("area")
    )


def cell_means(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean, sum and pixel count per cell and channel; a channel without a pixel has no row."""
    inside = pixels.join(foreground(mask), PIXEL)
    return inside.groupBy("fov_key", "cell_id", "channel").agg(
        F.avg("value").alias("mean_value"),
        F.sum("value").alias("sum_value"),
        F.count(F.lit(1)).alias("n_pixels"),
    )


def cell_means_of_tiles(tiles: DataFrame, mask_tiles: DataFrame) -> DataFrame:
    """The same from tiles: arrays meet by tile key, pixels exist only inside the partial sums.

    Both sides must be cut with the same shape of the field; a place without a value counts for
    nothing, a tile of another size raises.
    """
    key = ["fov_key", "tile_r", "tile_c"]
    both = tiles.join(mask_tiles.select(*key, "labels"), key)
    zipped = F.when(F.size("values") == F.size("labels"), F.arrays_zip("values", "labels")).otherwise(
        F.raise_error(F.lit("tiles of values and labels differ in size"))
    )
    pairs = both.select("fov_key", "channel", F.explode(zipped).alias("p"))
    pairs = pairs.select("fov_key", "channel", F.col("p.values").alias("value"), F.col("p.labels").alias("cell_id"))
    return pairs.where((F.col("cell_id") != 0) & F.col("value").isNotNull()).groupBy("fov_key", "cell_id", "channel").agg(
        F.avg("value").alias("mean_value"), F.sum("value").alias("sum_value"), F.count(F.lit(1)).alias("n_pixels")
    )


def label_means(mask: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean of a predicted map under every label; a label without a usable value gets 0."""
    value = F.when(~F.isnan("value"), F.col("value"))
    joined = foreground(mask).join(pixels, PIXEL, "left")
    return joined.groupBy("fov_key", "cell_id").agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("score"))


def view_average(scores: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over repeated scores (views, layers) of the same key."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n_views"))


# --- normalisers -----------------------------------------------------------------------------------


def cross_fov_norm(pixels: DataFrame, q: float = 0.999, n_fovs: int = 10, seed: int = 42) -> DataFrame:
    """Per channel, the mean over a seeded sample of fields of their positive-pixel quantile."""
    fovs = pixels.select("fov_key").distinct()
    chosen = settle(seeded_rank(fovs, [], ["fov_key"], seed, limit=n_fovs).select("fov_key"))
    sampled = pixels.join(chosen, "fov_key", "left_semi").where(F.col("value") > 0)
    per_fov = exact_quantiles(sampled, ["fov_key", "channel"], "value", {"q": q}).where(F.col("q") > 0)
    return per_fov.groupBy("channel").agg(F.avg("q").alias("factor"), F.count(F.lit(1)).alias("n_fovs"))


def apply_fov_norm(pixels: DataFrame, factors: DataFrame, q: float = 0.999) -> DataFrame:
    """Scale into [0, 1] by the channel factor, else by the field's own quantile, else leave."""
    factors = settle(factors.where(F.col("factor") > 0).select("channel", "factor"))
    rest = pixels.join(factors, "channel", "left_anti").where(F.col("value") > 0)
    own = settle(exact_quantiles(rest, ["fov_key", "channel"], "value", {"own": q}).drop("n_values"))
    scaled = pixels.join(factors, "channel", "left").join(own, ["fov_key", "channel"], "left")
    divisor = F.coalesce("factor", F.when(F.col("own") > 0, F.col("own")))
    clipped = F.greatest(F.least(F.col("value") / divisor, F.lit(1.0)), F.lit(0.0))
    value = F.when(divisor.isNull(), F.col("value")).otherwise(clipped)
    return scaled.withColumn("value", value).drop("factor", "own")


def domain_moments(readings: DataFrame, std_floor: float = 1e-6) -> DataFrame:
    """Mean and population standard deviation per (domain, marker); unseen pairs get (0, 1)."""
    seen = readings.groupBy("domain", "marker").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("d")
    )
    seen = settle(seen)
    # vocabularies, not rows: both sets are as small as the registry
    grid = seen.agg(F.collect_set("domain").alias("d"), F.collect_set("marker").alias("m"))
    grid = grid.select(F.explode("d").alias("domain"), "m").select("domain", F.explode("m").alias("marker"))
    full = grid.join(seen, ["domain", "marker"], "left")
    return full.select(
        "domain",
        "marker",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("m", F.lit(0.0)).alias("mean"),
        # greatest() skips NULL, so an unseen pair needs its own branch
        F.when(F.col("n").isNull(), F.lit(1.0)).otherwise(F.greatest("d", F.lit(std_floor))).alias("std"),
    )


def apply_domain_norm(readings: DataFrame, moments: DataFrame) -> DataFrame:
    """Readings less the mean, over the deviation, of their pair; a pair that was not fitted has (0, 1)."""
    small = settle(moments.select("domain", "marker", "mean", "std"))
    joined = readings.join(small, ["domain", "marker"], "left")
    value = (F.col("value") - F.coalesce("mean", F.lit(0.0))) / F.coalesce("std", F.lit(1.0))
    return joined.withColumn("value", value).drop("mean", "std")


def feature_moments(features: DataFrame, value: str = "mean_value") -> DataFrame:
    """Per marker mean and population deviation, a zero deviation read as one."""
    std = F.stddev_pop(value)
    return features.groupBy("marker").agg(
        F.avg(value).alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std")
    )


def zscore_features(
    features: DataFrame, train: DataFrame, value: str = "mean_value", z: bool = True, scale: float = 255.0
) -> DataFrame:
    """Training-set z-score and division by ``scale``; only the division with ``z=False``.

    A marker that the training set lacks has mean 0 and deviation 1.
    """
    if not z:
        return features.withColumn("scaled", F.col(value) / scale)
    small = settle(feature_moments(train, value))
    joined = features.join(small, "marker", "left")
    scored = (F.col(value) - F.coalesce("mean", F.lit(0.0))) / F.coalesce("std", F.lit(1.0))
    return joined.withColumn("scaled", scored / scale).drop("mean", "std")


# --- matrices ----------------------------------------------------------------------------------------


def feature_matrix(
    features: DataFrame,
    markers: DataFrame,
    n_markers: int,
    panel: DataFrame | None = None,
    missing: float = 0.0,
    size: str | None = None,
    by: Sequence[str] = ("fov_key", "cell_id"),
    value: str = "mean_value",
) -> DataFrame:
    """One dense vector per cell in registry order.

    A marker of the panel without a value is 0.0; a marker the field never measured is
    ``missing``. ``panel(fov_key, marker)`` tells the two apart; without it nothing is absent.
    The optional ``size`` column becomes the last entry.
    """
    index = markers.select(F.col("name").alias("marker"), "idx")
    entry = F.struct(F.col("idx").alias("at"), F.col(value).alias("value"))
    aggs = [F.collect_list(entry).alias("_entries")]  # at most one entry per registered marker
    if size:
        aggs.append(F.max(size).cast("double").alias("_size"))
    cells = features.join(index, "marker").groupBy(*by).agg(*aggs)
    entries = F.col("_entries")
    if panel is not None:
        zero = F.struct(F.col("idx").alias("at"), F.lit(0.0).alias("value"))
        known = panel.select("fov_key", "marker").distinct().join(index, "marker")
        cells = cells.join(settle(known.groupBy("fov_key").agg(F.collect_list(zero).alias("_panel"))), "fov_key", "left")
        entries = F.concat(F.col("_panel"), entries)
    vector = scatter(entries, n_markers, missing if panel is not None else 0.0)
    if size:
        vector = F.concat(vector, F.array("_size"))
    return cells.withColumn("features", vector).select(*by, "features")


def fill_absent(features: DataFrame, cells: DataFrame, panel: DataFrame, vocab: DataFrame, missing: float | None) -> DataFrame:
    """Every (cell, registered marker): the value, 0.0 when measured but empty, else ``missing``.

    ``vocab(name)`` is a registry, so its names ride along as one array per cell.
    """
    names = F.array(*[F.lit(r[0]) for r in vocab.select("name").orderBy("name").collect()])
    grid = cells.select("fov_key", "cell_id", F.explode(names).alias("marker"))
    known = settle(panel.select("fov_key", "marker").distinct().withColumn("_present", F.lit(True)))
    grid = grid.join(known, ["fov_key", "marker"], "left")
    grid = grid.join(features.select("fov_key", "cell_id", "marker", "mean_value"), ["fov_key", "cell_id", "marker"], "left")
    filled = F.when(F.col("_present"), F.coalesce("mean_value", F.lit(0.0))).otherwise(F.lit(missing).cast("double"))
    return grid.select("fov_key", "cell_id", "marker", filled.alias("mean_value"))


def embedding_align(vocab: DataFrame, embeddings: DataFrame, dims: int) -> DataFrame:
    """Saved vectors in the order of the current registry; a name without one gets zeros."""
    joined = vocab.join(embeddings.select(F.col("marker").alias("name"), "vec"), "name", "left")
    return joined.select("name", "idx", F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)).alias("vec"))


def scatter_dense(channels: DataFrame, markers: DataFrame, n_markers: int, by: Sequence[str], value: str) -> DataFrame:
    """Channel values moved to their registry position, zero elsewhere."""
    index = markers.select(F.col("name").alias("marker"), "idx")
    entry = F.struct(F.col("idx").alias("at"), F.col(value).alias("value"))
    packed = channels.join(index, "marker").groupBy(*by).agg(F.collect_list(entry).alias("_entries"))
    return packed.select(*by, scatter(F.col("_entries"), n_markers).alias("dense"))


# --- row filters ---------------------------------------------------------------------------------------


def known_labels(df: DataFrame, label: str, vocab: DataFrame) -> DataFrame:
    return df.join(vocab.select(F.col("name").alias(label)), label, "left_semi")


def seen_classes(rows: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """Rows whose class occurs in the training rows."""
    return rows.join(settle(train.select(label).distinct()), label, "left_semi")


def keep_skip(df: DataFrame, column: str, keep: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """Keep or skip the listed keys; giving both lists is an error."""
    if keep is not None and skip is not None:
        raise ValueError("give either keep or skip, not both")
    if keep is not None:
        return df.join(keep.select(column), column, "left_semi")
    if skip is not None:
        return df.join(skip.select(column), column, "left_anti")
    return df


def limit_fovs(df: DataFrame, n: int, column: str = "fov_key") -> DataFrame:
    """Rows of the first ``n`` fields in key order."""
    first = df.select(column).distinct().orderBy(column).limit(n)
    return df.join(settle(first), column, "left_semi")
