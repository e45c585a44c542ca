"""Conditioning of image tiles: statistics leave a tile as counts, values change inside their arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.functions.quantiles import exact_quantiles
from spatialframes.operators import signal
from spatialframes.operators.patches import needs_resampling, resolution_scales
from spatialframes.operators.tile_ops import resample_bilinear_tiles, resample_nearest_tiles
from spatialframes.session import settle

CHANNEL = signal.CHANNEL


def flat(tiles: DataFrame) -> DataFrame:
    """``fov_key, channel, value`` of the pixels that are there, for aggregates that combine before they shuffle."""
    return tiles.select(*CHANNEL, F.explode("values").alias("value")).where(F.col("value").isNotNull())


def profile(tiles: DataFrame, finite: bool = False) -> DataFrame:
    """:func:`~spatialframes.operators.signal.profile` of tiles: one scan, pixels exist inside partial sums only."""
    return signal.profile(flat(tiles), finite)


def nonzero_percentile(tiles: DataFrame, p: float, known: DataFrame) -> DataFrame:
    """Per channel percentile of the pixels that are not zero.

    Only values of the two octave steps next to the percentile leave their tile, and these as counts.
    """
    steps = known.where((F.col("_octave") != 0) & F.col("_octave").isNotNull())
    ranges = settle(_wanted(steps, p))
    near = tiles.join(ranges, CHANNEL)
    inside = lambda v: F.exists("_ranges", lambda r: (v >= r["low"]) & (v <= r["high"]))
    near = near.select(*CHANNEL, F.filter("values", lambda v: v.isNotNull() & (v != 0) & inside(v)).alias("values"))
    return exact_quantiles(flat(near), CHANNEL, "value", {"q": p / 100.0}, steps)


def _wanted(steps: DataFrame, p: float) -> DataFrame:
    """``_ranges`` of the octave steps that hold the order statistics next to the percentile."""
    whole, sofar = Window.partitionBy(*CHANNEL), Window.partitionBy(*CHANNEL).orderBy("_octave")
    counted = steps.withColumn("_to", F.sum("_count").over(sofar)).withColumn("_at", (F.sum("_count").over(whole) - 1) * F.lit(p / 100.0))
    holds = (F.col("_to") > F.floor("_at")) & (F.col("_to") - F.col("_count") <= F.ceil("_at"))
    held = counted.where(holds).groupBy(*CHANNEL)
    return held.agg(F.collect_list(F.struct(F.col("_low").alias("low"), F.col("_high").alias("high"))).alias("_ranges"))


def _changed(tiles: DataFrame, extra: list[str], change) -> DataFrame:
    """Tiles whose values are ``change(values, *extra)`` on a numpy array, tile by tile; ``extra`` columns go."""
    schema = tiles.drop(*extra).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("values")
            lists = batch.column(at)
            numbers = lists.flatten()
            values = numbers.to_numpy(zero_copy_only=False).astype("float64")
            lengths = np.asarray(pa.compute.list_value_length(lists))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            given = [batch.column(batch.schema.get_field_index(e)).to_pylist() for e in extra]
            out = np.empty_like(values)
            for i in range(batch.num_rows):
                out[ends[i] : ends[i + 1]] = change(values[ends[i] : ends[i + 1]], *[g[i] for g in given])
            missing = np.asarray(numbers.is_null())
            done = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, mask=missing if missing.any() else None))
            columns = [done if f.name == "values" else batch.column(batch.schema.get_field_index(f.name)) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return tiles.mapInArrow(run, schema)


def clip_and_normalize(tiles: DataFrame, p: float, known: DataFrame | None = None) -> DataFrame:
    """Clip every channel at its percentile and scale it to [0, 1]; a channel of one value becomes zeros."""
    known = profile(tiles) if known is None else known
    stats = signal.channel_range(known).join(nonzero_percentile(tiles, p, known).drop("n_values"), CHANNEL, "left")
    low, high = F.least("_min", "q"), F.least("_max", "q")
    stats = stats.select(*CHANNEL, F.coalesce("q", F.lit(float("inf"))).alias("_q"), low.alias("_low"), F.when(high == low, F.lit(1.0)).otherwise(high - low).alias("_width"))
    joined = tiles.join(settle(stats), CHANNEL)
    return _changed(joined, ["_q", "_low", "_width"], lambda v, q, low, width: (np.minimum(v, q) - low) / width).select(tiles.columns)


def checked(tiles: DataFrame, low: float = 0.0, high: float = 1.0, slack: float = 1e-6) -> DataFrame:
    """The tiles; reading one with a value that is not finite or leaves [low, high] raises. No pass of its own."""
    bad = F.exists("values", lambda v: v.isNull() | F.isnan(v) | (v < low - slack) | (v > high + slack))
    told = F.concat_ws(" ", F.lit("a tile of field"), F.col("fov_key").cast("string"), F.lit(signal.CONTRACT))
    return tiles.withColumn("values", F.when(bad, F.raise_error(told).cast("array<double>")).otherwise(F.col("values")))


def to_resolution(tiles: DataFrame, mask_tiles: DataFrame, fovs: DataFrame, target_mpp: float, slack: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Tiles and label tiles at ``target_mpp``; fields closer to it than ``slack`` stay as they are.

    Resampled tiles are written once, as their statistics and their values are read.
    """
    scales, any_moves = resolution_scales(fovs, target_mpp, slack)
    if not any_moves:
        return tiles, mask_tiles
    moves = needs_resampling(F.col("scale"), slack)
    moved, kept = scales.where(moves), scales.where(~moves).select("fov_key")
    same = lambda t: t.join(kept, "fov_key", "left_semi")
    signals = settle(resample_bilinear_tiles(tiles.join(moved.select("fov_key"), "fov_key", "left_semi"), moved))
    labels = settle(resample_nearest_tiles(mask_tiles.join(moved.select("fov_key"), "fov_key", "left_semi"), moved))
    return signals.unionByName(same(tiles).select(signals.columns)), labels.unionByName(same(mask_tiles).select(labels.columns))


def centroids(mask_tiles: DataFrame) -> DataFrame:
    """Mean pixel position of each label; places exist inside partial sums only."""
    spread = mask_tiles.select("fov_key", "tile_r", "tile_c", "tile_h", "tile_w", "w", F.posexplode("labels").alias("pos", "cell_id"))
    spread = spread.where(F.col("cell_id") != 0)
    row = F.col("tile_r") * F.col("tile_h") + F.floor(F.col("pos") / F.col("w"))
    col = F.col("tile_c") * F.col("tile_w") + F.col("pos") % F.col("w")
    return spread.groupBy("fov_key", "cell_id").agg(F.avg(row).alias("c_row"), F.avg(col).alias("c_col"))


def cell_ids(mask_tiles: DataFrame) -> DataFrame:
    labels = mask_tiles.select("fov_key", F.explode(F.array_distinct("labels")).alias("cell_id"))
    return labels.where(F.col("cell_id") != 0).distinct()
