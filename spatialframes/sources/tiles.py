"""Image tiles: one row per (field, channel, tile) with its pixels as a row-major array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialframes.session import settle


def pixels_to_tiles(pixels: DataFrame, height: int, width: int, shapes: DataFrame | None = None) -> DataFrame:
    """Tiles of at most ``height`` x ``width``; a pixel the tile lacks is NULL.

    A tile reaches as far as the field does, so the tiles of all channels and of the mask have the
    same extent. ``shapes(fov_key, n_rows, n_cols)`` tells the field's; without it, the last pixel
    of any channel does.

    A tile bounds what one group holds, whatever the size of the field. Full tiles, the rule for
    images, are put in order by one sort; only a tile with holes is filled position by position.
    """
    tile_r, tile_c = F.floor(F.col("row") / height), F.floor(F.col("col") / width)
    placed = pixels.select(
        "fov_key",
        "channel",
        tile_r.cast("int").alias("tile_r"),
        tile_c.cast("int").alias("tile_c"),
        F.struct(
            (F.col("row") - tile_r * height).cast("int").alias("r"),
            (F.col("col") - tile_c * width).cast("int").alias("c"),
            F.col("value").alias("value"),
        ).alias("_p"),
    )
    packed = placed.groupBy("fov_key", "channel", "tile_r", "tile_c").agg(
        F.array_sort(F.collect_list("_p")).alias("_p")
    )
    if shapes is None:
        shapes = pixels.groupBy("fov_key").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    packed = packed.join(settle(shapes.select("fov_key", "n_rows", "n_cols")), "fov_key")
    reach = lambda n, at, most: F.least(F.lit(most), F.col(n) - F.col(at) * most).cast("int")
    packed = packed.withColumn("h", reach("n_rows", "tile_r", height)).withColumn("w", reach("n_cols", "tile_c", width))
    size = F.col("h") * F.col("w")
    at = F.map_from_entries(F.transform("_p", lambda p: F.struct((p["r"] * F.col("w") + p["c"]).alias("k"), p["value"].alias("v"))))
    holed = packed.withColumn("_at", F.when(F.size("_p") < size, at))
    values = F.when(F.col("_at").isNull(), F.transform("_p", lambda p: p["value"])).otherwise(
        F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("_at")[i])
    )
    return holed.select("fov_key", "channel", "tile_r", "tile_c", F.lit(height).alias("tile_h"), F.lit(width).alias("tile_w"), "h", "w", values.alias("values"))


def tiles_to_pixels(tiles: DataFrame) -> DataFrame:
    spread = tiles.select("fov_key", "channel", "tile_r", "tile_c", "tile_h", "tile_w", "w", F.posexplode("values").alias("pos", "value"))
    spread = spread.where(F.col("value").isNotNull())
    return spread.select(
        "fov_key",
        "channel",
        (F.col("tile_r") * F.col("tile_h") + F.floor(F.col("pos") / F.col("w"))).cast("int").alias("row"),
        (F.col("tile_c") * F.col("tile_w") + F.col("pos") % F.col("w")).cast("int").alias("col"),
        "value",
    )


def hook_on_tiles(tiles: DataFrame, hook) -> DataFrame:
    """Run ``hook(raw, names) -> raw`` on numpy arrays of shape (channels, h, w), one tile at a time.

    For hooks that are written on arrays and look at one pixel across its channels; statistics over
    a whole channel belong in a DataFrame hook. The result must keep the shape and be finite and in
    [0, 1] up to 1e-6. A missing pixel comes in as NaN and stays missing. Many tiles share an Arrow batch.
    """

    every = tiles.columns
    columns = [c for c in every if c != "channel"]
    stacks = tiles.groupBy("fov_key", "tile_r", "tile_c").agg(F.array_sort(F.collect_list(F.struct("channel", *columns))).alias("_tiles"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            stack, flat = batch.column("_tiles"), batch.column("_tiles").flatten()
            field = lambda c: pa.compute.struct_field(flat, [c])  # noqa: E731, B023
            lengths = pa.compute.list_value_length(field("values")).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            values = field("values").flatten().to_numpy(zero_copy_only=False).astype("float64")
            there, names = ~np.isnan(values), field("channel").to_pylist()
            h, w = (field(c).to_numpy(zero_copy_only=False) for c in ("h", "w"))
            at = 0
            for n in pa.compute.list_value_length(stack).to_pylist():
                own = slice(ends[at], ends[at + n])
                raw = values[own].reshape(n, h[at], w[at])
                out = np.asarray(hook(raw.copy(), names[at : at + n]), dtype="float64")
                if out.shape != raw.shape:
                    raise ValueError(f"hook changed the shape of a tile from {raw.shape} to {out.shape}")
                kept = out.ravel()[there[own]]
                if not np.isfinite(kept).all() or (kept < -1e-6).any() or (kept > 1 + 1e-6).any():
                    raise ValueError("hook result must be finite and in [0, 1]")
                values[own] = out.ravel()
                at += n
            kind = field("values").type
            hooked = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, mask=~there).cast(kind.value_type))
            yield pa.RecordBatch.from_arrays([hooked if c == "values" else field(c) for c in every], names=every)

    return stacks.select("_tiles").mapInArrow(run, tiles.schema)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Partitioned by channel, so that a read of some channels lists only their files."""
    tiles.write.partitionBy("channel").parquet(path)


def read_tiles(spark: SparkSession, path: str, channels: list[str] | None = None) -> DataFrame:
    tiles = spark.read.parquet(path)
    return tiles if channels is None else tiles.where(F.col("channel").isin(channels))
