"""Neighbourhood work on image tiles: a tile's pixels travel as arrays, never one by one.

An operator names, for each axis, the stretch of the image that each of its result tiles needs. A tile cuts
from its own array the rectangles that its neighbours need, the rectangles of a result tile meet by its key in
one exchange, and numpy works on their union. Only the rectangle that a tile keeps for itself is large; what a
filter sends on is a strip as wide as its reach. What a task holds at once is a result tile and its reach.

Every pixel of a field has to be there. A missing one raises, as it does for image lines.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialframes.operators.patches import new_length
from spatialframes.session import settle

KEY = ["fov_key", "channel"]
EXTENT = ["tile_h", "tile_w", "n_rows", "n_cols"]

_SPAN = "array<struct<t:int,lo:int,n:int>>"


def extents(tiles: DataFrame) -> DataFrame:
    """``fov_key, n_rows, n_cols`` of the fields; reads no pixel."""
    return tiles.groupBy("fov_key").agg(
        F.max(F.col("tile_r") * F.col("tile_h") + F.col("h")).alias("n_rows"),
        F.max(F.col("tile_c") * F.col("tile_w") + F.col("w")).alias("n_cols"),
    )


def spans(first: Column, n: Column, targets: Column, need: Callable[[Column], tuple[Column, Column]]) -> Column:
    """What of ``[first, first + n)`` each target number needs: ``t``, the first position ``lo`` and how many.

    ``need(t)`` gives the first and last position that result tile ``t`` needs.
    """

    def part(t: Column) -> Column:
        low, high = need(t)
        low, high = F.greatest(low, first), F.least(high, first + n - 1)
        return F.struct(t.cast("int").alias("t"), low.cast("int").alias("lo"), (high - low + 1).cast("int").alias("n"))

    return F.filter(F.transform(targets, part), lambda p: p["n"] > 0).cast(_SPAN)


def send(tiles: DataFrame, rows: Column, cols: Column, values: str = "values") -> DataFrame:
    """One row per (tile, result tile that needs a part of it): the key of the latter, and the rectangle."""
    top, left = F.col("tile_r") * F.col("tile_h"), F.col("tile_c") * F.col("tile_w")

    def rectangle(r: Column, c: Column) -> Column:
        lines = F.sequence(r["lo"] - top, r["lo"] - top + r["n"] - 1)
        cut = F.flatten(F.transform(lines, lambda i: F.slice(F.col(values), i * F.col("w") + c["lo"] - left + 1, c["n"])))
        whole = (r["n"] == F.col("h")) & (c["n"] == F.col("w"))
        return F.struct(
            r["t"].alias("t_r"), c["t"].alias("t_c"), r["lo"].alias("top"), c["lo"].alias("left"), r["n"].alias("rows"), c["n"].alias("cols"),
            F.when(whole, F.col(values)).otherwise(cut).alias("values"),
        )

    sent = F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: rectangle(r, c))))
    kept = [c for c in tiles.columns if c not in ("tile_r", "tile_c", "h", "w", values)]
    return tiles.select(*kept, F.explode(sent).alias("piece"))


def gather(sent: DataFrame) -> DataFrame:
    """The rectangles by result tile, as ``pieces``; a result tile has as many as tiles meet its reach."""
    whole = [c for c in sent.columns if c != "piece"]
    met = sent.select(*whole, F.col("piece.t_r").alias("tile_r"), F.col("piece.t_c").alias("tile_c"), F.col("piece").dropFields("t_r", "t_c").alias("piece"))
    return met.groupBy(*whole, "tile_r", "tile_c").agg(F.collect_list("piece").alias("pieces"))


def rectangles(batch: pa.RecordBatch, column: str = "pieces") -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Of every row of a batch its rectangles as ``(top, left, pixels)``; a missing pixel raises."""
    lists = batch.column(batch.schema.get_field_index(column))
    flat = lists.flatten()
    top, left, rows, cols = (np.asarray(pa.compute.struct_field(flat, [n])) for n in ("top", "left", "rows", "cols"))
    arrays = pa.compute.struct_field(flat, ["values"])
    pixels = arrays.flatten()
    if pixels.null_count:
        raise ValueError("tile with missing pixels")
    pixels = pixels.to_numpy(zero_copy_only=False)
    ends = np.cumsum(rows.astype("int64") * cols)
    if len(pixels) != (ends[-1] if len(ends) else 0):
        raise ValueError("tile of another size than it says")
    at = 0
    for n in pa.compute.list_value_length(lists).to_pylist():
        own = range(at, at + (n or 0))
        yield [(int(top[i]), int(left[i]), pixels[ends[i] - rows[i] * cols[i] : ends[i]].reshape(rows[i], cols[i])) for i in own]
        at += n or 0


def region(pieces: list[tuple[int, int, np.ndarray]], row: int, col: int, height: int, width: int) -> np.ndarray:
    """The rectangle at ``(row, col)`` put together; a place that no piece covers raises."""
    out = np.empty((height, width), dtype=pieces[0][2].dtype if pieces else "float64")
    covered = 0
    for top, left, pixels in pieces:
        out[top - row : top - row + pixels.shape[0], left - col : left - col + pixels.shape[1]] = pixels
        covered += pixels.size
    if covered != out.size:
        raise ValueError("tile with missing neighbours")
    return out


def on_regions(gathered: DataFrame, compute: Callable[[dict, list], np.ndarray], kind: T.DataType = T.DoubleType(), values: str = "values") -> DataFrame:
    """Tiles whose pixels are ``compute(row, rectangles)``, where ``row`` holds the other columns of the gathered row."""
    whole = [c for c in gathered.columns if c != "pieces"]
    fields = [gathered.schema[c] for c in (*KEY, "tile_r", "tile_c")] + [T.StructField(c, T.IntegerType()) for c in ("tile_h", "tile_w", "h", "w")]
    schema = T.StructType([*fields, T.StructField(values, T.ArrayType(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in whole}
            for i, pieces in enumerate(rectangles(batch)):
                row = {c: v[i] for c, v in named.items()}
                out = compute(row, pieces)
                found = [row[c] for c in (*KEY, "tile_r", "tile_c", "tile_h", "tile_w")] + [*out.shape, out.ravel()]
                # one tile a batch: what is under way stays as small as a tile
                columns = [batch.column(batch.schema.get_field_index(c)).slice(i, 1) for c in KEY]
                columns += [pa.array([v], pa.int32()) for v in found[2:8]]
                flat = pa.array(found[8])
                columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return gathered.mapInArrow(run, schema)


# --- filters ------------------------------------------------------------------------------------------------


def _reach(n_tiles: Column, tile: Column, size: Column, reach: int, index: Column) -> tuple[Column, Callable]:
    """Result tiles that a tile can serve, and what a result tile needs, for a filter of a given reach."""
    ring = F.ceil(F.lit(reach) / tile)
    targets = F.sequence(F.greatest(index - ring, F.lit(0)), F.least(index + ring, n_tiles - 1))

    def need(t: Column) -> tuple[Column, Column]:
        return t * tile - reach, F.least((t + 1) * tile, size) - 1 + reach

    return targets, need


def halos(tiles: DataFrame, reach: int) -> DataFrame:
    """Every tile with what lies within ``reach`` of it: strips of its neighbours, eight of them where tiles are
    at least as wide as the reach."""
    full = tiles.join(settle(extents(tiles)), "fov_key")
    axes = []
    for index, tile, size, n in (("tile_r", "tile_h", "n_rows", "h"), ("tile_c", "tile_w", "n_cols", "w")):
        index, tile, size = F.col(index), F.col(tile), F.col(size)
        targets, need = _reach(F.ceil(size / tile), tile, size, reach, index)
        axes.append(spans(index * tile, F.col(n), targets, need))
    return gather(send(full, *axes))


def _with_halo(row: dict, pieces: list, before: int, after: int) -> np.ndarray:
    """The tile with its halo; beyond the image the half-sample symmetric extension, d c b a | a b c d | d c b a."""
    edges, pads = [], []
    for index, tile, size in (("tile_r", "tile_h", "n_rows"), ("tile_c", "tile_w", "n_cols")):
        first = row[index] * row[tile]
        last = min(first + row[tile], row[size])
        reach = max(before, after)
        low, high = max(first - reach, 0), min(last + reach, row[size])
        edges.append((low, high, first, last))
        pads.append((reach - (first - low), reach - (high - last)))
    (r0, r1, fr, lr), (c0, c1, fc, lc) = edges
    full = np.pad(region(pieces, r0, c0, r1 - r0, c1 - c0), pads, mode="symmetric")
    reach = max(before, after)
    return full[reach - before : reach + (lr - fr) + after, reach - before : reach + (lc - fc) + after]


def denoise_median_tiles(tiles: DataFrame, size: int = 3) -> DataFrame:
    """Median of a size x size window, the upper middle element for an even count."""
    before, after = size // 2, size - 1 - size // 2

    def compute(row: dict, pieces: list) -> np.ndarray:
        full = _with_halo(row, pieces, before, after)
        views = np.lib.stride_tricks.sliding_window_view(full, (size, size))
        middle = size * size // 2
        return np.partition(views.reshape(*views.shape[:2], size * size), middle, axis=2)[:, :, middle]

    return on_regions(halos(tiles, max(before, after)), compute)


def gaussian_kernel(sigma: float) -> np.ndarray:
    """Weights of a Gaussian cut at four sigma."""
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    return np.array([w / sum(raw) for w in raw])


def denoise_gaussian_tiles(tiles: DataFrame, size: int = 3) -> DataFrame:
    """Gaussian of sigma size / 2, cut at four sigma, one pass per axis."""
    kernel = gaussian_kernel(size / 2.0)
    radius = len(kernel) // 2

    def compute(row: dict, pieces: list) -> np.ndarray:
        full = _with_halo(row, pieces, radius, radius)
        for axis in (0, 1):
            full = np.lib.stride_tricks.sliding_window_view(full, len(kernel), axis=axis) @ kernel
        return full

    return on_regions(halos(tiles, radius), compute)


def denoise_tiles(tiles: DataFrame, kind: str = "median", size: int = 3) -> DataFrame:
    if kind == "median":
        return denoise_median_tiles(tiles, int(size))
    if kind == "gaussian":
        return denoise_gaussian_tiles(tiles, int(size))
    raise ValueError(f"unknown denoise kind {kind!r}")


# --- resampling ---------------------------------------------------------------------------------------------


def _resampled(tiles: DataFrame, scales: DataFrame, sources: Callable[[Column, Column, Column], tuple[Column, Column]], values: str) -> DataFrame:
    """Pieces by tile of the new image. ``sources(i, n, new)`` gives the first and last source position of output ``i``."""
    whole = settle(extents(tiles).join(scales.select("fov_key", "scale"), "fov_key"))
    for axis in ("rows", "cols"):
        whole = whole.withColumn(f"new_{axis}", new_length(F.col(f"n_{axis}"), F.col("scale")))
    full = tiles.join(whole.drop("scale"), "fov_key")
    axes = []
    for index, tile, axis, n in (("tile_r", "tile_h", "rows", "h"), ("tile_c", "tile_w", "cols", "w")):
        index, tile, size, new = F.col(index), F.col(tile), F.col(f"n_{axis}"), F.col(f"new_{axis}")
        # outputs that may look at this tile, one to either side for the neighbour that interpolation reads
        low = F.floor((index * tile - 1) * new / size) - 1
        high = F.ceil((index * tile + F.col(n) + 1) * new / size) + 1
        last = F.ceil(new / tile) - 1
        clamp = lambda at, tile=tile, last=last: F.greatest(F.least(F.floor(at / tile), last), F.lit(0))

        def need(t, tile=tile, size=size, new=new):
            first, _ = sources(t * tile, size, new)
            _, end = sources(F.least((t + 1) * tile, new) - 1, size, new)
            return first, end

        axes.append(spans(index * tile, F.col(n), F.sequence(clamp(low), clamp(high)), need))
    return gather(send(full, *axes, values=values))


def _positions(row: dict) -> list[tuple[np.ndarray, int, int]]:
    """Per axis the numbers of the outputs of a result tile, and the old and the new length."""
    out = []
    for index, tile, axis in (("tile_r", "tile_h", "rows"), ("tile_c", "tile_w", "cols")):
        first = row[index] * row[tile]
        out.append((np.arange(first, min(first + row[tile], row[f"new_{axis}"])), row[f"n_{axis}"], row[f"new_{axis}"]))
    return out


def resample_bilinear_tiles(tiles: DataFrame, scales: DataFrame) -> DataFrame:
    """Linear interpolation at pixel centres, edges held; tiles of the new image keep the old tile size."""

    def sources(i: Column, n: Column, new: Column) -> tuple[Column, Column]:
        low = F.floor((i + 0.5) * n / new - 0.5)
        hold = lambda x: F.greatest(F.least(x, n - 1), F.lit(0))
        return hold(low), hold(low + 1)

    def compute(row: dict, pieces: list) -> np.ndarray:
        weights = []
        for i, n, new in _positions(row):
            at = (i + 0.5) * n / new - 0.5
            low = np.floor(at)
            ends = np.clip(low, 0, n - 1).astype(int), np.clip(low + 1, 0, n - 1).astype(int)
            weights.append((*ends, at - low))
        (rl, rh, rp), (cl, ch, cp) = weights
        full = region(pieces, rl[0], cl[0], rh[-1] - rl[0] + 1, ch[-1] - cl[0] + 1)
        lines = full[rl - rl[0]] * (1.0 - rp)[:, None] + full[rh - rl[0]] * rp[:, None]
        return lines[:, cl - cl[0]] * (1.0 - cp) + lines[:, ch - cl[0]] * cp

    return on_regions(_resampled(tiles, scales, sources, "values"), compute)


def resample_nearest_tiles(tiles: DataFrame, scales: DataFrame, values: str = "labels") -> DataFrame:
    """Labels at another resolution: each output takes the source pixel its centre falls on."""

    def sources(i: Column, n: Column, new: Column) -> tuple[Column, Column]:
        at = F.least(F.floor((i + 0.5) / (new / n)), n - 1)
        return at, at

    def compute(row: dict, pieces: list) -> np.ndarray:
        rows, cols = (np.minimum(np.floor((i + 0.5) / (new / n)).astype(int), n - 1) for i, n, new in _positions(row))
        full = region(pieces, rows[0], cols[0], rows[-1] - rows[0] + 1, cols[-1] - cols[0] + 1)
        return full[rows - rows[0]][:, cols - cols[0]]

    return on_regions(_resampled(tiles, scales, sources, values), compute, T.LongType(), values)
