"""Windows round cells cut from image tiles: one row per cell with its whole channel stack.

A window meets at most four tiles that are as wide as itself. The channels, the labels and the windows of a
tile meet by its key in one exchange, numpy cuts each window's rectangle from all channels at once, and a cell's
rectangles meet by the cell. So a pixel travels once with its tile and once with each window it lies in,
as part of an array. What one task holds is a tile with its panel, or a window with its panel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialframes.operators.patches import CROP, distance_to_edge, windows
from spatialframes.operators.tile_ops import gaussian_kernel
from spatialframes.session import settle

CELL = ["fov_key", "cell_id"]
TILE = ["fov_key", "tile_r", "tile_c"]


def _met(first: Column, crop: int, tile: Column, n_tiles: Column) -> Column:
    """Numbers of the tiles that a window's stretch of an axis meets; none if it lies outside the image."""
    low, high = F.greatest(F.floor(first / tile), F.lit(0)), F.least(F.floor((first + crop - 1) / tile), n_tiles - 1)
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _windows_by_tile(cells: DataFrame, mask_tiles: DataFrame, crop: int, center: str) -> DataFrame:
    """``TILE, wins``: the windows that meet each tile; as many as there are cells near it."""
    grid = mask_tiles.groupBy("fov_key").agg(
        F.max("tile_h").alias("tile_h"), F.max("tile_w").alias("tile_w"), (F.max("tile_r") + 1).alias("down"), (F.max("tile_c") + 1).alias("across")
    )
    boxes = windows(cells, crop, center).join(settle(grid), "fov_key")
    boxes = boxes.withColumn("tile_r", F.explode(_met(F.col("r0"), crop, F.col("tile_h"), F.col("down"))))
    boxes = boxes.withColumn("tile_c", F.explode(_met(F.col("c0"), crop, F.col("tile_w"), F.col("across"))))
    one = F.struct(F.col("cell_id").cast("bigint").alias("cell_id"), "r0", "c0")
    return boxes.groupBy("fov_key", F.col("tile_r").cast("int").alias("tile_r"), F.col("tile_c").cast("int").alias("tile_c")).agg(F.collect_list(one).alias("wins"))


def _loaded(tiles: DataFrame, mask_tiles: DataFrame, wins: DataFrame) -> DataFrame:
    """Tiles that a window meets, with the values of all channels, the labels and the windows."""
    parts = [
        tiles.select(*TILE, F.struct("channel", "values").alias("signal")),
        mask_tiles.select(*TILE, "tile_h", "tile_w", "h", "w", F.col("labels").cast("array<bigint>").alias("labels")),
        wins.select(*TILE, "wins"),
    ]
    met = parts[0].unionByName(parts[1], True).unionByName(parts[2], True).groupBy(*TILE)
    single = ["tile_h", "tile_w", "h", "w", "labels", "wins"]
    loaded = met.agg(F.collect_list("signal").alias("signal"), *[F.first(c, ignorenulls=True).alias(c) for c in single])
    return loaded.where(F.col("wins").isNotNull())


_PIECE = "cell_id bigint, pr int, pc int, rows int, cols int, values array<double>, labels array<bigint>"


def _cut(loaded: DataFrame, crop: int) -> DataFrame:
    """One row per window and tile: its rectangle of all channels, in panel order, and of the labels."""
    names = [f.name for f in T.StructType.fromDDL(_PIECE)]
    schema = T.StructType([loaded.schema["fov_key"], *T.StructType.fromDDL(_PIECE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            for i in range(batch.num_rows):
                signal, panel = column("signal").slice(i, 1).flatten(), column("panel")[i].as_py()
                tile_r, tile_c, tile_h, tile_w, h, w = (column(c)[i].as_py() for c in ("tile_r", "tile_c", "tile_h", "tile_w", "h", "w"))
                values = pa.compute.struct_field(signal, ["values"])
                labels = column("labels").slice(i, 1).flatten()
                found = pa.compute.struct_field(signal, ["channel"]).to_pylist()
                if h is None or len(labels) != h * w or labels.null_count or len(values.flatten()) != len(found) * h * w or values.flatten().null_count:
                    raise ValueError("tile with missing pixels")
                if sorted(found) != sorted(panel):
                    raise ValueError("tile without some channel of its field")
                stack = values.flatten().to_numpy(zero_copy_only=False).reshape(len(found), h, w)
                stack = stack[[found.index(c) for c in panel]]
                labels = labels.to_numpy(zero_copy_only=False).reshape(h, w)
                rows = []
                for win in column("wins")[i].as_py():
                    top, left = max(win["r0"], tile_r * tile_h), max(win["c0"], tile_c * tile_w)
                    low, right = min(win["r0"] + crop, tile_r * tile_h + h), min(win["c0"] + crop, tile_c * tile_w + w)
                    if top >= low or left >= right:
                        continue
                    at = slice(top - tile_r * tile_h, low - tile_r * tile_h), slice(left - tile_c * tile_w, right - tile_c * tile_w)
                    rows.append((win["cell_id"], top - win["r0"], left - win["c0"], low - top, right - left, stack[:, *at].ravel(), labels[at].ravel()))
                if rows:
                    own = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:5], (pa.int64(), *[pa.int32()] * 4), strict=True)]
                    own += [_lists([r[5] for r in rows]), _lists([r[6] for r in rows])]
                    field = pa.array([column("fov_key")[i].as_py()] * len(rows), batch.schema.field("fov_key").type)
                    yield pa.RecordBatch.from_arrays([field, *own], names=["fov_key", *names])

    return loaded.mapInArrow(run, schema)


BATCH_BYTES = 8 << 20  # fixed value: what a task's Python makes of windows before it hands them on


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays)))


# --- another size -------------------------------------------------------------------------------------------


def resize_weights(n: int, size: int) -> np.ndarray:
    """Weights (size x n) of the source pixels of each output of an axis.

    Before shrinking the axis is smoothed by a Gaussian of sigma ``(n / size - 1) / 2``, cut at four sigma; then it is
    interpolated linearly at pixel centres. Beyond an end the axis is mirrored without repeating the end pixel.
    """

    def mirror(i: int) -> int:
        if n == 1:
            return 0
        i = abs(i) % (2 * n - 2)
        return 2 * n - 2 - i if i >= n else i

    smooth = np.eye(n)
    sigma = (n / size - 1) / 2
    if sigma > 0:
        smooth = np.zeros((n, n))
        kernel = gaussian_kernel(sigma)
        for i in range(n):
            for d, weight in enumerate(kernel, -(len(kernel) // 2)):
                smooth[i, mirror(i + d)] += weight
    take = np.zeros((size, n))
    for o in range(size):
        at = (o + 0.5) * n / size - 0.5
        low = int(np.floor(at))
        take[o, mirror(low)] += 1 - (at - low)
        take[o, mirror(low + 1)] += at - low
    return take @ smooth


def nearest_index(n: int, size: int) -> np.ndarray:
    """Source pixel of each output of an axis, for masks."""
    return np.minimum(((np.arange(size) + 0.5) * n / size).astype(int), n - 1)


# --- whole windows ------------------------------------------------------------------------------------------

PLANES = ["self_mask", "neighbor_mask", "distance"]


def cell_windows(
    cells: DataFrame,
    tiles: DataFrame,
    mask_tiles: DataFrame,
    crop: int = CROP,
    center: str = "round",
    output_size: int | None = None,
    own_only: bool = True,
    panel: DataFrame | None = None,
    channels: bool = True,
) -> DataFrame:
    """``fov_key, cell_id, panel, stack, self_mask, neighbor_mask, distance``: one row for every row of ``cells``.

    ``stack`` holds the windows of the field's channels one after the other, row-major, in the order of
    ``panel(fov_key, panel)`` (names in order, else by name). What lies outside the image is zero. With ``own_only``
    only the cell's own pixels keep their value. ``neighbor_mask`` marks the pixels of other cells; ``distance`` is the
    distance to the cell's edge over its maximum. With ``output_size`` signals are resized with smoothing and masks by
    their nearest pixel, before the distance is taken and before own pixels are kept. Without ``channels``
    the signal tiles are not read and the stack is empty.
    """
    if panel is None:
        panel = tiles.select("fov_key", "channel").distinct().groupBy("fov_key").agg(F.array_sort(F.collect_list("channel")).alias("panel"))
    if not channels:
        panel = panel.select("fov_key", F.array().cast("array<string>").alias("panel"))
        tiles = tiles.limit(0)
    panel = settle(panel.select("fov_key", "panel"))
    cells = cells.select(*CELL, "c_row", "c_col")
    wanted = tiles.join(panel.select("fov_key", F.explode("panel").alias("channel")), ["fov_key", "channel"], "left_semi")
    loaded = _loaded(wanted, mask_tiles, _windows_by_tile(cells, mask_tiles, crop, center)).join(panel, "fov_key")
    pieces = _cut(loaded, crop).select(*CELL, F.struct("pr", "pc", "rows", "cols", "values", "labels").alias("piece"))
    # a cell whose window meets no tile still has a row
    every = cells.select(*CELL).unionByName(pieces, allowMissingColumns=True)
    gathered = every.groupBy(*CELL).agg(F.collect_list("piece").alias("pieces")).join(panel, "fov_key", "left")
    size = output_size or crop
    arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("stack", *PLANES)]
    schema = T.StructType([gathered.schema["fov_key"], gathered.schema["cell_id"], T.StructField("panel", T.ArrayType(T.StringType())), *arrays])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink, nearest = (resize_weights(crop, size), nearest_index(crop, size)) if size != crop else (None, None)
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            panels = column("panel").to_pylist()
            ids = column("cell_id").to_pylist()
            flat = column("pieces").flatten()
            frame = [np.asarray(pa.compute.struct_field(flat, [n])) for n in ("pr", "pc", "rows", "cols")]
            values, labels = pa.compute.struct_field(flat, ["values"]), pa.compute.struct_field(flat, ["labels"])
            at, first, held, out = 0, 0, 0, []

            def made(end: int) -> pa.RecordBatch:
                done = [_lists([o[k] for o in out]) for k in range(4)]  # noqa: B023
                whole = [column(c).slice(first, end - first) for c in ("fov_key", "cell_id", "panel")]  # noqa: B023
                whole[2] = whole[2].fill_null(pa.scalar([], batch.schema.field("panel").type))  # noqa: B023
                return pa.RecordBatch.from_arrays([*whole, *done], names=[f.name for f in schema])

            for i, n in enumerate(pa.compute.list_value_length(column("pieces")).to_pylist()):
                depth = len(panels[i] or [])
                stack, label = np.zeros((depth, crop, crop)), np.zeros((crop, crop), dtype="int64")
                for p in range(at, at + n):
                    pr, pc, rows, cols = (int(f[p]) for f in frame)
                    place = slice(pr, pr + rows), slice(pc, pc + cols)
                    stack[:, *place] = values.slice(p, 1).flatten().to_numpy(zero_copy_only=False).reshape(depth, rows, cols)
                    label[place] = labels.slice(p, 1).flatten().to_numpy(zero_copy_only=False).reshape(rows, cols)
                at += n
                own, other = label == ids[i], (label != ids[i]) & (label != 0)
                if size != crop:
                    stack = shrink @ stack @ shrink.T
                    own, other = own[nearest][:, nearest], other[nearest][:, nearest]
                if own_only:
                    stack = stack * own
                out.append([stack.ravel(), own.ravel().astype(float), other.ravel().astype(float), distance_to_edge(own).ravel()])
                # a batch has rows by the thousand, whatever a window takes
                held += (depth + len(PLANES)) * size * size * 8
                if held >= BATCH_BYTES:
                    yield made(i + 1)
                    first, held, out = i + 1, 0, []
            if out:
                yield made(batch.num_rows)

    return gathered.mapInArrow(run, schema)


# --- scoring of windows -------------------------------------------------------------------------------------

PADDING = -1.0  # fixed value: what fills the channels that a cell of a batch lacks


def score_windows(cells: DataFrame, load, size: int = CROP, positions: str = "positions", out: str = "logits") -> DataFrame:
    """Score :func:`cell_windows` rows with a user model, as :func:`~spatialframes.operators.scoring.batch_score` does vectors.

    ``load()`` runs once per task and returns ``f(sample, context, positions, absent) -> logits``: ``sample`` is
    (cells, channels, 1, size, size), ``context`` (cells, 3, size, size) with own, neighbours and distance, ``positions``
    (cells, channels) the channels' places in the registry, -1 where a cell has no more, and ``absent`` True there. Stacks
    are ragged in the table; they are padded to the widest of a batch only, and a batch takes ``BATCH_BYTES`` at most, or
    is one cell.
    """
    whole = [f for f in cells.schema.fields if f.name not in ("stack", *PLANES)]
    schema = T.StructType([*whole, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth = pa.compute.list_value_length(batch.column(batch.schema.get_field_index(positions))).to_pylist()
            first, widest = 0, 0
            for i, n in enumerate(depth):
                if i > first and (i + 1 - first) * (max(widest, n) + len(PLANES)) * size * size * 8 > BATCH_BYTES:
                    yield batch.slice(first, i - first)
                    first, widest = i, 0
                widest = max(widest, n)
            if first < len(depth):
                yield batch.slice(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in parts(batches):
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            depth = np.asarray(pa.compute.list_value_length(column(positions)))
            widest = int(depth.max())
            there = np.arange(widest) < depth[:, None]
            sample = np.full((batch.num_rows, widest, size * size), PADDING)
            sample[there] = column("stack").flatten().to_numpy(zero_copy_only=False).reshape(-1, size * size)
            places = np.full((batch.num_rows, widest), -1, dtype="int64")
            places[there] = column(positions).flatten().to_numpy(zero_copy_only=False)
            planes = [column(p).flatten().to_numpy(zero_copy_only=False).reshape(-1, size, size) for p in PLANES]
            logits = model(sample.reshape(batch.num_rows, widest, 1, size, size), np.stack(planes, axis=1), places, ~there)
            logits = np.asarray(logits, dtype="float64")
            kept = [column(f.name) for f in whole]
            yield pa.RecordBatch.from_arrays([*kept, _lists(list(logits))], names=[f.name for f in schema])

    return cells.mapInArrow(run, schema)
