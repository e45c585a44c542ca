"""Class-balanced weights, caps, draws and orders, all seeded and reproducible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.functions.ordering import place, running_sum, seeded_key, seeded_rank, seeded_running_sum
from spatialframes.session import settle

_DRAW_DIGITS = 12


# --- weights -------------------------------------------------------------------------------------------


def class_weights(df: DataFrame, label: str, scheme: str = "sqrt", floor: int = 1000, normalize: bool = False) -> DataFrame:
    """``(label, n, weight)``: ``sqrt`` is sqrt(total / max(n, floor)), ``inverse`` is total / n.

    ``normalize`` scales so that the mean over the rows, not over the classes, is one.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = Window.partitionBy()  # over the class list
    total = F.sum("n").over(classes)
    if scheme == "sqrt":
        weight = F.sqrt(total / F.greatest(F.col("n"), F.lit(floor)))
    elif scheme in ("inverse", "equal"):
        weight = total / F.col("n")
    elif scheme == "none":
        weight = F.lit(1.0)
    else:
        raise ValueError(f"unknown weighting scheme {scheme!r}")
    out = counts.withColumn("weight", weight)
    if normalize:
        out = out.withColumn("weight", F.col("weight") * total / F.sum(F.col("n") * F.col("weight")).over(classes))
    return out


def with_weights(df: DataFrame, label: str, scheme: str = "sqrt", floor: int = 1000, normalize: bool = False) -> DataFrame:
    """Each row with the weight of its class; only the class table is joined."""
    weights = settle(class_weights(df, label, scheme, floor, normalize).select(label, "weight"))
    return df.join(weights, label)


# --- caps and pads -------------------------------------------------------------------------------------


def cap_per_class(df: DataFrame, label: str, cap: int | None, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``cap`` seeded rows of each class; no cap keeps everything."""
    if cap is None:
        return df
    return seeded_rank(df, [label], keys, seed, "_rank", "_n", limit=int(cap)).drop("_rank", "_n")


def cap_rows(df: DataFrame, cap: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    return seeded_rank(df, [], keys, seed, "_rank", "_n", limit=int(cap)).drop("_rank", "_n")


def class_pad(sample: DataFrame, full: DataFrame, label: str, order: str) -> DataFrame:
    """The sample plus the first full row of every class it misses."""
    missing = full.join(settle(sample.select(label).distinct()), label, "left_anti")
    first = missing.groupBy(label).agg(F.min_by(F.struct(*full.columns), F.col(order)).alias("r")).select("r.*")
    return sample.select(*full.columns).unionByName(first)


# --- draws ---------------------------------------------------------------------------------------------


def weighted_draw(df: DataFrame, weight: str, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows drawn with replacement, proportional to ``weight``, as ``(draw, keys...)``.

    Rows are laid end to end in seeded order, each as long as its weight relative to the largest, in
    whole steps of 1e-20 of it, so that lengths add up exactly at any scale of the weights; a draw
    is a point on that line. Weights that are not positive and finite are never drawn. Line and points meet by equal pieces
    of the line: a heavy row spans many pieces, so neither it nor its draws land in one task.
    """
    nothing = df.select(F.lit(0).cast("bigint").alias("draw"), *keys).limit(0)
    if n <= 0:
        return nothing
    value = F.col(weight).cast("double")
    value = F.when(~F.isnan(value) & (value > 0) & (value < float("inf")), value)
    largest = df.agg(F.max(value)).first()[0]
    if largest is None:
        return nothing
    rows = df.select(*keys, (value / F.lit(largest) * F.lit(1e20)).cast("decimal(22,0)").alias("_length")).where(F.col("_length") > 0)
    placed = place(rows, [], keys, seed, {"length": F.col("_length")})
    whole = placed.select(F.col("_total_length").cast("double").alias("length"), F.col("_total_rows").alias("rows")).first()
    if whole is None:
        return nothing
    total = whole["length"]
    # about as many pieces as draws: few points and few rows share one
    pieces = max(1, min(int(whole["rows"]), 4 * n))
    line = running_sum(placed, [], keys, "_length", "length", "_to").select(
        *keys, (F.col("_to") - F.col("_length")).cast("double").alias("_lo"), F.col("_to").cast("double").alias("_hi")
    )
    piece = lambda x: F.floor(x * pieces / F.lit(total))
    # in two steps, so that the array of the heaviest row stays short
    block = 1024
    first, last = piece(F.col("_lo")), piece(F.col("_hi"))
    spread = line.select("*", first.alias("_first"), last.alias("_last"))
    spread = spread.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_first") / block), F.floor(F.col("_last") / block))))
    start, stop = F.greatest("_first", F.col("_block") * block), F.least("_last", F.col("_block") * block + block - 1)
    spread = spread.select(*keys, "_lo", "_hi", F.explode(F.sequence(start, stop)).alias("_piece"))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("draw"), F.col("draw").cast("string"))), 1, _DRAW_DIGITS)
    uniform = F.conv(digits, 16, 10).cast("double") / float(16**_DRAW_DIGITS)
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("_x", uniform * F.lit(total))
    draws = draws.withColumn("_piece", piece(F.col("_x")))
    hit = spread.join(draws, "_piece").where((F.col("_x") >= F.col("_lo")) & (F.col("_x") < F.col("_hi")))
    return hit.select("draw", *keys)


def fov_grouped_order(drawn: DataFrame, fov: Sequence[str], keys: Sequence[str], seed: int = 42, epoch: int = 0) -> DataFrame:
    """Zero-based ``position`` in which the rows of one field are contiguous.

    The fields are shuffled by seed + epoch. A field of any size is ranked in slices.
    """
    fov = list(fov)
    counts = drawn.groupBy(*fov).agg(F.count(F.lit(1)).alias("_rows"))
    starts = seeded_running_sum(counts, [], fov, seed + epoch, F.col("_rows"), "_end", "_all")
    starts = settle(starts.select(*fov, (F.col("_end") - F.col("_rows")).alias("_start")))
    ranked = seeded_rank(drawn, fov, keys, seed + epoch, "_rank", "_n")
    placed = ranked.join(starts, fov)
    return placed.withColumn("position", F.col("_start") + F.col("_rank") - 1).drop("_rank", "_n", "_start")


def fov_sequential(
    df: DataFrame, fov: Sequence[str], keys: Sequence[str], seed: int = 42, epoch: int = 0, cap: int | None = None
) -> DataFrame:
    """One pass over all rows in field-grouped order, or over the first ``cap`` of them."""
    ordered = fov_grouped_order(df, fov, keys, seed, epoch)
    return ordered if cap is None else ordered.where(F.col("position") < int(cap))


def balanced_epoch(
    cells: DataFrame,
    inner_train: DataFrame,
    label: str,
    keys: Sequence[str],
    n: int | None = None,
    fov: Sequence[str] = ("dataset_name", "fov_name"),
    scheme: str = "sqrt",
    cap: int | None = None,
    floor: int = 1000,
    seed: int = 42,
    epoch: int = 0,
) -> DataFrame:
    """The rows of one training epoch: inner-train fields, weighted, drawn, grouped by field.

    ``n`` is the budget of the epoch, at most the size of the pool. The class cap belongs to the
    ``equal`` scheme. Scheme ``none`` draws uniformly within the budget, and without a budget
    passes over every row once.
    """
    pool = cells.join(inner_train.select(*fov).distinct(), list(fov), "left_semi")
    if scheme == "equal":
        pool = cap_per_class(pool, label, cap, keys, seed)
    if scheme == "none" and n is None:
        return fov_sequential(pool.select(*fov, *keys), fov, keys, seed, epoch)
    # the pool and the draws are read several times each: write their narrow rows once
    pool = settle(pool.select(*fov, *keys, label))
    size = pool.count()
    budget = size if n is None else min(size, int(n))
    weighted = with_weights(pool, label, scheme, floor)
    drawn = settle(weighted_draw(weighted, "weight", budget, [*keys, *fov], seed + epoch))
    return fov_grouped_order(drawn, fov, ["draw"], seed, epoch)


# --- channel dropout and masking: groups are the channels of one cell, bounded by the panel ---------------


def _channel_rank(df: DataFrame, cell: Sequence[str], channel: str, seed: int) -> tuple:
    order = Window.partitionBy(*cell).orderBy(seeded_key(seed, *cell, channel), channel)
    return F.row_number().over(order), F.count(F.lit(1)).over(Window.partitionBy(*cell))


def drop_channels(df: DataFrame, cell: Sequence[str], channel: str = "channel", most: int = 3, seed: int = 42) -> DataFrame:
    """Drop up to ``most`` channels of a cell and at most 30 % of them; panels of three keep all."""
    rank, valid = _channel_rank(df, cell, channel, seed)
    ranked = df.withColumn("_rank", rank).withColumn("_valid", valid)
    n_drop = F.when(F.col("_valid") > 3, F.least(F.lit(most), F.floor(F.col("_valid") * F.lit(0.3)))).otherwise(F.lit(0))
    return ranked.where(F.col("_rank") > n_drop).drop("_rank", "_valid")


def mask_markers(
    df: DataFrame, cell: Sequence[str], channel: str = "channel", ratio: float = 0.3, keep: int = 1, seed: int = 42
) -> DataFrame:
    """Mark the channels to hide from a model: ``masked`` is true for the chosen ones."""
    rank, valid = _channel_rank(df, cell, channel, seed)
    ranked = df.withColumn("_rank", rank).withColumn("_valid", valid)
    wanted = F.greatest(F.lit(1), F.floor(F.col("_valid") * F.lit(float(ratio))))
    n_mask = F.when(F.col("_valid") > keep, F.least(wanted, F.col("_valid") - keep)).otherwise(F.lit(0))
    return ranked.withColumn("masked", F.col("_rank") <= n_mask).drop("_rank", "_valid")


def mask_targets(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean of each channel over the cell pixels at which any channel has signal."""
    inside = pixels.join(mask.where(F.col("cell_id") != 0), ["fov_key", "row", "col"])
    lit = inside.where(F.col("value") != 0).select("fov_key", "cell_id", "row", "col").distinct()
    area = lit.groupBy("fov_key", "cell_id").agg(F.count(F.lit(1)).alias("_area"))
    sums = inside.groupBy("fov_key", "cell_id", "channel").agg(F.sum("value").alias("_sum"))
    joined = sums.join(area, ["fov_key", "cell_id"], "left")
    target = F.col("_sum") / F.greatest(F.coalesce("_area", F.lit(1)), F.lit(1))
    return joined.select("fov_key", "cell_id", "channel", target.alias("target"))
