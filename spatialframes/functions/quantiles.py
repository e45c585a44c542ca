"""Exact quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in the memory of one task.
Here each pass over the rows is a small map-side combined histogram, and the value range that can
hold a wanted order statistic shrinks from pass to pass: first a 64th of an octave, then 1/4096 of
that. Only the rows of the last range are counted by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.functions.joins import is_finite, null_safe_join
from spatialframes.session import settle, settle_and_tell

_OCTAVE_STEPS = 64
_LINEAR_STEPS = 4096
_SKIP_LINEAR_BELOW = 200_000


def _octave(value: Column) -> Column:
    """Bucket number that grows with the value, over the whole range of doubles."""
    size = F.floor(F.log2(F.abs(value)) * _OCTAVE_STEPS) + F.lit(1 << 17)
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(
        F.when(value > 0, size).otherwise(-size)
    )


def _linear(value: Column, low: Column, high: Column) -> Column:
    step = F.floor((value - low) / (high - low) * _LINEAR_STEPS)
    return F.when(high > low, F.least(step, F.lit(_LINEAR_STEPS - 1))).otherwise(F.lit(0)).cast("bigint")


def _ranks(total: Column, probabilities: Sequence[float]) -> Column:
    """Zero-based order statistics next to each probability."""
    ends = []
    for p in probabilities:
        position = (total - 1) * F.lit(float(p))
        ends += [F.floor(position), F.ceil(position)]
    return F.transform(F.array_distinct(F.array(*ends)), lambda r: F.struct(r.alias("rank"), r.alias("rest")))


def _hits(wanted: Column, before: Column, count: Column) -> Column:
    """Wanted ranks inside a bucket, counted from the start of the bucket."""
    inside = F.filter(wanted, lambda w: (w["rest"] >= before) & (w["rest"] < before + count))
    return F.transform(
        inside, lambda w: F.struct(w["rank"].alias("rank"), (w["rest"] - before).alias("rest"))
    )


def _narrow(histogram: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_count").over(window), F.lit(0))
    return (
        histogram.withColumn("_before", before)
        .withColumn("_wanted", _hits(F.col("_wanted"), F.col("_before"), F.col("_count")))
        .where(F.size("_wanted") > 0)
        .drop("_before")
    )


def octave_histogram(df: DataFrame, group: Sequence[str], value: str | Column) -> DataFrame:
    """``_octave, _count, _low, _high`` per group: one scan for counts, range and the start of any quantile.

    ``_octave`` is 0 for zeros only and NULL for values that are missing or not finite.
    """
    source = F.col(value) if isinstance(value, str) else value
    rows = df.select(*group, source.cast("double").alias("_v"))
    rows = rows.withColumn("_octave", F.when(is_finite(F.col("_v")), _octave(F.col("_v"))))
    return rows.groupBy(*group, "_octave").agg(
        F.count(F.lit(1)).alias("_count"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str | Column,
    probabilities: Mapping[str, float],
    histogram: DataFrame | None = None,
) -> DataFrame:
    """One row per group with the linearly interpolated quantiles named in ``probabilities``.

    NULL, NaN and infinite values are ignored; a group without a finite value has no row. The
    number of finite values is returned as ``n_values``. With the :func:`octave_histogram` of the rows
    at hand they are read once less.
    """
    group = list(group)
    names, wanted_p = list(probabilities), list(probabilities.values())
    source = F.col(value) if isinstance(value, str) else value
    rows = df.select(*group, source.cast("double").alias("_v")).where(is_finite(F.col("_v")))
    rows = rows.withColumn("_octave", _octave(F.col("_v")))

    first = octave_histogram(df, group, value) if histogram is None else histogram
    first = first.where(F.col("_octave").isNotNull()).withColumn("_n", F.sum("_count").over(Window.partitionBy(*group)))
    first = first.withColumn("_wanted", _ranks(F.col("_n"), wanted_p))
    first, told = settle_and_tell(_narrow(first, group, "_octave"), largest=F.col("_count"))

    keys = [*group, "_octave"]
    ranges = first.select(*keys, "_low", "_high")
    inside = null_safe_join(rows, ranges, keys, "inner")
    if (told["largest"] or 0) > _SKIP_LINEAR_BELOW:
        inside = inside.withColumn("_step", _linear(F.col("_v"), F.col("_low"), F.col("_high")))
        second = inside.groupBy(*keys, "_step").agg(F.count(F.lit(1)).alias("_count"))
        second = null_safe_join(second, first.select(*keys, "_n", "_wanted"), keys, "inner")
        second = settle(_narrow(second, keys, "_step"))
        keys = [*keys, "_step"]
        inside = null_safe_join(inside, second.select(*keys), keys, "inner")
        first = second

    counted = inside.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_count"))
    counted = null_safe_join(counted, first.select(*keys, "_n", "_wanted"), keys, "inner")
    found = _narrow(counted, keys, "_v").select(*group, "_n", "_v", F.explode("_wanted").alias("_w"))
    found = found.groupBy(*group).agg(
        F.max("_n").alias("n_values"),
        F.map_from_entries(F.collect_list(F.struct(F.col("_w.rank"), F.col("_v")))).alias("_at"),
    )
    columns = []
    for name, p in zip(names, wanted_p):
        position = (F.col("n_values") - 1) * F.lit(float(p))
        low, high = F.col("_at")[F.floor(position)], F.col("_at")[F.ceil(position)]
        columns.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*group, "n_values", *columns)
