"""Seeded orders, ranks and running sums that never put a large group into one task.

A seeded order sorts by ``md5(seed|key...)``. The digest is uniform over distinct keys, so its
leading hex digits cut a group of any size into equal slices: slice totals give what lies before
each slice, and only the rows of one slice are sorted together. Groups below a million rows are
sorted whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.functions.joins import null_safe_join
from spatialframes.session import settle

_SLICE_ABOVE = 1_000_000  # rows of a group
_SLICE_DIGITS = 3  # 16**3 = 4096 slices


def seeded_key(seed: int | str, *keys: str | Column) -> Column:
    columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def place(
    df: DataFrame, group: Sequence[str], keys: Sequence[str], seed: int | str, measures: Mapping[str, Column]
) -> DataFrame:
    """Rows with their ``_digest`` and ``_slice``, and per measure ``_before_<m>`` and ``_total_<m>``.

    ``_before`` is the sum over the earlier slices of the group, ``_total`` the one over the whole
    group. ``rows`` is always among the measures.
    """
    group = list(group)
    measures = {"rows": F.lit(1), **measures}
    rows = df.withColumn("_digest", seeded_key(seed, *keys))
    sums = [F.sum(m).alias(f"_total_{name}") for name, m in measures.items()]
    if group:
        totals = settle(rows.groupBy(*group).agg(*sums))
        largest = totals.agg(F.max("_total_rows")).first()[0] or 0
        rows = null_safe_join(rows, totals, group, "inner")
    else:
        whole = rows.agg(*sums).first()
        largest = whole["_total_rows"] or 0
        known = {name: whole[f"_total_{name}"] or 0 for name in measures}
        rows = rows.select("*", *[F.lit(v).alias(f"_total_{name}") for name, v in known.items()])

    nothing = [F.lit(0).alias(f"_before_{name}") for name in measures]
    if largest <= _SLICE_ABOVE:
        return rows.select("*", F.lit("").alias("_slice"), *nothing)

    cut = F.when(F.col("_total_rows") > _SLICE_ABOVE, F.substring("_digest", 1, _SLICE_DIGITS)).otherwise(F.lit(""))
    rows = rows.withColumn("_slice", cut)
    per_slice = rows.where(F.col("_slice") != "").groupBy(*group, "_slice")
    per_slice = per_slice.agg(*[F.sum(m).alias(f"_m_{name}") for name, m in measures.items()])
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_m_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in measures]
    offsets = settle(per_slice.select(*group, "_slice", *before))
    placed = null_safe_join(rows, offsets, [*group, "_slice"], "left")
    filled = [F.coalesce(f"_b_{name}", F.lit(0)).alias(f"_before_{name}") for name in measures]
    return placed.select("*", *filled).drop(*[f"_b_{name}" for name in measures])


def _inside(group: Sequence[str], keys: Sequence[str]):
    return Window.partitionBy(*group, "_slice").orderBy("_digest", *keys)


def seeded_rank(
    df: DataFrame,
    group: Sequence[str],
    keys: Sequence[str],
    seed: int | str,
    rank: str = "rank",
    total: str = "n",
    limit: int | None = None,
) -> DataFrame:
    """1-based rank of each row inside its group in seeded order, and the size of the group.

    ``keys`` must identify a row. With ``limit`` only the rows ranked up to it are returned, and
    slices beyond it are dropped before the sort.
    """
    rows = place(df, group, keys, seed, {})
    if limit is not None:
        rows = rows.where(F.col("_before_rows") < limit)
    number = F.row_number().over(_inside(group, keys))
    ranked = rows.withColumn("_number", number)
    if limit is not None:
        # a bare bound on the row number lets Spark prune before the shuffle
        ranked = ranked.where(F.col("_number") <= limit)
    ranked = ranked.withColumn(rank, F.col("_before_rows") + F.col("_number"))
    if limit is not None:
        ranked = ranked.where(F.col(rank) <= limit)
    ranked = ranked.withColumnRenamed("_total_rows", total)
    return ranked.drop("_digest", "_slice", "_number", "_before_rows")


def running_sum(placed: DataFrame, group: Sequence[str], keys: Sequence[str], measure: str, name: str, out: str) -> DataFrame:
    """Inclusive running sum of a column over rows that :func:`place` measured as ``name``."""
    up_to = _inside(group, keys).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(out, F.col(f"_before_{name}") + F.sum(measure).over(up_to))


def seeded_running_sum(
    df: DataFrame,
    group: Sequence[str],
    keys: Sequence[str],
    seed: int | str,
    measure: Column,
    out: str = "running",
    total: str = "total",
) -> DataFrame:
    """Inclusive running sum of ``measure`` in seeded order, per group, and the group total.

    Use an integer or decimal measure: their sums do not depend on the order of addition.
    """
    rows = df.withColumn("_measure", measure)
    placed = place(rows, group, keys, seed, {"m": F.col("_measure")})
    summed = running_sum(placed, group, keys, "_measure", "m", out).withColumnRenamed("_total_m", total)
    return summed.drop("_digest", "_slice", "_measure", "_before_m", "_before_rows", "_total_rows")
