"""Metadata contracts. Every check returns violations ``(check, key, detail)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.functions.names import is_control_channel
from spatialframes.operators.splits import raise_if_any, split_contract
from spatialframes.session import settle, task_count

__all__ = ["raise_if_any", "violations"]

# Fixed values.
INTEGER_TYPES = ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64"]
MAX_CHANNELS = 80


def violations(df: DataFrame, key: Column, checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """One row per failed check: ``checks`` maps a name to (failed, detail)."""
    found = [
        F.when(F.coalesce(failed, F.lit(False)), F.struct(F.lit(name).alias("check"), detail.cast("string").alias("detail")))
        for name, (failed, detail) in checks.items()
    ]
    rows = df.select(key.cast("string").alias("key"), F.explode(F.array_compact(F.array(*found))).alias("v"))
    return rows.select("v.check", "key", "v.detail")


def vocab_contract(vocab: DataFrame) -> DataFrame:
    """Per kind: indices unique and contiguous from 0, names unique, nothing empty."""
    stats = vocab.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("idx").alias("n_idx"),
        F.count_distinct("name").alias("n_names"),
        F.min("idx").alias("lo"),
        F.max("idx").alias("hi"),
    )
    n = F.col("n")
    return violations(
        stats,
        F.col("kind"),
        {
            "index_not_unique": (F.col("n_idx") != n, F.col("n_idx")),
            "index_not_contiguous": ((F.col("lo") != 0) | (F.col("hi") != n - 1), F.concat_ws("..", "lo", "hi")),
            "name_not_unique": (F.col("n_names") != n, F.col("n_names")),
        },
    )


def mapping_vs_declared(mapping: DataFrame, declared: DataFrame) -> DataFrame:
    """Names only in the mapping or only in the declared list."""
    m = mapping.select("name").distinct().withColumn("_m", F.lit(True))
    d = declared.select("name").distinct().withColumn("_d", F.lit(True))
    joined = m.join(d, "name", "full").where(F.col("_m").isNull() | F.col("_d").isNull())
    return joined.select("name", F.when(F.col("_m").isNull(), F.lit("missing_from_mapping")).otherwise(F.lit("extra_in_mapping")).alias("problem"))


def order_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Missing and extra names of an ordered list ``(name, idx)`` and its first differing index."""
    e = expected.select("name", F.col("idx").alias("expected_idx"))
    a = actual.select("name", F.col("idx").alias("actual_idx"))
    joined = e.join(a, "name", "full")
    sets = joined.where(F.col("expected_idx").isNull() | F.col("actual_idx").isNull()).select(
        F.when(F.col("actual_idx").isNull(), F.lit("missing")).otherwise(F.lit("extra")).alias("problem"),
        "name",
        F.coalesce("expected_idx", "actual_idx").alias("idx"),
    )
    at = expected.select(F.col("idx"), F.col("name").alias("e")).join(actual.select("idx", F.col("name").alias("a")), "idx")
    first = at.where(F.col("e") != F.col("a")).agg(F.min_by("e", "idx").alias("name"), F.min("idx").alias("idx"))
    first = first.where(F.col("idx").isNotNull()).select(F.lit("first_out_of_order").alias("problem"), "name", "idx")
    return sets.unionByName(first)


def shape_contract(meta: DataFrame) -> DataFrame:
    """Image and mask present, of rank 3 and 2, of equal extent, and an integer mask.

    ``meta(fov_key, raw_shape, mask_shape ARRAY<BIGINT>, mask_type)``.
    """
    raw, mask = F.col("raw_shape"), F.col("mask_shape")
    both = raw.isNotNull() & mask.isNotNull()
    ranked = both & (F.size(raw) == 3) & (F.size(mask) == 2)
    shown = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    return violations(
        meta,
        F.col("fov_key"),
        {
            "missing_raw": (raw.isNull(), F.lit("")),
            "missing_mask": (raw.isNotNull() & mask.isNull(), F.lit("")),
            "raw_rank": (both & (F.size(raw) != 3), shown(raw)),
            "mask_rank": (both & (F.size(mask) != 2), shown(mask)),
            "mask_type": (both & F.col("mask_type").isNotNull() & ~F.col("mask_type").isin(INTEGER_TYPES), F.col("mask_type")),
            "extent": (ranked & (F.slice(raw, 2, 2) != mask), F.concat_ws(" vs ", shown(raw), shown(mask))),
        },
    )


def channel_contract(meta: DataFrame, allow_two: bool = False) -> DataFrame:
    """More than two channels, and as many names as channels."""
    n = F.get("raw_shape", F.lit(0))
    names = F.coalesce(F.size("channel_names"), F.lit(0))
    return violations(
        meta,
        F.col("fov_key"),
        {
            "few_channels": ((n <= 2) & F.lit(not allow_two), n),
            "name_count": (n != names, F.concat_ws(" vs ", names.cast("string"), n.cast("string"))),
        },
    )


def attr_contract(meta: DataFrame) -> DataFrame:
    """Centroids, scale factor and, for an annotated field, the label source."""
    return violations(
        meta,
        F.col("fov_key"),
        {
            "missing_centroids": (F.col("centroids").isNull(), F.lit("")),
            "missing_scale_factor": (F.col("scale_factor").isNull(), F.lit("")),
            "missing_source": (F.col("has_annotations") & F.col("source").isNull(), F.lit("")),
        },
    )


def matrix_contract(meta: DataFrame) -> DataFrame:
    """A positivity matrix is two-dimensional and as large as its label lists."""
    m = F.col("matrix")
    shape = F.concat_ws("x", F.size(m).cast("string"), F.size(F.get(m, F.lit(0))).cast("string"))
    filled = m.isNotNull() & (F.size(m) > 0) & F.get(m, F.lit(0)).isNotNull()
    wanted = F.concat_ws("x", F.size("cell_types").cast("string"), F.size("markers").cast("string"))
    has = F.col("has_mp")
    return violations(
        meta,
        F.col("fov_key"),
        {
            "missing_markers": (has & F.col("markers").isNull(), F.lit("")),
            "missing_matrix": (has & m.isNull(), F.lit("")),
            "matrix_not_2d": (has & m.isNotNull() & ~filled, F.size(m)),
            "matrix_shape": (
                has & filled & F.col("markers").isNotNull() & F.col("cell_types").isNotNull() & (shape != wanted),
                F.concat_ws(" vs ", shape, wanted),
            ),
        },
    )


def required_markers(required: DataFrame, channels: DataFrame, fovs: DataFrame) -> DataFrame:
    """``required(fov_key, marker)``: the field must exist and carry the marker."""
    known = fovs.select("fov_key").distinct()
    absent = required.select("fov_key").distinct().join(known, "fov_key", "left_anti")
    missing = required.join(known, "fov_key", "left_semi").join(channels.select("fov_key", "marker"), ["fov_key", "marker"], "left_anti")
    a = absent.select(F.lit("sentinel_absent").alias("check"), F.col("fov_key").cast("string").alias("key"), F.lit("").alias("detail"))
    m = missing.select(F.lit("marker_missing").alias("check"), F.col("fov_key").cast("string").alias("key"), F.col("marker").alias("detail"))
    return a.unionByName(m)


def failure_gate(results: DataFrame, failed: Column, limit: float = 0.01) -> DataFrame:
    """Share of failed datasets and whether it is above the limit."""
    n, bad = F.count(F.lit(1)), F.count_if(failed)
    return results.agg(n.alias("n"), bad.alias("n_failed"), (bad > n * F.lit(float(limit))).alias("abort"))


def annotation_drop_rate(attempts: DataFrame, limit: float = 0.05) -> DataFrame:
    """Fields that lost more than ``limit`` of their annotations, by id and by centroid apart.

    ``attempts(fov_key, kind, cell_id)`` with a NULL cell for a lost one.
    """
    rates = attempts.groupBy("fov_key", "kind").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("cell_id").isNull()).alias("drops")
    )
    rates = rates.withColumn("rate", F.col("drops") / F.col("attempts"))
    return rates.where(F.col("rate") > limit)


def length_contract(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    a, b = F.size(left), F.size(right)
    return violations(df, F.col(key), {"length": (a != b, F.concat_ws(" vs ", a.cast("string"), b.cast("string")))})


def tissue_contract(fovs: DataFrame, vocab: DataFrame) -> DataFrame:
    """A field has a tissue and the vocabulary knows it."""
    known = vocab.select(F.col("name").alias("tissue")).distinct().withColumn("_known", F.lit(True))
    joined = fovs.select("fov_key", "tissue").join(known, "tissue", "left")
    empty = F.col("tissue").isNull() | (F.col("tissue") == "")
    return violations(
        joined, F.col("fov_key"), {"no_tissue": (empty, F.lit("")), "unknown_tissue": (~empty & F.col("_known").isNull(), F.col("tissue"))}
    )


def panel_cap(kept: DataFrame, fovs: DataFrame, cap: int = MAX_CHANNELS) -> DataFrame:
    """Fields with more usable channels than the model takes, or with none."""
    sizes = kept.groupBy("fov_key").agg(F.count(F.lit(1)).alias("n"))
    joined = fovs.select("fov_key").distinct().join(sizes, "fov_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return violations(joined, F.col("fov_key"), {"no_channel": (F.col("n") == 0, F.col("n")), "too_many": (F.col("n") > cap, F.col("n"))})


def validate(
    meta: DataFrame,
    vocab: DataFrame,
    declared: DataFrame | None = None,
    expected_markers: DataFrame | None = None,
    required: DataFrame | None = None,
    splits: DataFrame | None = None,
    allow_two: bool = False,
) -> DataFrame:
    """All violations of an archive in one frame; ``meta`` is what ``sources.archive.read_contract`` gives.

    ``declared`` lists the cell types, ``expected_markers(name, idx)`` the marker order a model was
    trained with, ``required(fov_key, marker)`` markers certain fields must carry.
    """
    found = [vocab_contract(vocab), shape_contract(meta), channel_contract(meta, allow_two), attr_contract(meta), matrix_contract(meta)]
    types, markers = (vocab.where(F.col("kind") == k).select("name", "idx") for k in ("cell_type", "marker"))
    row = lambda check, key, detail: (check.alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))
    if declared is not None:
        found.append(mapping_vs_declared(types, declared).select(*row(F.col("problem"), F.col("name"), F.lit(""))))
    if expected_markers is not None:
        check = F.concat(F.lit("marker_"), F.col("problem"))
        found.append(order_diff(expected_markers, markers).select(*row(check, F.col("name"), F.col("idx"))))
    if required is not None:
        panel = meta.select("fov_key", F.explode("channel_names").alias("marker"))
        found.append(required_markers(required, panel, meta))
    if splits is not None:
        found.append(split_contract(splits, meta).withColumn("detail", F.lit("")))
    return reduce(lambda a, b: a.unionByName(b), found)


# --- channels --------------------------------------------------------------------------------------------


def zero_channels(pixels: DataFrame) -> DataFrame:
    """Channels empty at acquisition: the largest value is exactly zero."""
    return pixels.groupBy("fov_key", "channel").agg(F.max("value").alias("top")).where(F.col("top") == 0).select("fov_key", "channel")


def clear_channels(rows: DataFrame, empty: DataFrame) -> DataFrame:
    return rows.join(settle(empty.select("fov_key", "channel")), ["fov_key", "channel"], "left_anti")


def channel_mask(channels: DataFrame) -> DataFrame:
    """Keep the first channel with signal for each marker; say why the others go.

    ``channels(fov_key, pos, channel, marker, all_zero)`` is the panel, so a window holds the
    channels of one field.
    """
    usable = F.when(F.col("marker").isNotNull() & ~F.col("all_zero"), F.col("pos"))
    first = F.min(usable).over(Window.partitionBy("fov_key", "marker"))
    reason = (
        F.when(F.col("marker").isNull(), F.lit("not_in_registry"))
        .when(F.col("pos") > first, F.lit("duplicate"))
        .when(F.col("all_zero"), F.lit("all_zero"))
    )
    return channels.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def unknown_channels(channels: DataFrame, markers: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent channel names that are neither registered nor controls."""
    named = channels.where(F.col("channel").isNotNull() & ~is_control_channel(F.col("channel")))
    counts = named.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(markers.select(F.col("name").alias("channel")), "channel", "left_anti")
    return counts.orderBy(F.desc("n"), "channel").limit(n)


def empty_cells(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Labelled cells without one pixel in the mask."""
    return cells.join(mask.where(F.col("cell_id") != 0).select("fov_key", "cell_id").distinct(), ["fov_key", "cell_id"], "left_anti")


def fov_report(channels: DataFrame, markers: DataFrame, fovs: DataFrame) -> DataFrame:
    """Counts of fields, two-channel fields and unknown names, with subtotals by modality and tissue.

    ``channels(fov_key, channel)`` and ``fovs(fov_key, modality, tissue)``; repeated rows count once. Both are
    dealt by field into tasks of so many rows, where a field's names are counted before they meet its modality.
    """
    known = markers.select(F.col("name").alias("channel"), F.lit(True).alias("_known"))
    channels, fovs = channels.select("fov_key", "channel"), fovs.select("fov_key", "modality", "tissue")
    n = task_count(channels, fovs)
    marked = channels.repartition(n, "fov_key").distinct().join(known, "channel", "left")
    unknown = F.col("_known").isNull() & ~is_control_channel(F.col("channel"))
    counts = marked.groupBy("fov_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(unknown).alias("unknown"))
    rows = fovs.repartition(n, "fov_key").distinct().join(counts, "fov_key")
    return rows.rollup("modality", "tissue").agg(
        F.count(F.lit(1)).alias("num_fovs"),
        F.count_if(F.col("n") <= 2).alias("num_two_channel"),
        F.sum("unknown").alias("num_unknown_channels"),
    )


def example_list(df: DataFrame, group: Sequence[str], column: str, limit: int = 5) -> DataFrame:
    """The first names of each group and how many more there are.

    Ranking stops at ``limit`` on the map side, so no group is gathered.
    """
    order = Window.partitionBy(*group).orderBy(column)
    first = df.select(*group, column).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
    first = first.groupBy(*group).agg(F.array_sort(F.collect_list(column)).alias("_first"))
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    names = F.concat_ws(", ", F.transform("_first", lambda v: v.cast("string")))
    more = F.when(F.col("_n") > limit, F.format_string(", ... (+%d more)", F.col("_n") - limit)).otherwise(F.lit(""))
    return first.join(sizes, list(group)).select(*group, F.concat(names, more).alias("examples"))
