"""Leakage-free train / validation / test splits by field of view.

Decisions are taken on one row per field; cells are read once to find the fields and once to
receive their split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialframes.functions.joins import null_safe_join
from spatialframes.functions.names import parse_patient_id
from spatialframes.functions.ordering import seeded_rank
from spatialframes.session import settle

FOV = ["dataset_name", "fov_name"]


def fov_frame(cells: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """One row per field with its stratum columns, which are constant inside a field."""
    if not strata:
        return cells.select(*FOV).distinct()
    return cells.groupBy(*FOV).agg(*[F.min(s).alias(s) for s in strata])


def sole_source(cells: DataFrame, label: str = "ct_label") -> DataFrame:
    """Fields that are the only carrier of some class; they have to go to train."""
    carriers = cells.select(label, *FOV).distinct().groupBy(label)
    single = carriers.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*FOV)).alias("f")).where(F.col("n") == 1)
    return single.select("f.*").distinct()


def train_size(n: Column, ratio: float) -> Column:
    """Nearest count, ties to even, with at least one unit on both sides; one unit goes to train."""
    nearest = F.bround(n * F.lit(float(ratio)), 0).cast("bigint")
    return F.when(n == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(n - 1, nearest)))


def stratified_split(
    cells: DataFrame,
    strata: Sequence[str],
    ratio: float = 0.8,
    seed: int = 42,
    label: str = "ct_label",
    by_patient: bool = False,
) -> DataFrame:
    """Split inside every stratum; returns ``(dataset_name, fov_name, strata..., split, forced, n_units)``.

    With ``by_patient`` the fields of one patient stay together inside a stratum.
    """
    strata = list(strata)
    fovs = settle(fov_frame(cells, strata))
    forced = settle(sole_source(cells, label))
    rest = null_safe_join(fovs, forced, FOV, "left_anti")
    single = F.concat(F.lit("fov:"), F.concat_ws("/", *FOV))
    if by_patient:
        patient = parse_patient_id(*[F.col(c) for c in FOV])
        rest = rest.withColumn("unit", F.coalesce(F.concat(F.lit("patient:"), patient), single))
        units = rest.select(*strata, "unit").distinct()
    else:
        rest = rest.withColumn("unit", single)
        units = rest.select(*strata, "unit")
    ranked = seeded_rank(units, strata, ["unit"], seed, "_rank", "n_units")
    split = F.when(F.col("_rank") <= train_size(F.col("n_units"), ratio), F.lit("train")).otherwise(F.lit("val"))
    ranked = ranked.select(*strata, "unit", "n_units", split.alias("split"))
    placed = null_safe_join(rest, ranked, [*strata, "unit"], "inner")
    placed = placed.withColumn("forced", F.lit(False)).drop("unit")
    first = null_safe_join(fovs, forced, FOV, "left_semi")
    first = first.select("*", F.lit(0).cast("bigint").alias("n_units"), F.lit("train").alias("split"), F.lit(True).alias("forced"))
    return placed.unionByName(first).select(*FOV, *strata, "split", "forced", "n_units")


def patient_leaks(split: DataFrame) -> DataFrame:
    """Patients on both sides: possible when one patient's fields lie in two strata."""
    named = split.withColumn("patient", parse_patient_id(*[F.col(c) for c in FOV])).where(F.col("patient").isNotNull())
    sides = named.groupBy("patient").agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n_fovs"))
    return sides.where(F.col("n_splits") > 1)


def global_split(cells: DataFrame, ratio: float = 0.8, seed: int = 42, label: str = "ct_label") -> DataFrame:
    """Unstratified split; the forced fields count towards the target, which never goes below them."""
    fovs = settle(fov_frame(cells))
    forced = settle(sole_source(cells, label))
    target = int(fovs.count() * ratio)
    wanted = max(0, target - forced.count())
    rest = fovs.join(forced, FOV, "left_anti")
    ranked = seeded_rank(rest, [], FOV, seed)
    split = F.when(F.col("rank") <= wanted, F.lit("train")).otherwise(F.lit("val"))
    return ranked.select(*FOV, split.alias("split")).unionByName(forced.select(*FOV, F.lit("train").alias("split")))


def split_metadata(split: DataFrame, strata: Sequence[str], seed: int, ratio: float, by_patient: bool = False) -> DataFrame:
    """The counts kept next to a written split, one row."""
    key = F.struct(*strata) if strata else F.lit(0)
    counts = split.agg(
        F.count_if(F.col("split") == "train").alias("num_train_fovs"),
        F.count_if(F.col("split") == "val").alias("num_val_fovs"),
        F.count_distinct("dataset_name").alias("num_datasets"),
        F.count_distinct(F.when((F.col("n_units") == 1) & ~F.col("forced"), key)).alias("num_single_unit_strata"),
    )
    return counts.select(
        "*",
        F.lit(int(seed)).alias("seed"),
        F.lit(float(ratio)).alias("train_ratio"),
        F.lit(",".join(strata)).alias("stratify_by"),
        F.lit(by_patient).alias("group_by_patient"),
    )


def val_test_split(val: DataFrame, test_ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """Move part of the validation fields to test.

    Per dataset when enough datasets have several fields; when 90 % or more have only one, over
    all fields at once.
    """
    per_dataset = val.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n"))
    single = per_dataset.agg(F.avg(F.when(F.col("n") < 2, 1.0).otherwise(0.0))).first()[0] or 0.0
    share = lambda n: F.bround(n * F.lit(float(test_ratio)), 0).cast("bigint")
    if single < 0.9:
        ranked = seeded_rank(val, ["dataset_name"], ["fov_name"], seed)
        n_test = F.when(F.col("n") >= 2, F.greatest(F.lit(1), share(F.col("n")))).otherwise(F.lit(0))
    else:
        ranked = seeded_rank(val, [], FOV, seed)
        n_test = share(F.col("n"))
    split = F.when(F.col("rank") <= n_test, F.lit("test")).otherwise(F.lit("val"))
    return ranked.select(*FOV, split.alias("split"))


def inner_val(train: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Carve validation fields out of train, always leaving one; ratio 0 carves nothing."""
    if not ratio or ratio <= 0:
        return train.select(*FOV, F.lit("train").alias("split"))
    ranked = seeded_rank(train.select(*FOV).distinct(), [], FOV, seed)
    wanted = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(float(ratio)), 0).cast("bigint"))
    split = F.when(F.col("rank") <= F.least(wanted, F.col("n") - 1), F.lit("inner_val")).otherwise(F.lit("train"))
    return ranked.select(*FOV, split.alias("split"))


def group_shuffle(fovs: DataFrame, test_size: float, seed: int = 42) -> DataFrame:
    """Whole fields to test, rounded up."""
    ranked = seeded_rank(fovs.select(*FOV).distinct(), [], FOV, seed)
    split = F.when(F.col("rank") <= F.ceil(F.col("n") * F.lit(float(test_size))), F.lit("test")).otherwise(F.lit("train"))
    return ranked.select(*FOV, split.alias("split"))


def row_split(rows: DataFrame, keys: Sequence[str], val_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Split rows regardless of field, with exact sizes; the odd row goes to train."""
    ranked = seeded_rank(rows, [], keys, seed, "_rank", "_n")
    n_train = F.col("_n") - F.floor(F.col("_n") * F.lit(float(val_share)))
    split = F.when(F.col("_rank") <= n_train, F.lit("train")).otherwise(F.lit("val"))
    return ranked.withColumn("split", split).drop("_rank", "_n")


# --- using a split ------------------------------------------------------------------------------------


def assign_split(cells: DataFrame, splits: DataFrame) -> DataFrame:
    """The split of each cell, NULL when its field is in none; train wins over val over heldout."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    single = splits.groupBy(*FOV).agg(F.min_by("split", order).alias("split"))
    return cells.join(single, FOV, "left")


def _violation(df: DataFrame, check: str) -> DataFrame:
    key = F.concat_ws("/", *FOV)
    return df.select(F.lit(check).alias("check"), key.alias("key"))


def split_overlap(splits: DataFrame) -> DataFrame:
    """Fields listed in train and val, or heldout together with either."""
    side = lambda *names: splits.where(F.col("split").isin(*names)).select(*FOV)
    both = _violation(side("train").intersect(side("val")), "train_val_overlap")
    held = _violation(side("heldout").intersect(side("train", "val")), "heldout_overlap")
    return both.unionByName(held)


def split_missing(splits: DataFrame, live: DataFrame) -> DataFrame:
    """Split fields that no longer exist and live fields that no split lists."""
    live = live.select(*FOV).distinct()
    kept = splits.where(F.col("split").isin("train", "val")).select(*FOV).distinct()
    held = splits.where(F.col("split") == "heldout").select(*FOV).distinct()
    every = splits.select(*FOV).distinct()
    return (
        _violation(kept.join(live, FOV, "left_anti"), "split_not_live")
        .unionByName(_violation(held.join(live, FOV, "left_anti"), "heldout_not_live"))
        .unionByName(_violation(live.join(every, FOV, "left_anti"), "live_not_in_split"))
    )


def split_contract(splits: DataFrame, live: DataFrame) -> DataFrame:
    """Manifest checks over an archive in which a dataset and its field carry the same name."""
    unsupported = splits.where(F.col("dataset_name") != F.col("fov_name")).select(*FOV).distinct()
    listed = splits.where(F.col("dataset_name") == F.col("fov_name")).select(*FOV).distinct()
    absent = listed.join(live.select(F.col("fov_key").alias("dataset_name")).distinct(), "dataset_name", "left_anti")
    return (
        split_overlap(splits)
        .unionByName(_violation(unsupported, "unsupported_pair"))
        .unionByName(_violation(absent.select(*FOV), "absent_from_archive"))
    )


def feature_split_contract(splits: DataFrame, archive: DataFrame, kept: DataFrame, features: DataFrame) -> DataFrame:
    """Why a field of the split has no features, and features of fields no split lists."""
    every = splits.select(*FOV).distinct()
    active = splits.where(F.col("split").isin("train", "val")).select(*FOV).distinct()
    held = splits.where(F.col("split") == "heldout").select(*FOV).distinct()
    archive, kept, features = (d.select(*FOV).distinct() for d in (archive, kept, features))
    in_archive = active.join(archive, FOV, "left_semi")
    in_kept = in_archive.join(kept, FOV, "left_semi")
    return (
        _violation(active.join(archive, FOV, "left_anti"), "not_in_archive")
        .unionByName(_violation(held.join(archive, FOV, "left_anti"), "heldout_not_in_archive"))
        .unionByName(_violation(in_archive.join(kept, FOV, "left_anti"), "excluded_by_keep"))
        .unionByName(_violation(in_kept.join(features, FOV, "left_anti"), "no_features"))
        .unionByName(_violation(features.join(every, FOV, "left_anti"), "absent_from_split"))
    )


# Provenance that may differ between two runs without invalidating a split.
ADVISORY_KEYS = ["zarr_path", "archive_fingerprint"]


def meta_diff(saved: DataFrame, current: DataFrame) -> DataFrame:
    """Differences of two ``(key, value)`` provenance tables; advisory ones are only marked.

    A current value of NULL asks nothing of the saved one.
    """
    joined = saved.select("key", F.col("value").alias("saved")).join(
        current.select("key", F.col("value").alias("current")), "key", "full"
    )
    differ = joined.where(F.col("current").isNotNull() & ~F.col("saved").eqNullSafe(F.col("current")))
    problem = F.when(F.col("saved").isNull(), F.lit("missing")).otherwise(F.lit("mismatch"))
    return differ.select("key", "saved", "current", problem.alias("problem"), F.col("key").isin(ADVISORY_KEYS).alias("advisory"))


def raise_if_any(violations: DataFrame, limit: int = 5) -> None:
    """Strict mode of a violations frame: fail with the first examples."""
    found = violations.limit(limit + 1).collect()
    if found:
        shown = "; ".join(", ".join(str(v) for v in row) for row in found[:limit])
        raise ValueError("violations: " + shown + (", and more" if len(found) > limit else ""))


def load_split(cells: DataFrame, splits: DataFrame, strict: bool = True) -> DataFrame:
    """Cells with their split after the strict checks of overlap, liveness and coverage."""
    if strict:
        raise_if_any(split_overlap(splits).unionByName(split_missing(splits, cells)))
    return assign_split(cells, splits)
