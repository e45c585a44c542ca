"""Marker positivity: truth lookup, per-marker counts, AUROC and threshold search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.functions.joins import null_safe_join
from spatialframes.functions.vectors import threshold_grid
from spatialframes.session import settle

TRUTH_KEY = ["dataset_name", "cell_type", "marker"]
_OCTAVE_SLICES = 1 << 10  # slices of an octave of scores


# --- truth -------------------------------------------------------------------------------------------


def strict_truth(truth: DataFrame) -> DataFrame:
    """Only exact 0 and 1 entries, as ``target``."""
    number = F.col("value").try_cast("double")
    return truth.withColumn("target", number).where(number.isin(0.0, 1.0)).withColumn("target", F.col("target").cast("int")).drop("value")


def lenient_entry(value: Column) -> tuple[Column, Column]:
    """(positive, valid): "?", 0.5 and text are invalid, else >= 0.5 is positive and NaN is a valid 0."""
    number = value.try_cast("double")
    valid = F.coalesce((value != "?") & number.isNotNull() & (F.isnan(number) | (number != 0.5)), F.lit(False))
    positive = F.when(valid & ~F.isnan(number) & (number >= 0.5), F.lit(1)).otherwise(F.lit(0))
    return positive, valid


def positivity_join(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores with their strict truth; combinations without one are left out."""
    return predictions.join(strict_truth(truth), TRUTH_KEY)


def append_fields(frames: Sequence[DataFrame]) -> DataFrame:
    """One frame of the scores of several fields; none at all is an error."""
    if not frames:
        raise ValueError("no field gave any prediction")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def melt_scores(wide: DataFrame, meta: Sequence[str] = ("cell_index", "cell_type", "dataset_name", "fov_name")) -> DataFrame:
    """Long ``(..., marker, score)`` from one column per marker."""
    keys = [c for c in wide.columns if c in meta]
    return wide.unpivot(keys, [c for c in wide.columns if c not in meta], "marker", "score")


def positivity_lookup(wanted: DataFrame, truth: DataFrame) -> DataFrame:
    """``positive`` and ``valid`` for each (dataset, cell type, marker), lenient reading.

    Row and column are each matched exactly and then ignoring case; the last spelling wins, in the
    order of ``cell_type_pos`` and ``marker_pos`` where the truth has them, else of the names. A
    combination without an entry is invalid.
    """

    def spelled(df: DataFrame, column: str) -> DataFrame:
        place = f"{column}_pos" if f"{column}_pos" in truth.columns else column
        names = truth.groupBy("dataset_name", column).agg(F.max(place).alias("_place"))
        exact = names.select("dataset_name", F.col(column), F.col(column).alias("_exact"))
        lower = names.groupBy("dataset_name", F.lower(column).alias("_key")).agg(F.max_by(column, "_place").alias("_lower"))
        found = df.join(exact, ["dataset_name", column], "left").withColumn("_key", F.lower(column))
        found = found.join(lower, ["dataset_name", "_key"], "left")
        return found.withColumn(f"_{column}", F.coalesce("_exact", "_lower")).drop("_exact", "_lower", "_key")

    # many cells ask for the same combination: look each one up once
    asked = wanted.select(*TRUTH_KEY).distinct()
    keyed = spelled(spelled(asked, "cell_type"), "marker")
    entries = truth.select("dataset_name", F.col("cell_type").alias("_cell_type"), F.col("marker").alias("_marker"), "value")
    joined = keyed.join(entries, ["dataset_name", "_cell_type", "_marker"], "left")
    positive, valid = lenient_entry(F.col("value"))
    answers = settle(joined.select(*TRUTH_KEY, positive.alias("positive"), valid.alias("valid")))
    return null_safe_join(wanted, answers, TRUTH_KEY, "left")


# --- counts and metrics --------------------------------------------------------------------------------


def decide(score: Column, threshold: Column) -> Column:
    """A score equal to the threshold is positive; a NaN score never is."""
    return ~F.isnan(score) & (score >= threshold)


def marker_counts(scores: DataFrame, thresholds: DataFrame | None = None, fixed: float | None = 0.5) -> DataFrame:
    """tp, fp, fn, tn per marker at the marker's threshold, or at ``fixed`` without one."""
    limit = F.lit(float(0.5 if fixed is None else fixed))
    if thresholds is not None:
        known = thresholds.select("marker", F.col("threshold").alias("_t"))
        scores = scores.join(known, "marker", "left")
        limit = F.coalesce("_t", limit)
    positive, truth = decide(F.col("score"), limit), F.col("target") == 1
    return scores.groupBy("marker").agg(
        F.count_if(positive & truth).alias("tp"),
        F.count_if(positive & ~truth).alias("fp"),
        F.count_if(~positive & truth).alias("fn"),
        F.count_if(~positive & ~truth).alias("tn"),
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def marker_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = counts.withColumn("n_samples", tp + fp + fn + tn)
    out = out.withColumn("accuracy", _ratio(tp + tn, F.col("n_samples")))
    out = out.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _ratio(2.0 * p * r, p + r))


def _reduce(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    m = marker_metrics(counts)
    vacuous = (F.col("tp") + F.col("fn") == 0) & (F.col("tp") + F.col("fp") == 0)
    macro = lambda c: F.coalesce(F.avg(F.when(~vacuous, F.col(c))), F.lit(0.0)).alias(f"mp_macro_{c}")
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    zero = F.lit(0.0)
    return m.groupBy(*by).agg(
        macro("f1"),
        macro("precision"),
        macro("recall"),
        macro("accuracy"),
        F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), zero).alias("mp_micro_f1"),
        F.coalesce(_ratio(tp, tp + fp), zero).alias("mp_micro_precision"),
        F.coalesce(_ratio(tp, tp + fn), zero).alias("mp_micro_recall"),
        F.count(F.lit(1)).alias("mp_num_markers"),
        F.count_if(vacuous).alias("mp_num_markers_excluded"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
    )


def marker_summary(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and micro reductions; a marker never positive in truth or prediction leaves all macros."""
    return _reduce(counts, by).drop("tp", "fp", "fn", "tn")


def _octave_slice(score: Column) -> Column:
    """A number that never falls as the score rises."""
    size = F.abs(score)
    octave = F.floor(F.log2(size))
    inside = F.floor((size / F.pow(F.lit(2.0), octave) - 1) * _OCTAVE_SLICES)
    # octaves of doubles begin at -1074
    place = F.when(size == float("inf"), 4096 * _OCTAVE_SLICES).otherwise((octave + 1100) * _OCTAVE_SLICES + inside)
    return F.when(size == 0, F.lit(0)).otherwise(place * F.signum(score)).cast("long")


def marker_auroc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve per marker with both classes, from counts of distinct scores.

    Every octave of scores is cut into equal slices, whatever the range of the scores: slice totals
    give the negatives below a slice, and only the distinct scores of one slice are ordered together.
    A NaN score is never positive, so it ranks below all others; a row without a score is left out.
    """
    scores = scores.withColumn("score", F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score")))
    slices = _octave_slice(F.col("score"))
    by_score = scores.groupBy("marker", slices.alias("_slice"), "score").agg(
        F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") != 1).alias("neg")
    )
    per_slice = by_score.groupBy("marker", "_slice").agg(F.sum("neg").alias("neg"))
    below = Window.partitionBy("marker").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(
        per_slice.select("marker", "_slice", F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("_below"))
    )
    inside = Window.partitionBy("marker", "_slice").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_score.join(offsets, ["marker", "_slice"])
    under = F.col("_below") + F.coalesce(F.sum("neg").over(inside), F.lit(0))
    placed = placed.withColumn("_wins", F.col("pos").cast("double") * (under + F.col("neg") / 2.0))
    sums = placed.groupBy("marker").agg(F.sum("_wins").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    sums = sums.where((F.col("p") > 0) & (F.col("n") > 0))
    return sums.select("marker", (F.col("w") / (F.col("p").cast("double") * F.col("n"))).alias("auroc"))


# --- thresholds ------------------------------------------------------------------------------------------


def passed_thresholds(score: Column, grid: list[float]) -> Column:
    """How many grid points the score reaches: an arithmetic guess corrected against the grid."""
    last = len(grid) - 1
    step = (grid[-1] - grid[0]) / last
    points = F.array(*[F.lit(t) for t in grid])
    guess = F.floor((score - grid[0]) / step).cast("int")
    guess = F.greatest(F.least(guess, F.lit(last)), F.lit(-1))
    up = F.coalesce(score >= F.get(points, guess + 1), F.lit(False))
    down = (guess >= 0) & (score < F.get(points, F.greatest(guess, F.lit(0))))
    reached = F.when(up, guess + 1).when(down, guess - 1).otherwise(guess) + 1
    return F.when(score.isNull() | F.isnan(score), F.lit(0)).otherwise(reached)


def score_histogram(scores: DataFrame, n_thresholds: int = 50) -> DataFrame:
    """Positive and negative counts per (marker, thresholds reached): at most n + 1 rows a marker."""
    reached = passed_thresholds(F.col("score"), threshold_grid(n_thresholds))
    return scores.groupBy("marker", reached.alias("reached")).agg(
        F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") != 1).alias("neg")
    )


def best_threshold(scores: DataFrame, n_thresholds: int = 50) -> DataFrame:
    """Per marker the lowest grid threshold of the best F1, 0.5 when every F1 is zero."""
    return thresholds_of_histogram(score_histogram(scores, n_thresholds), n_thresholds)


def thresholds_of_histogram(histogram: DataFrame, n_thresholds: int = 50) -> DataFrame:
    grid = threshold_grid(n_thresholds)
    bins = histogram.groupBy("marker").agg(
        F.collect_list(F.struct("reached", "pos", "neg")).alias("_bins"), F.sum("pos").alias("n_pos")
    )
    steps = bins.select("marker", "n_pos", "_bins", F.explode(F.sequence(F.lit(0), F.lit(n_thresholds - 1))).alias("j"))
    over = F.filter("_bins", lambda b: b["reached"] > F.col("j"))
    tp = F.aggregate(over, F.lit(0).cast("bigint"), lambda a, b: a + b["pos"])
    fp = F.aggregate(over, F.lit(0).cast("bigint"), lambda a, b: a + b["neg"])
    bottom = tp + fp + F.col("n_pos")  # 2 tp + fp + fn
    steps = steps.withColumn("f1", F.when(bottom > 0, 2.0 * tp / bottom).otherwise(F.lit(0.0)))
    best = steps.groupBy("marker").agg(F.max("f1").alias("best_f1"), F.max_by("j", F.struct(F.col("f1"), -F.col("j"))).alias("j"))
    points = F.array(*[F.lit(t) for t in grid])
    return best.select(
        "marker", "best_f1", F.when(F.col("best_f1") > 0, F.get(points, F.col("j"))).otherwise(F.lit(0.5)).alias("threshold")
    )


def uncalibrated(scores: DataFrame) -> DataFrame:
    """Markers without one positive label; their threshold stays at 0.5."""
    totals = scores.groupBy("marker").agg(F.count_if(F.col("target") == 1).alias("n_pos"), F.count(F.lit(1)).alias("n"))
    return totals.where(F.col("n_pos") == 0).select("marker", "n")


def learned_vs_fixed(scores: DataFrame, thresholds: DataFrame, fixed: float = 0.5) -> DataFrame:
    """Per-marker metrics at the learned thresholds and at the fixed one, from one pass."""
    known = settle(thresholds.select("marker", F.col("threshold").alias("_t")))
    joined = scores.join(known, "marker", "left")
    truth = F.col("target") == 1
    arms = {"learned": F.coalesce("_t", F.lit(0.5)), "fixed": F.lit(float(fixed))}
    columns = []
    for arm, limit in arms.items():
        positive = decide(F.col("score"), limit)
        cells = {"tp": positive & truth, "fp": positive & ~truth, "fn": ~positive & truth, "tn": ~positive & ~truth}
        columns.append(F.struct(F.lit(arm).alias("arm"), *[F.count_if(c).alias(n) for n, c in cells.items()]))
    counts = joined.groupBy("marker").agg(F.array(*columns).alias("_arms"))
    return marker_metrics(counts.select("marker", F.explode("_arms").alias("a")).select("marker", "a.*"))


def truth_counts(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn per marker against the strict truth.

    Truth is one value per (dataset, type, marker), so cells are counted by that key and the truth
    meets one row per key.
    """
    positive = decide(F.col("score"), F.lit(float(threshold)))
    tallies = predictions.groupBy(*TRUTH_KEY).agg(F.count_if(positive).alias("hits"), F.count(F.lit(1)).alias("n"))
    judged = tallies.join(strict_truth(truth), TRUTH_KEY)
    missed = F.col("n") - F.col("hits")
    part = lambda value, target: F.sum(F.when(F.col("target") == target, value).otherwise(F.lit(0)))
    return judged.groupBy("marker").agg(
        part(F.col("hits"), 1).alias("tp"),
        part(F.col("hits"), 0).alias("fp"),
        part(missed, 1).alias("fn"),
        part(missed, 0).alias("tn"),
    )


def positivity_eval(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pooled metrics and the macro / micro summary over all (cell, marker) pairs with truth."""
    pooled = marker_metrics(_reduce(truth_counts(predictions, truth, threshold))).where(F.col("n_samples") > 0)
    return pooled.drop("tp", "fp", "fn", "tn")


def top_markers(metrics: DataFrame, n: int = 10) -> DataFrame:
    return metrics.orderBy(F.desc("f1"), F.desc("n_samples"), "marker").limit(n)
