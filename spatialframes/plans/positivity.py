"""Queries on marker positivity."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.operators import positivity as ops
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6
from spatialframes.plans.registry import query, view

view(
    "judged",
    """SELECT p.cell_index, dataset_name, cell_type, marker, p.score, CAST(t.value AS INTEGER) AS target FROM v_positivity p
       JOIN v_truth t USING (dataset_name, cell_type, marker) WHERE t.value IN ('0', '1')""",
)


def scores(spark, sf):
    return b.positivity(spark, sf)


@query("positivity_join", "SELECT cell_index, dataset_name, cell_type, marker, round(score, 6) AS score, target FROM v_judged")
def positivity_join(spark, sf):
    out = ops.positivity_join(scores(spark, sf).drop("target"), b.truth(spark, sf))
    return out.select("cell_index", "dataset_name", "cell_type", "marker", r6("score").alias("score"), "target")


@query(
    "positivity_lookup",
    """SELECT w.cell_index, w.dataset_name, w.cell_type, w.marker, coalesce(CASE WHEN value IN ('1', '2') THEN 1 ELSE 0 END, 0) AS positive,
       coalesce(value NOT IN ('?', '0.5'), false) AS valid
       FROM (SELECT cell_index, dataset_name, CASE WHEN target = 1 THEN upper(cell_type) ELSE cell_type END AS cell_type,
       CASE WHEN score > 0.5 THEN upper(marker[1]) || marker[2:] WHEN score < 0.02 THEN 'other' ELSE marker END AS marker FROM v_positivity) w
       LEFT JOIN v_truth t ON t.dataset_name = w.dataset_name AND t.cell_type = lower(w.cell_type) AND t.marker = lower(w.marker)""",
)
def positivity_lookup(spark, sf):
    s = scores(spark, sf)
    marker = F.when(F.col("score") > 0.5, F.initcap("marker")).when(F.col("score") < 0.02, F.lit("other")).otherwise(F.col("marker"))
    cell_type = F.when(F.col("target") == 1, F.upper("cell_type")).otherwise(F.col("cell_type"))
    wanted = s.select("cell_index", "dataset_name", cell_type.alias("cell_type"), marker.alias("marker"))
    return ops.positivity_lookup(wanted, b.truth(spark, sf))


# markers per dataset, so that there are many of them
view("wide", "SELECT cell_index, dataset_name || '_' || marker AS marker, score, target FROM v_positivity")
view(
    "counts",
    """SELECT marker, count(*) FILTER (score >= 0.5 AND target = 1) AS tp, count(*) FILTER (score >= 0.5 AND target = 0) AS fp,
       count(*) FILTER (score < 0.5 AND target = 1) AS fn, count(*) FILTER (score < 0.5 AND target = 0) AS tn FROM v_wide GROUP BY marker""",
)


def wide(spark, sf):
    return scores(spark, sf).withColumn("marker", F.concat_ws("_", "dataset_name", "marker"))


METRICS = """, x AS (SELECT *, tp + fp + fn + tn AS n_samples, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p,
       CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM {counts}),
       y AS (SELECT *, (tp + tn) / n_samples AS a, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f FROM x) """


def metric_columns(out, *extra):
    return out.select(*extra, "marker", "tp", "fp", "fn", "tn", "n_samples", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


METRIC_COLUMNS = "marker, tp, fp, fn, tn, n_samples, round(a, 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1"


@query("marker_metrics", METRICS.format(counts="v_counts") + f"SELECT {METRIC_COLUMNS} FROM y", views=("counts", "wide", "positivity"))
def marker_metrics(spark, sf):
    return metric_columns(ops.marker_metrics(ops.marker_counts(wide(spark, sf))))


@query(
    "top_markers",
    METRICS.format(counts="v_counts") + f"SELECT {METRIC_COLUMNS} FROM y ORDER BY y.f DESC, n_samples DESC, marker LIMIT 10",
    views=("counts", "wide", "positivity"),
)
def top_markers(spark, sf):
    return metric_columns(ops.top_markers(ops.marker_metrics(ops.marker_counts(wide(spark, sf)))))


SUMMARY = """SELECT round(coalesce(avg(f) FILTER (NOT v), 0), 6) AS mp_macro_f1, round(coalesce(avg(p) FILTER (NOT v), 0), 6) AS mp_macro_precision,
       round(coalesce(avg(r) FILTER (NOT v), 0), 6) AS mp_macro_recall, round(coalesce(avg(a) FILTER (NOT v), 0), 6) AS mp_macro_accuracy,
       round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS mp_micro_f1, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS mp_micro_precision,
       round(sum(tp) / (sum(tp) + sum(fn)), 6) AS mp_micro_recall, count(*) AS mp_num_markers, count(*) FILTER (v) AS mp_num_markers_excluded
       {more} FROM (SELECT *, tp + fn = 0 AND tp + fp = 0 AS v FROM y)"""
SUMMARY_COLUMNS = [f"mp_{kind}_{m}" for kind, ms in (("macro", ("f1", "precision", "recall", "accuracy")), ("micro", ("f1", "precision", "recall"))) for m in ms]


@query("marker_summary", METRICS.format(counts="v_counts") + SUMMARY.format(more=""), views=("counts", "wide", "positivity"))
def marker_summary(spark, sf):
    out = ops.marker_summary(ops.marker_counts(wide(spark, sf)))
    return out.select(*[r6(c).alias(c) for c in SUMMARY_COLUMNS], "mp_num_markers", "mp_num_markers_excluded")


JUDGED_COUNTS = """, jc AS (SELECT marker, count(*) FILTER (score >= 0.5 AND target = 1) AS tp, count(*) FILTER (score >= 0.5 AND target = 0) AS fp,
       count(*) FILTER (score < 0.5 AND target = 1) AS fn, count(*) FILTER (score < 0.5 AND target = 0) AS tn FROM v_judged GROUP BY marker)"""


@query(
    "positivity_eval",
    JUDGED_COUNTS
    + METRICS.format(counts="jc")
    + SUMMARY.format(
        more=""", round((sum(tp) + sum(tn)) / sum(n_samples), 6) AS accuracy, round(sum(tp) / (sum(tp) + sum(fp)), 6) AS precision,
       round(sum(tp) / (sum(tp) + sum(fn)), 6) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1, CAST(sum(n_samples) AS BIGINT) AS n_samples"""
    ),
    views=("judged", "positivity", "truth"),
)
def positivity_eval(spark, sf):
    out = ops.positivity_eval(scores(spark, sf).drop("target"), b.truth(spark, sf))
    return out.select(
        *[r6(c).alias(c) for c in [*SUMMARY_COLUMNS, "accuracy", "precision", "recall", "f1"]],
        "mp_num_markers", "mp_num_markers_excluded", "n_samples",
    )


@query(
    "marker_auroc",
    """, r AS (SELECT marker, target, rank() OVER w + (count(*) OVER (PARTITION BY marker, score) - 1) / 2.0 AS rk FROM v_wide
       WINDOW w AS (PARTITION BY marker ORDER BY score)),
       s AS (SELECT marker, sum(rk) FILTER (target = 1) AS sr, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM r GROUP BY marker)
       SELECT marker, round((sr - p * (p + 1) / 2.0) / (p * n), 6) AS auroc FROM s WHERE p > 0 AND n > 0""",
)
def marker_auroc(spark, sf):
    return ops.marker_auroc(wide(spark, sf)).withColumn("auroc", r6("auroc"))


view(
    "sweep",
    """SELECT marker, j, j * (0.98::DOUBLE / 49) + 0.01::DOUBLE AS t, count(*) FILTER (score >= j * (0.98::DOUBLE / 49) + 0.01::DOUBLE AND target = 1) AS tp,
       count(*) FILTER (score >= j * (0.98::DOUBLE / 49) + 0.01::DOUBLE AND target = 0) AS fp, count(*) FILTER (target = 1) AS np
       FROM v_wide CROSS JOIN (SELECT unnest(range(0, 50)) AS j) GROUP BY ALL""",
)
view(
    "learned",
    """SELECT marker, max(f1) AS best_f1, CASE WHEN max(f1) > 0 THEN arg_max(t, (f1, -j)) ELSE 0.5 END AS threshold FROM
       (SELECT marker, j, t, CASE WHEN tp + fp + np > 0 THEN 2.0 * tp / (tp + fp + np) ELSE 0.0 END AS f1 FROM v_sweep) GROUP BY marker""",
)


@query("best_threshold", "SELECT marker, round(best_f1, 6) AS best_f1, round(threshold, 6) AS threshold FROM v_learned")
def best_threshold(spark, sf):
    out = ops.best_threshold(wide(spark, sf))
    return out.select("marker", r6("best_f1").alias("best_f1"), r6("threshold").alias("threshold"))


@query("uncalibrated", "SELECT marker, count(*) AS n FROM v_wide GROUP BY marker HAVING count(*) FILTER (target = 1) = 0")
def uncalibrated(spark, sf):
    return ops.uncalibrated(wide(spark, sf))


@query(
    "learned_vs_fixed",
    """, lc AS (SELECT marker, count(*) FILTER (score >= threshold AND target = 1) AS tp, count(*) FILTER (score >= threshold AND target = 0) AS fp,
       count(*) FILTER (score < threshold AND target = 1) AS fn, count(*) FILTER (score < threshold AND target = 0) AS tn
       FROM v_wide JOIN v_learned USING (marker) GROUP BY marker),
       both_arms AS (SELECT 'learned' AS arm, * FROM lc UNION ALL SELECT 'fixed', * FROM v_counts)"""
    + METRICS.format(counts="both_arms")
    + f"SELECT arm, {METRIC_COLUMNS} FROM y",
    views=("learned", "counts", "wide", "sweep", "positivity"),
)
def learned_vs_fixed(spark, sf):
    df = wide(spark, sf)
    return metric_columns(ops.learned_vs_fixed(df, ops.best_threshold(df)), "arm")
