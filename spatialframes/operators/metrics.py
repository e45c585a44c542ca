"""Classification metrics from (actual, pred) pairs.

Pairs are counted before anything is joined, so every later step works on at most
classes x classes rows per group.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OTHER = "Other"

# Types credited with their subtypes.
CELL_TYPE_HIERARCHY = {
    "Tcell": ["CD4T", "CD8T", "Treg", "NKT"],
    "Stromal": ["Fibroblast", "Pericyte"],
}


def hierarchy_frame(spark: SparkSession, hierarchy: Mapping[str, Sequence[str]] = CELL_TYPE_HIERARCHY) -> DataFrame:
    pairs = [(parent, child) for parent, children in hierarchy.items() for child in children]
    return spark.createDataFrame(pairs, "parent string, child string")


def confusion(pairs: DataFrame, classes: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Counts ``(by..., actual, pred, n)`` over the listed classes; other labels are dropped."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = pairs.groupBy(*by, "actual", "pred").agg(n.cast("bigint").alias("n"))
    counts = counts.join(classes.select(F.col("name").alias("actual")), "actual", "left_semi")
    counts = counts.join(classes.select(F.col("name").alias("pred")), "pred", "left_semi")
    return counts.select(*by, "actual", "pred", "n")


def hierarchy_credit(counts: DataFrame, hierarchy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A child predicted for its true parent counts as the parent; never the other way round."""
    edges = hierarchy.select(F.col("parent").alias("actual"), F.col("child").alias("pred"), F.lit(True).alias("_credit"))
    moved = counts.join(edges.distinct(), ["actual", "pred"], "left")
    moved = moved.withColumn("pred", F.when(F.col("_credit"), F.col("actual")).otherwise(F.col("pred")))
    return moved.groupBy(*by, "actual", "pred").agg(F.sum("n").alias("n"))


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, predictions, hits, precision, recall and F1 of every class that occurs."""
    hit = F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("actual").alias("name"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("pred").alias("name"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    rows = counts.select(*by, F.explode(sides).alias("s")).select(*by, "s.*")
    sums = rows.groupBy(*by, "name").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(F.lit(0.0))
    sums = sums.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2.0 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    return sums.withColumn("f1", f1)


def class_summary(counts: DataFrame, by: Sequence[str] = (), min_support: int = 1) -> DataFrame:
    """Macro and weighted accuracy and F1; without any supported class all are 0."""
    classes = per_class(counts, by)
    counted = F.col("support") >= min_support
    zero = F.lit(0.0)
    accuracy = F.col("hits") / (F.col("support") + 1e-8)
    return classes.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(counted, accuracy)), zero).alias("macro_accuracy"),
        F.coalesce(F.sum("hits") / (F.sum("support") + 1e-8), zero).alias("weighted_accuracy"),
        F.coalesce(F.avg(F.when(counted, F.col("f1"))), zero).alias("macro_f1"),
        F.coalesce(F.sum(F.col("support") * F.col("f1")) / F.greatest(F.sum("support"), F.lit(1)), zero).alias("weighted_f1"),
    )


def hierarchical_macro_f1(pairs: DataFrame, classes: DataFrame, hierarchy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = hierarchy_credit(confusion(pairs, classes, by), hierarchy, by)
    return class_summary(counts, by).select(*by, "macro_f1")


def confusion_norm(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("actual"))  # one true class has at most one row per class
    return counts.select("actual", "pred", (F.col("n") / (total + 1e-8)).alias("share"))


def abstain_report(df: DataFrame, classes: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Coverage and hierarchical macro-F1 of all rows and of the rows kept, in one pass.

    ``df(actual, pred, abstained)`` carries the label before abstention in ``pred``.
    """
    arms = F.array(F.struct(F.lit("all").alias("arm"), F.col("n").alias("n")), F.struct(F.lit("kept").alias("arm"), F.col("kept").alias("n")))
    rows = df.groupBy("actual", "pred").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("abstained")).alias("kept")
    )
    rows = rows.select("actual", "pred", F.explode(arms).alias("a")).select("actual", "pred", "a.arm", "a.n")
    total = rows.groupBy("arm").agg(F.sum("n").alias("rows"))
    counts = confusion(rows.where("n > 0"), classes, ["arm"], F.col("n"))
    summary = class_summary(hierarchy_credit(counts, hierarchy, ["arm"]), ["arm"]).select("arm", "macro_f1")
    whole = F.max(F.when(F.col("arm") == "all", F.col("rows"))).over(Window.partitionBy())
    total = total.withColumn("coverage", F.col("rows") / whole)
    return total.join(summary, "arm", "left").select("arm", "rows", "coverage", F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"))


def domain_accuracy(pairs: DataFrame) -> DataFrame:
    """Recall averaged over the domains that occur as truth or as prediction."""
    counts = pairs.groupBy("actual", "pred").agg(F.count(F.lit(1)).alias("n"))
    return per_class(counts).agg(F.avg("recall").alias("domain_accuracy"), F.count(F.lit(1)).alias("n_domains"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def label_remap(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Contiguous 0..K-1 labels: the classes of train in order, then those only in test."""
    marked = train.select(F.col(label).alias("name"), F.lit(0).alias("rest"))
    marked = marked.unionByName(test.select(F.col(label).alias("name"), F.lit(1).alias("rest")))
    names = marked.groupBy("name").agg(F.min("rest").alias("rest"))
    order = Window.orderBy("rest", "name")  # over the class list only
    return names.select("name", (F.col("rest") == 0).alias("in_train"), (F.row_number().over(order) - 1).alias("idx"))


def focal_loss(pt: Column, gamma: float = 2.0, alpha: Column | float = 1.0) -> Column:
    """Per-row focal loss from the probability of the true class.

    A probability of 0 counts as the smallest positive number: its loss is large but finite.
    """
    weight = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    log = F.when(pt.isNotNull(), F.ln(F.greatest(pt, F.lit(sys.float_info.min))))
    return F.pow(1.0 - pt, F.lit(float(gamma))) * -log * weight


def reduce_loss(df: DataFrame, loss: Column, ignored: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sum and count of a loss over the rows not ignored; nothing left means 0."""
    used = loss if ignored is None else F.when(~ignored, loss)
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(used), F.lit(0.0)).alias("mean_loss"),
        F.coalesce(F.sum(used), F.lit(0.0)).alias("sum_loss"),
        F.count(used).alias("n_rows"),
    )


def coarse_log_loss(probs: Column, true_idx: Column, names: Sequence[str], coarse: Mapping[str, str]) -> Column:
    """Negative log of the probability mass of the true coarse group, floored at 1e-7.

    ``coarse`` is the fine -> coarse vocabulary; a fine name it lacks falls into "Other".
    """
    groups = F.array(*[F.lit(coarse.get(n, OTHER)) for n in names])
    target = F.get(groups, true_idx)
    inside = F.zip_with(groups, probs, lambda g, p: F.when(g == target, p).otherwise(F.lit(0.0)))
    mass = F.aggregate(inside, F.lit(0.0), lambda a, p: a + p)
    return -F.ln(F.greatest(mass, F.lit(1e-7)))


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    """Per-row cross entropy from a logit, in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def weight_ratio(weights: DataFrame, column: str = "weight") -> DataFrame:
    """Largest over smallest positive finite class weight; fewer than two usable weights give 1."""
    value = F.col(column)
    usable = F.when(value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < float("inf")), value)
    ratio = F.when(F.count(usable) >= 2, F.max(usable) / F.min(usable)).otherwise(F.lit(1.0))
    return weights.agg(ratio.alias("ratio"), F.count(usable).alias("n_classes"))
