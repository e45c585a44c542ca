"""Queries on classifiers and decompositions; their results are checked by rows and by tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.functions.names import index_names
from spatialframes.operators import features, learning as ops, splits
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6
from spatialframes.plans.metrics import lineage
from spatialframes.plans.registry import query
from spatialframes.session import settle


def samples(spark, sf):
    """Vectors of an order's readings, its priority as the class, split by customer."""
    f = b.readings(spark, sf).groupBy("cell_id", "marker").agg(F.avg("value").alias("mean_value"))
    vocab = settle(index_names(f, "marker"))
    x = features.scatter_dense(f, vocab, vocab.count(), ["cell_id"], "mean_value").withColumnRenamed("dense", "features")
    x = x.withColumn("features", F.transform("features", lambda v: F.nullif(v, F.lit(0.0))))
    o = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("cell_id"), F.lit("all").alias("dataset_name"), F.col("o_custkey").alias("fov_name"),
        F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low").alias("label"),
    )
    rows = settle(ops.with_presence(x).join(o, "cell_id"))
    side = splits.inner_val(rows.select("dataset_name", "fov_name").distinct(), 0.2)
    return settle(rows.join(side, ["dataset_name", "fov_name"]))


def report(out):
    return out.select("cell_id", "label", "predicted_ct", F.transform("probs", r6).alias("probs"))


@query("classify")
def classify(spark, sf):
    rows = samples(spark, sf)
    out = ops.classify(rows.where("split = 'train'"), rows.where("split = 'inner_val'"), "label", ["low", "mid", "high", "unseen"], maxIter=10)
    return report(out)


@query("classify_forest")
def classify_forest(spark, sf):
    rows = samples(spark, sf)
    out = ops.classify(rows.where("split = 'train'"), rows.where("split = 'inner_val'"), "label", ["low", "mid", "high"], "forest", numTrees=10, maxDepth=4, seed=42)
    return report(out)


@query("classify_mlp")
def classify_mlp(spark, sf):
    rows = samples(spark, sf)
    scaled = rows.withColumn("features", F.transform("features", lambda v: v / 255.0))
    out = ops.classify(scaled.where("split = 'train'"), scaled.where("split = 'inner_val'"), "label", ["low", "mid", "high"], "perceptron", maxIter=10)
    return report(out)


@query("tune")
def tune(spark, sf):
    rows = samples(spark, sf)
    grid = [{"learner": "logistic", "maxIter": 5, "regParam": r} for r in (0.0, 0.1)] + [{"learner": "forest", "numTrees": 5, "maxDepth": 3, "seed": 42}]
    classes = rows.select(F.col("label").alias("name")).distinct()
    out = ops.tune(rows.where("split = 'train'"), rows.where("split = 'inner_val'"), "label", grid, classes, lineage(spark, sf), ["cell_id"], sample=2000)
    return out.withColumn("macro_f1", r6("macro_f1"))


@query("svd_energy")
def svd_energy(spark, sf):
    table, _ = ops.svd_energy(b.table(spark, sf, "embeddings"), "embedding", 64, 16)
    return table.select("component", r6("singular_value").alias("singular_value"), r6("explained").alias("explained"))


@query("svd_reduced")
def svd_reduced(spark, sf):
    e = b.table(spark, sf, "embeddings")
    _, directions = ops.svd_energy(e, "embedding", 64, 8)
    reduced = ops.project(e, "embedding", directions).select("vec_id", F.transform("reduced", lambda v: r6(F.abs(v))).alias("reduced"))
    return reduced
