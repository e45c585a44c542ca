"""Queries on class scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.functions.vectors import softmax
from spatialframes.operators import scoring as ops
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import CLASSES, r6, spread_sql
from spatialframes.plans.registry import query, view


def scored(spark, sf):
    return ops.score_logits(b.logits(spark, sf), CLASSES)


@query(
    "softmax",
    spread_sql("cell_index", "probs", "(SELECT cell_index, list_transform(probs, lambda p: round(p, 6)) AS probs FROM v_predictions)"),
)
def softmax_query(spark, sf):
    return b.spread(b.logits(spark, sf).withColumn("probs", softmax(F.col("logits"))), "probs", ["cell_index"])


@query(
    "argmax_label",
    "SELECT cell_index, predicted_ct, round(max_softmax, 6) AS max_softmax FROM v_scored",
)
def argmax_query(spark, sf):
    return scored(spark, sf).select("cell_index", "predicted_ct", r6("max_softmax").alias("max_softmax"))


view(
    "abstained",
    """SELECT s.*, coalesce(s.max_softmax < fence, false) AS abstained FROM v_scored s
       LEFT JOIN (SELECT dataset_name, fov_name, CASE WHEN count(*) >= 4 THEN
       quantile_cont(max_softmax, 0.25) - 0.2 * (quantile_cont(max_softmax, 0.75) - quantile_cont(max_softmax, 0.25)) END AS fence
       FROM v_scored GROUP BY ALL) USING (dataset_name, fov_name)""",
)


def abstained(spark, sf):
    return ops.iqr_abstain(scored(spark, sf), 0.2)


@query(
    "iqr_abstain",
    """SELECT dataset_name, fov_name, cell_index, abstained, predicted_ct AS predicted_ct_raw,
       CASE WHEN abstained THEN 'Unknown' ELSE predicted_ct END AS predicted_ct FROM v_abstained""",
)
def iqr_abstain(spark, sf):
    return abstained(spark, sf).select("dataset_name", "fov_name", "cell_index", "abstained", "predicted_ct_raw", "predicted_ct")


@query(
    "null_group_fence",
    """, g AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS s,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS p FROM orders),
       f AS (SELECT s, p, quantile_cont(o_totalprice, 0.25) - 0.1 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) AS fence
       FROM g GROUP BY ALL HAVING count(*) >= 4)
       SELECT g.o_orderkey, g.s AS status, g.p AS priority, coalesce(o_totalprice < fence, false) AS abstained FROM g
       LEFT JOIN f ON g.s IS NOT DISTINCT FROM f.s AND g.p IS NOT DISTINCT FROM f.p""",
)
def null_group_fence(spark, sf):
    o = b.table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("score"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
    )
    out = ops.iqr_abstain(o.withColumn("predicted_ct", F.lit("x")), 0.1, ("status", "priority"), "score")
    return out.select("o_orderkey", "status", "priority", "abstained")


view("allowed", "SELECT DISTINCT dataset_name || fov_name AS tissue, cell_type_actual AS name FROM v_logits WHERE fov_name <> 'f00'")


@query(
    "tissue_argmax",
    """, e AS (SELECT cell_index, dataset_name || fov_name AS tissue, unnest(probs) AS p, unnest(range(0, 10)) AS i FROM v_predictions),
       ok AS (SELECT e.* FROM e WHERE tissue NOT IN (SELECT tissue FROM v_allowed)
       OR EXISTS (SELECT 1 FROM v_allowed a WHERE a.tissue = e.tissue AND a.name = 't' || e.i))
       SELECT cell_index, tissue, 't' || arg_max(i, p) AS predicted_ct FROM ok GROUP BY ALL""",
)
def tissue_argmax(spark, sf):
    df = b.logits(spark, sf).withColumn("probs", softmax(F.col("logits")))
    df = df.withColumn("tissue", F.concat("dataset_name", "fov_name"))
    allowed = df.where("fov_name <> 'f00'").select("tissue", F.col("cell_type_actual").alias("name")).distinct()
    return ops.tissue_argmax(df, CLASSES, allowed).select("cell_index", "tissue", "predicted_ct")


@query(
    "reinstate_cells",
    """SELECT e.vec_id AS cell_index, coalesce(s.predicted_ct, 'Unknown') AS predicted_ct, coalesce(s.abstained, false) AS abstained,
       round(coalesce(s.max_softmax, 0.0), 6) AS top FROM embeddings e
       LEFT JOIN (SELECT * FROM v_abstained WHERE dataset_name = 'd1') s ON e.vec_id = s.cell_index""",
)
def reinstate_cells(spark, sf):
    ids = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_index"))
    kept = abstained(spark, sf).where("dataset_name = 'd1'")
    kept = kept.select("cell_index", F.col("predicted_ct_raw").alias("predicted_ct"), "probs", "abstained")
    out = ops.reinstate_cells(ids, kept, ["cell_index"], len(CLASSES))
    return out.select("cell_index", "predicted_ct", "abstained", r6(F.array_max("probs")).alias("top"))


@query(
    "predictions_wide",
    "SELECT "
    + ", ".join(f"round(probs[{i + 1}], 6) AS {c}" for i, c in enumerate(CLASSES))
    + ", cell_type_actual, cell_index, dataset_name, fov_name FROM v_predictions",
    views=("logits", "exps", "predictions"),
)
def predictions_wide(spark, sf):
    df = b.logits(spark, sf).withColumn("probs", F.transform(softmax(F.col("logits")), r6))
    return ops.predictions_wide(df, CLASSES)


@query(
    "shard_assign",
    """SELECT o_orderkey, CAST(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 16 AS INTEGER) AS shard FROM orders""",
)
def shard_assign(spark, sf):
    return ops.shard(b.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 16)


# the user model of the seam below: class c reads every tenth input from c on
def linear_model():
    import numpy as np

    weights = np.array([[1.0 if d % 10 == c else 0.0 for c in range(10)] for d in range(64)])
    return lambda x: x @ weights


@query(
    "batch_score",
    """SELECT vec_id, CAST(pos % 10 AS INTEGER) AS pos, round(sum(CAST(v AS DOUBLE)), 6) + 0 AS value FROM v_image_pos GROUP BY ALL""",
)
def batch_score(spark, sf):
    e = b.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    return b.spread(ops.batch_score(e, linear_model), "logits", ["vec_id"])
