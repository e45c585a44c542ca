"""Queries on classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.functions.vectors import argmax, softmax
from spatialframes.operators import metrics as ops
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import CLASSES, r6
from spatialframes.plans.registry import query, view
from spatialframes.plans.scoring import abstained

view(
    "pairs",
    """SELECT l.l_orderkey, l.l_linenumber, CASE WHEN o_orderstatus = 'P' THEN 'Unknown' WHEN c_acctbal < 2000 THEN cr.r_name ELSE cn.n_name END AS actual,
       sn.n_name AS pred FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey""",
)
view("classes", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
view(
    "conf",
    """SELECT actual, pred, count(*) AS n FROM v_pairs WHERE actual IN (SELECT name FROM v_classes)
       AND pred IN (SELECT name FROM v_classes) GROUP BY ALL""",
)
view(
    "credited",
    """SELECT actual, CASE WHEN parent IS NULL THEN pred ELSE actual END AS pred, CAST(sum(n) AS BIGINT) AS n
       FROM v_conf LEFT JOIN v_hierarchy ON actual = parent AND pred = child GROUP BY ALL""",
)


def pairs(spark, sf):
    """Cells of a line item: the customer's nation is the truth, the supplier's the prediction.

    Customers with a low balance are only known by region, the parent type.
    """
    t = lambda name: b.table(spark, sf, name)
    nation, region = t("nation"), t("region")
    where = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    truth = (
        t("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        .join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal"), "o_custkey")
        .join(where.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    )
    label = F.when(F.col("o_orderstatus") == "P", F.lit("Unknown")).when(F.col("c_acctbal") < 2000, F.col("r_name"))
    truth = truth.select(F.col("o_orderkey").alias("l_orderkey"), label.otherwise(F.col("n_name")).alias("actual"))
    pred = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    pred = pred.select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("pred"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return rows.join(truth, "l_orderkey").join(pred, "l_suppkey").select("l_orderkey", "l_linenumber", "actual", "pred")


def classes(spark, sf):
    names = b.table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return names.union(b.table(spark, sf, "region").select("r_name")).distinct()


def conf(spark, sf):
    return ops.confusion(pairs(spark, sf), classes(spark, sf))


def credited(spark, sf):
    return ops.hierarchy_credit(conf(spark, sf), b.hierarchy(spark, sf))


@query("confusion", "SELECT actual, pred, n FROM v_conf")
def confusion(spark, sf):
    return conf(spark, sf)


@query("hier_confusion", "SELECT actual, pred, n FROM v_credited")
def hier_confusion(spark, sf):
    return credited(spark, sf)


PER_CLASS = """, per AS (SELECT name, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits
       FROM (SELECT actual AS name, CAST(sum(n) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (actual = pred), 0) AS BIGINT) AS hits FROM {conf} GROUP BY actual)
       FULL JOIN (SELECT pred AS name, CAST(sum(n) AS BIGINT) AS predicted FROM {conf} GROUP BY pred) USING (name)),
       pr AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS r FROM per),
       f AS (SELECT *, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr)
       """
SUMMARY = """SELECT round(coalesce(avg(hits / (support + 1e-8)) FILTER (support >= {m}), 0.0), 6) AS macro_accuracy,
       round(sum(hits) / (sum(support) + 1e-8), 6) AS weighted_accuracy, round(coalesce(avg(f1) FILTER (support >= {m}), 0.0), 6) AS macro_f1,
       round(sum(support * f1) / greatest(sum(support), 1), 6) AS weighted_f1 FROM f"""


@query(
    "per_class_f1",
    PER_CLASS.format(conf="v_credited")
    + "SELECT name, support, predicted, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM f",
    views=("credited",),
)
def per_class_f1(spark, sf):
    out = ops.per_class(credited(spark, sf))
    return out.select("name", "support", "predicted", "hits", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


def summary_columns(out):
    return out.select(*[r6(c).alias(c) for c in ("macro_accuracy", "weighted_accuracy", "macro_f1", "weighted_f1")])


@query("class_summary", PER_CLASS.format(conf="v_conf") + SUMMARY.format(m=1), views=("conf",))
def class_summary(spark, sf):
    return summary_columns(ops.class_summary(conf(spark, sf)))


@query("class_summary_floor", PER_CLASS.format(conf="v_conf") + SUMMARY.format(m=50), views=("conf",))
def class_summary_floor(spark, sf):
    return summary_columns(ops.class_summary(conf(spark, sf), min_support=50))


@query(
    "hier_macro_f1",
    PER_CLASS.format(conf="v_credited") + "SELECT round(avg(f1) FILTER (support > 0), 6) AS macro_f1 FROM f",
    views=("credited",),
)
def hier_macro_f1(spark, sf):
    out = ops.hierarchical_macro_f1(pairs(spark, sf), classes(spark, sf), b.hierarchy(spark, sf))
    return out.select(r6("macro_f1").alias("macro_f1"))


@query(
    "confusion_norm",
    "SELECT actual, pred, round(n / (sum(n) OVER (PARTITION BY actual) + 1e-8), 6) AS share FROM v_conf",
)
def confusion_norm(spark, sf):
    return ops.confusion_norm(conf(spark, sf)).withColumn("share", r6("share"))


view(
    "lineage",
    "SELECT 't' || a AS parent, 't' || c AS child FROM (SELECT DISTINCT label % 5 AS a, label AS c FROM embeddings) WHERE a <> c",
)


def lineage(spark, sf):
    """Types five apart are parent and child."""
    e = b.table(spark, sf, "embeddings").select((F.col("label") % 5).alias("a"), F.col("label").alias("c")).distinct()
    return e.where("a <> c").select(F.concat(F.lit("t"), "a").alias("parent"), F.concat(F.lit("t"), "c").alias("child"))


def class_frame(spark, sf):
    return b.table(spark, sf, "embeddings").select(F.concat(F.lit("t"), "label").alias("name")).distinct()


ARM_SQL = """, {arm}c AS (SELECT actual, CASE WHEN parent IS NULL THEN pred ELSE actual END AS pred, count(*) AS n FROM
       (SELECT cell_type_actual AS actual, predicted_ct AS pred FROM v_abstained WHERE {where}) LEFT JOIN v_lineage ON actual = parent AND pred = child GROUP BY ALL),
       {arm}f AS (SELECT name, coalesce(s, 0) AS s, CASE WHEN coalesce(h, 0) = 0 THEN 0.0 ELSE 2.0 * (h / p) * (h / s) / (h / p + h / s) END AS f1
       FROM (SELECT actual AS name, sum(n) AS s, coalesce(sum(n) FILTER (actual = pred), 0) AS h FROM {arm}c GROUP BY actual)
       FULL JOIN (SELECT pred AS name, sum(n) AS p FROM {arm}c GROUP BY pred) USING (name))"""


@query(
    "abstain_report",
    ARM_SQL.format(arm="a", where="true")
    + ARM_SQL.format(arm="k", where="NOT abstained")
    + """ SELECT 'all' AS arm, count(*) AS "rows", 1.0::DOUBLE AS coverage, (SELECT round(avg(f1) FILTER (s > 0), 6) FROM af) AS macro_f1 FROM v_abstained
       UNION ALL SELECT 'kept', count(*) FILTER (NOT abstained), round(count(*) FILTER (NOT abstained) / count(*), 6),
       (SELECT round(avg(f1) FILTER (s > 0), 6) FROM kf) FROM v_abstained""",
)
def abstain_report(spark, sf):
    df = abstained(spark, sf).select(F.col("cell_type_actual").alias("actual"), F.col("predicted_ct_raw").alias("pred"), "abstained")
    out = ops.abstain_report(df, class_frame(spark, sf), lineage(spark, sf))
    return out.select("arm", "rows", r6("coverage").alias("coverage"), r6("macro_f1").alias("macro_f1"))


@query(
    "domain_accuracy",
    """, p AS (SELECT c_mktsegment AS actual, CASE WHEN o_totalprice < 100000 THEN 'BUILDING' WHEN o_orderstatus = 'F' THEN c_mktsegment ELSE 'MACHINERY' END AS pred
       FROM orders JOIN customer ON o_custkey = c_custkey),
       r AS (SELECT actual AS name, avg(CAST(actual = pred AS INTEGER)) AS recall FROM p GROUP BY actual)
       SELECT round(avg(coalesce(recall, 0)), 6) AS domain_accuracy, count(*) AS n_domains
       FROM r FULL JOIN (SELECT DISTINCT pred AS name FROM p) USING (name)""",
)
def domain_accuracy(spark, sf):
    o = b.table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderstatus")
    c = b.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("actual"))
    guess = F.when(F.col("o_totalprice") < 100000, F.lit("BUILDING")).when(F.col("o_orderstatus") == "F", F.col("actual"))
    df = o.join(c, "o_custkey").select("actual", guess.otherwise(F.lit("MACHINERY")).alias("pred"))
    return ops.domain_accuracy(df).select(r6("domain_accuracy").alias("domain_accuracy"), "n_domains")


@query("class_counts", "SELECT ct_label, count(*) AS n FROM v_labeled GROUP BY ALL")
def class_counts(spark, sf):
    return ops.class_counts(b.labeled(spark, sf), "ct_label")


@query(
    "label_remap",
    """, n AS (SELECT ct_label AS name, bool_or(domain <> 'BUILDING') AS in_train FROM v_labeled GROUP BY ALL)
       SELECT name, in_train, CAST(row_number() OVER (ORDER BY in_train DESC, name) - 1 AS INTEGER) AS idx FROM n""",
)
def label_remap(spark, sf):
    rows = b.labeled(spark, sf)
    return ops.label_remap(rows.where("domain <> 'BUILDING'"), rows.where("domain = 'BUILDING'"), "ct_label")


@query(
    "focal_loss",
    """, p AS (SELECT dataset_name, cell_type_actual, probs[CAST(substr(cell_type_actual, 2) AS INTEGER) + 1] AS pt FROM v_predictions),
       l AS (SELECT dataset_name, CASE WHEN cell_type_actual <> 't3' THEN pow(1 - pt, 2) * -ln(pt) END AS loss FROM p)
       SELECT dataset_name, round(coalesce(avg(loss), 0), 6) AS mean_loss, round(coalesce(sum(loss), 0), 6) AS sum_loss, count(loss) AS n_rows FROM l GROUP BY ALL""",
)
def focal_loss(spark, sf):
    df = b.logits(spark, sf).withColumn("probs", softmax(F.col("logits")))
    pt = F.get("probs", F.substring("cell_type_actual", 2, 3).cast("int"))
    out = ops.reduce_loss(df, ops.focal_loss(pt), F.col("cell_type_actual") == "t3", ["dataset_name"])
    return out.select("dataset_name", r6("mean_loss").alias("mean_loss"), r6("sum_loss").alias("sum_loss"), "n_rows")


# fine type -> lineage; t8 and t9 have none and fall into "Other"
COARSE = {"t0": "Lymphoid", "t1": "Lymphoid", "t2": "Myeloid", "t3": "Myeloid", "t4": "Stromal", "t5": "Stromal", "t6": "Epithelial", "t7": "Epithelial"}


@query(
    "coarse_logloss",
    """, e AS (SELECT cell_index, cell_type_actual, unnest(probs) AS p, unnest(range(0, 10)) AS i FROM v_predictions),
       m AS (SELECT cell_index, sum(p) AS mass FROM e WHERE least(i // 2, 4) = least(CAST(substr(cell_type_actual, 2) AS INTEGER) // 2, 4) GROUP BY ALL)
       SELECT cell_index, round(-ln(greatest(mass, 1e-7)), 6) + 0 AS loss FROM m""",
)
def coarse_logloss(spark, sf):
    df = b.logits(spark, sf).withColumn("probs", softmax(F.col("logits")))
    loss = ops.coarse_log_loss(F.col("probs"), F.substring("cell_type_actual", 2, 3).cast("int"), CLASSES, COARSE)
    return df.select("cell_index", r6(loss).alias("loss"))


@query(
    "masked_losses",
    """, j AS (SELECT 8 * score - 4 AS x, CASE WHEN value = '1' OR value = '2' THEN 1.0 ELSE 0.0 END AS y, value NOT IN ('?', '0.5') AS valid, marker, score
       FROM v_positivity JOIN v_truth USING (dataset_name, cell_type, marker))
       SELECT marker, round(coalesce(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) FILTER (valid), 0), 6) AS bce,
       round(coalesce(avg((score - y) * (score - y)) FILTER (NOT valid), 0), 6) AS mse FROM j GROUP BY marker""",
)
def masked_losses(spark, sf):
    from spatialframes.operators.positivity import lenient_entry

    df = b.positivity(spark, sf).join(b.truth(spark, sf), ["dataset_name", "cell_type", "marker"])
    positive, valid = lenient_entry(F.col("value"))
    df = df.withColumn("y", positive.cast("double")).withColumn("valid", valid).withColumn("x", 8 * F.col("score") - 4)
    bce = ops.reduce_loss(df, ops.binary_cross_entropy(F.col("x"), F.col("y")), ~F.col("valid"), ["marker"])
    gap = F.col("score") - F.col("y")
    mse = ops.reduce_loss(df, gap * gap, F.col("valid"), ["marker"])
    mse = mse.select("marker", r6("mean_loss").alias("mse"))
    return bce.select("marker", r6("mean_loss").alias("bce")).join(mse, "marker")


@query(
    "weight_ratio",
    """, w AS (SELECT sqrt(sum(n) OVER () / n) AS weight FROM (SELECT ct_label, count(*) AS n FROM v_labeled GROUP BY ALL))
       SELECT round(max(weight) / min(weight), 6) AS ratio, count(*) AS n_classes FROM w WHERE weight > 0""",
)
def weight_ratio(spark, sf):
    from spatialframes.operators.sampling import class_weights

    out = ops.weight_ratio(class_weights(b.labeled(spark, sf), "ct_label", "sqrt", floor=1))
    return out.select(r6("ratio").alias("ratio"), "n_classes")
