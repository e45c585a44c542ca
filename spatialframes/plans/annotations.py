"""Queries on annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.operators import annotations as ops
from spatialframes.operators import quality
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6
from spatialframes.plans.registry import query, view
from spatialframes.plans.splits import strat

# annotations by id: line items name a part as their cell, the return flag is the type
view(
    "byid",
    """SELECT o_custkey AS fov_key, l_partkey AS cell_id, l_returnflag AS ct_name, l_orderkey * 10 + l_linenumber AS pos
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
view("idcells", "SELECT o_custkey AS fov_key, l_partkey AS cell_id, min(l_quantity) AS c_row, max(l_quantity) AS c_col FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY ALL")


def byid(spark, sf):
    l = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")  # noqa: E741
    o = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


def id_annotations(spark, sf):
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return byid(spark, sf).select(F.col("o_custkey").alias("fov_key"), F.col("l_partkey").alias("cell_id"), F.col("l_returnflag").alias("ct_name"), pos.alias("pos"))


def id_cells(spark, sf):
    rows = byid(spark, sf).where("o_orderstatus <> 'F'")
    return rows.groupBy(F.col("o_custkey").alias("fov_key"), F.col("l_partkey").alias("cell_id")).agg(
        F.min("l_quantity").alias("c_row"), F.max("l_quantity").alias("c_col")
    )


@query(
    "ann_by_id",
    "SELECT fov_key, cell_id, ct_name, pos, c_row, c_col, c_row IS NOT NULL AS matched FROM v_byid LEFT JOIN v_idcells USING (fov_key, cell_id)",
)
def ann_by_id(spark, sf):
    return ops.ann_by_id(id_annotations(spark, sf), id_cells(spark, sf))


@query(
    "annotation_drop_rate",
    """, a AS (SELECT fov_key, 'id' AS kind, CASE WHEN c_row IS NOT NULL THEN cell_id END AS cell_id FROM v_byid LEFT JOIN v_idcells USING (fov_key, cell_id)),
       r AS (SELECT fov_key, kind, count(*) AS attempts, count(*) FILTER (cell_id IS NULL) AS drops FROM a GROUP BY ALL)
       SELECT fov_key, kind, attempts, drops, round(drops / attempts, 6) AS rate FROM r WHERE drops / attempts > 0.05""",
)
def annotation_drop_rate(spark, sf):
    joined = ops.ann_by_id(id_annotations(spark, sf), id_cells(spark, sf))
    tried = joined.select("fov_key", F.lit("id").alias("kind"), F.when(F.col("matched"), F.col("cell_id")).alias("cell_id"))
    return quality.annotation_drop_rate(tried).withColumn("rate", r6("rate"))


@query(
    "annotation_collapse",
    """SELECT fov_key, cell_id, min(ct_name) AS ct_name, count(*) - 1 AS duplicates FROM v_byid GROUP BY ALL HAVING count(DISTINCT ct_name) = 1""",
)
def annotation_collapse(spark, sf):
    return ops.annotation_collapse(id_annotations(spark, sf))


@query(
    "collapse_counters",
    """, g AS (SELECT fov_key, cell_id, count(DISTINCT ct_name) AS d, count(*) AS n FROM v_byid GROUP BY ALL)
       SELECT fov_key, count(*) FILTER (d = 1) AS n_labeled, CAST(coalesce(sum(n - 1) FILTER (d = 1), 0) AS BIGINT) AS n_duplicates, count(*) FILTER (d > 1) AS n_conflicts FROM g GROUP BY fov_key""",
)
def collapse_counters(spark, sf):
    return ops.collapse_counters(id_annotations(spark, sf))


@query(
    "nearest_centroid",
    """SELECT fov_key, pos, ct_name, arg_min(cell_id, (d, cell_id)) AS cell_id FROM (SELECT m.fov_key, m.pos, m.ct_name, c.cell_id,
       sqrt((m."row" - c_row) * (m."row" - c_row) + (m."col" - c_col) * (m."col" - c_col)) AS d
       FROM v_marks m LEFT JOIN v_cells c ON m.fov_key = c.fov_key AND sqrt((m."row" - c_row) * (m."row" - c_row) + (m."col" - c_col) * (m."col" - c_col)) < 1.5) GROUP BY ALL""",
)
def nearest_centroid(spark, sf):
    return ops.nearest_centroid(b.marks(spark, sf), b.cells(spark, sf)).select("fov_key", "pos", "ct_name", "cell_id")


@query(
    "nearest_scaled",
    """, m AS (SELECT fov_key, pos, ct_name, "row" * 1.25::DOUBLE AS r, "col" * 1.25::DOUBLE AS c FROM v_marks WHERE fov_key <> 'f00' UNION ALL SELECT fov_key, pos, ct_name, "row", "col" FROM v_marks WHERE fov_key = 'f00')
       SELECT fov_key, pos, arg_min(cell_id, (d, cell_id)) AS cell_id FROM (SELECT m.fov_key, m.pos, k.cell_id, sqrt((r - c_row) * (r - c_row) + (c - c_col) * (c - c_col)) AS d
       FROM m JOIN v_cells k ON m.fov_key = k.fov_key AND sqrt((r - c_row) * (r - c_row) + (c - c_col) * (c - c_col)) < 1.5) GROUP BY ALL""",
)
def nearest_scaled(spark, sf):
    marks = b.marks(spark, sf)
    factors = marks.where("fov_key <> 'f00'").select("fov_key", F.lit(1.25).alias("scale_factor")).distinct()
    out = ops.nearest_centroid(ops.scale_marks(marks, factors), b.cells(spark, sf))
    return out.where(F.col("cell_id").isNotNull()).select("fov_key", "pos", "cell_id")


@query(
    "nearest_box",
    """SELECT m.fov_key, m.pos, min(c.cell_id) AS cell_id FROM v_marks m LEFT JOIN v_cells c ON m.fov_key = c.fov_key AND abs(m."row" - c_row) < 1.25 AND abs(m."col" - c_col) < 1.25 GROUP BY ALL""",
)
def nearest_box(spark, sf):
    return ops.nearest_box(b.marks(spark, sf), b.cells(spark, sf), 1.25).select("fov_key", "pos", "cell_id")


view("tissue_rows", "SELECT 'r' || tissue AS tissue, ct_label AS name, dataset_name, fov_name FROM v_labeled WHERE tissue <> 4 OR ct_label LIKE 'rare%'")


def tissue_rows(spark, sf):
    rows = b.labeled(spark, sf).where("tissue <> 4 OR ct_label LIKE 'rare%'")
    return rows.select(F.concat(F.lit("r"), "tissue").alias("tissue"), F.col("ct_label").alias("name"), "dataset_name", "fov_name")


def joined_names(df):
    return df.withColumn("ct_names", F.array_join("ct_names", ","))


def priorities(spark, sf):
    return b.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name")).distinct()


@query(
    "tissue_types",
    "SELECT tissue, array_to_string(list(DISTINCT name ORDER BY name), ',') AS ct_names FROM v_tissue_rows WHERE name IN (SELECT o_orderpriority FROM orders) GROUP BY tissue",
)
def tissue_types(spark, sf):
    return joined_names(ops.tissue_types(tissue_rows(spark, sf), priorities(spark, sf)))


@query(
    "tissue_types_train",
    """SELECT tissue, array_to_string(list(DISTINCT name ORDER BY name), ',') AS ct_names FROM v_tissue_rows SEMI JOIN (SELECT * FROM v_strat WHERE split = 'train' AND domain = 'BUILDING') USING (dataset_name, fov_name)
       WHERE name IN (SELECT o_orderpriority FROM orders) GROUP BY tissue""",
)
def tissue_types_train(spark, sf):
    splits = strat(spark, sf).where("domain = 'BUILDING'")
    return joined_names(ops.tissue_types_train(tissue_rows(spark, sf), splits, priorities(spark, sf)))


@query("dataset_types", "SELECT dataset_name AS \"key\", array_to_string(list(DISTINCT ct_label ORDER BY ct_label), ',') AS ct_names FROM v_labeled GROUP BY dataset_name")
def dataset_types(spark, sf):
    rows = b.labeled(spark, sf).select(F.col("dataset_name").alias("key"), F.array("ct_label").alias("ct_names"))
    return joined_names(ops.dataset_types(rows))


@query(
    "domain_fallback",
    """, m AS (SELECT c_custkey AS fov_key, upper(c_mktsegment) AS domain FROM customer WHERE c_acctbal > 5000)
       SELECT c_custkey AS fov_key, coalesce(domain, upper(trim(modality))) AS domain FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ' ' ELSE ' ' || lower(c_mktsegment) || '  ' END AS modality FROM customer)
       LEFT JOIN m ON c_custkey = fov_key WHERE coalesce(domain, upper(trim(modality))) <> ''""",
)
def domain_fallback(spark, sf):
    c = b.table(spark, sf, "customer")
    modality = F.when(F.col("c_acctbal") < 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("  ")))
    fovs = c.select(F.col("c_custkey").alias("fov_key"), modality.alias("modality"))
    mapping = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("fov_key"), F.upper("c_mktsegment").alias("domain"))
    return ops.domain_fallback(fovs, mapping).select("fov_key", "domain")


# every point names its own id as an annotation, those that are no cell miss; marks come on top
view("entries", """SELECT fov_key, 't' || label AS ct_name, vec_id AS pos, vec_id AS cell_id, CAST(NULL AS DOUBLE) AS "row", CAST(NULL AS DOUBLE) AS "col" FROM v_points
       UNION ALL SELECT fov_key, ct_name, pos, NULL, "row", "col" FROM v_marks""")
view(
    "attempts",
    """SELECT e.fov_key, 'id' AS kind, c.cell_id, e.ct_name FROM v_entries e LEFT JOIN v_cells c ON c.fov_key = e.fov_key AND c.cell_id = e.cell_id WHERE e.cell_id IS NOT NULL
       UNION ALL SELECT e.fov_key, 'centroid', n.cell_id, e.ct_name FROM v_entries e LEFT JOIN (SELECT m.fov_key, m.pos, arg_min(c.cell_id, (sqrt((m."row" - c_row) * (m."row" - c_row) + (m."col" - c_col) * (m."col" - c_col)), c.cell_id)) AS cell_id
       FROM v_marks m JOIN v_cells c ON m.fov_key = c.fov_key AND sqrt((m."row" - c_row) * (m."row" - c_row) + (m."col" - c_col) * (m."col" - c_col)) < 1.5 GROUP BY ALL) n
       ON n.fov_key = e.fov_key AND n.pos = e.pos WHERE e.cell_id IS NULL""",
)


def resolved(spark, sf):
    points = b.points(spark, sf)
    nothing = F.lit(None).cast("double")
    ids = points.select("fov_key", F.concat(F.lit("t"), "label").alias("ct_name"), F.col("vec_id").alias("pos"), F.col("vec_id").alias("cell_id"), nothing.alias("row"), nothing.alias("col"))
    marks = b.marks(spark, sf).select("fov_key", "ct_name", "pos", F.lit(None).cast("bigint").alias("cell_id"), "row", "col")
    fovs = points.select("fov_key", F.lit(1.0).alias("scale_factor")).distinct()
    return ops.resolve_annotations(ids.unionByName(marks), b.cells(spark, sf), fovs)


@query(
    "resolve_annotations",
    """SELECT fov_key, cell_id, min(ct_name) AS ct_name, count(*) - 1 AS duplicates FROM v_attempts WHERE cell_id IS NOT NULL GROUP BY fov_key, cell_id HAVING count(DISTINCT ct_name) = 1""",
)
def resolve_annotations(spark, sf):
    return resolved(spark, sf)[0]


@query(
    "resolve_drop_rate",
    """SELECT fov_key, kind, count(*) AS attempts, count(*) FILTER (cell_id IS NULL) AS drops, round(count(*) FILTER (cell_id IS NULL) / count(*), 6) AS rate
       FROM v_attempts GROUP BY ALL HAVING count(*) FILTER (cell_id IS NULL) / count(*) > 0.05""",
)
def resolve_drop_rate(spark, sf):
    return quality.annotation_drop_rate(resolved(spark, sf)[1]).withColumn("rate", r6("rate"))


@query(
    "cell_index",
    """SELECT a.fov_key AS dataset_name, a.fov_key AS fov_name, upper(a.fov_key) AS domain, 'lung' AS tissue, a.cell_id, a.ct_name AS ct_label, round(c_row, 6) + 0 AS c_row, round(c_col, 6) + 0 AS c_col
       FROM (SELECT fov_key, cell_id, min(ct_name) AS ct_name FROM v_attempts WHERE cell_id IS NOT NULL GROUP BY fov_key, cell_id HAVING count(DISTINCT ct_name) = 1) a
       JOIN v_cells c ON c.fov_key = a.fov_key AND c.cell_id = a.cell_id WHERE ct_name <> 't3'""",
)
def cell_index(spark, sf):
    points = b.points(spark, sf)
    fovs = points.select("fov_key", F.upper("fov_key").alias("domain"), F.lit("lung").alias("tissue")).distinct()
    types = points.where("label <> 3").select(F.concat(F.lit("t"), "label").alias("name"))
    out = ops.cell_index(resolved(spark, sf)[0], b.cells(spark, sf), fovs, types)
    return out.withColumn("c_row", r6("c_row")).withColumn("c_col", r6("c_col"))
