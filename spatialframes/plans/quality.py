"""Queries on metadata contracts: a web page stands for the metadata of a field."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.operators import quality as ops
from spatialframes.plans import bindings as b
from spatialframes.plans.registry import query, view

# lengths of url and page make shapes, names and gaps that are sometimes wrong
view(
    "meta",
    """SELECT page_id AS fov_key, length(url) AS u, length(html) % 7 AS h, length(html) AS n FROM pages""",
)
view(
    "shapes",
    """SELECT fov_key, CASE WHEN u < 24 THEN NULL WHEN u < 27 THEN [h, 64] ELSE [h, 64, CAST(n % 3 + 62 AS BIGINT)] END AS raw_shape,
       CASE WHEN u BETWEEN 28 AND 29 THEN NULL WHEN u = 31 THEN [64] ELSE [64, 63] END AS mask_shape,
       CASE n % 5 WHEN 0 THEN 'float32' WHEN 1 THEN NULL ELSE 'uint32' END AS mask_type FROM v_meta""",
)


def meta(spark, sf):
    return b.table(spark, sf, "pages").select(
        F.col("page_id").alias("fov_key"),
        F.length("url").cast("bigint").alias("u"),
        (F.length("html") % 7).cast("bigint").alias("h"),
        F.length("html").cast("bigint").alias("n"),
    )


def shapes(spark, sf):
    u, h, n = F.col("u"), F.col("h"), F.col("n")
    big = lambda *xs: F.array(*[x.cast("bigint") if not isinstance(x, int) else F.lit(x).cast("bigint") for x in xs])
    none = F.lit(None).cast("array<bigint>")
    raw = F.when(u < 24, none).when(u < 27, big(h, 64)).otherwise(big(h, 64, n % 3 + 62))
    mask = F.when(u.between(28, 29), none).when(u == 31, big(64)).otherwise(big(64, 63))
    kind = F.when(n % 5 == 0, F.lit("float32")).when(n % 5 != 1, F.lit("uint32"))
    return meta(spark, sf).select("fov_key", raw.alias("raw_shape"), mask.alias("mask_shape"), kind.alias("mask_type"))


@query(
    "shape_contract",
    """, s AS (SELECT *, CAST(fov_key AS VARCHAR) AS k, array_to_string(raw_shape, ',') AS rs, array_to_string(mask_shape, ',') AS ms, raw_shape IS NOT NULL AND mask_shape IS NOT NULL AS both_set FROM v_shapes)
       SELECT 'missing_raw' AS "check", k AS "key", '' AS detail FROM s WHERE raw_shape IS NULL
       UNION ALL SELECT 'missing_mask', k, '' FROM s WHERE raw_shape IS NOT NULL AND mask_shape IS NULL
       UNION ALL SELECT 'raw_rank', k, rs FROM s WHERE both_set AND len(raw_shape) <> 3
       UNION ALL SELECT 'mask_rank', k, ms FROM s WHERE both_set AND len(mask_shape) <> 2
       UNION ALL SELECT 'mask_type', k, mask_type FROM s WHERE both_set AND mask_type = 'float32'
       UNION ALL SELECT 'extent', k, rs || ' vs ' || ms FROM s WHERE both_set AND len(raw_shape) = 3 AND len(mask_shape) = 2 AND raw_shape[2:3] <> mask_shape""",
)
def shape_contract(spark, sf):
    return ops.shape_contract(shapes(spark, sf))


@query(
    "channel_contract",
    """, s AS (SELECT CAST(fov_key AS VARCHAR) AS k, h, CASE WHEN u % 4 = 0 THEN h + 1 ELSE h END AS names FROM v_meta)
       SELECT 'few_channels' AS "check", k AS "key", CAST(h AS VARCHAR) AS detail FROM s WHERE h <= 2
       UNION ALL SELECT 'name_count', k, names || ' vs ' || h FROM s WHERE names <> h""",
)
def channel_contract(spark, sf):
    m = meta(spark, sf)
    count = F.when(F.col("u") % 4 == 0, F.col("h") + 1).otherwise(F.col("h")).cast("int")
    return ops.channel_contract(m.select("fov_key", F.array("h").alias("raw_shape"), F.array_repeat(F.lit("c"), count).alias("channel_names")))


@query(
    "attr_contract",
    """, s AS (SELECT CAST(fov_key AS VARCHAR) AS k, * FROM v_meta)
       SELECT 'missing_centroids' AS "check", k AS "key", '' AS detail FROM s WHERE h = 0 UNION ALL SELECT 'missing_scale_factor', k, '' FROM s WHERE h = 1
       UNION ALL SELECT 'missing_source', k, '' FROM s WHERE h IN (1, 2) AND u < 30""",
)
def attr_contract(spark, sf):
    m = meta(spark, sf)
    h = F.col("h")
    return ops.attr_contract(
        m.select(
            "fov_key",
            F.when(h != 0, F.lit("{}")).alias("centroids"),
            F.when(h != 1, F.lit(1.0)).alias("scale_factor"),
            h.isin(1, 2, 3).alias("has_annotations"),
            F.when((h == 3) | (F.col("u") >= 30), F.lit("{}")).alias("source"),
        )
    )


@query(
    "matrix_contract",
    """, s AS (SELECT CAST(fov_key AS VARCHAR) AS k, * FROM v_meta WHERE u > 29)
       SELECT 'missing_markers' AS "check", k AS "key", '' AS detail FROM s WHERE h = 0 UNION ALL SELECT 'missing_matrix', k, '' FROM s WHERE h = 1
       UNION ALL SELECT 'matrix_not_2d', k, '0' FROM s WHERE h = 2 UNION ALL SELECT 'matrix_shape', k, '2x' || h || ' vs 2x3' FROM s WHERE h > 3""",
)
def matrix_contract(spark, sf):
    h = F.col("h").cast("int")
    row = F.array_repeat(F.lit("0"), F.greatest(h, F.lit(1)))
    empty = F.array().cast("array<array<string>>")
    matrix = F.when(h == 1, F.lit(None).cast("array<array<string>>")).when(h == 2, empty).otherwise(F.array(row, row))
    frame = meta(spark, sf).select(
        "fov_key",
        (F.col("u") > 29).alias("has_mp"),
        F.when(h != 0, F.array_repeat(F.lit("m"), 3)).alias("markers"),
        F.array_repeat(F.lit("t"), 2).alias("cell_types"),
        matrix.alias("matrix"),
    )
    return ops.matrix_contract(frame)


@query(
    "required_markers",
    """, req AS (SELECT user_id AS fov_key, event_type AS marker FROM events GROUP BY ALL UNION ALL SELECT DISTINCT -1 - n_nationkey, 'click' FROM nation),
       ch AS (SELECT DISTINCT user_id AS fov_key, event_type AS marker FROM events WHERE value > 20)
       SELECT 'sentinel_absent' AS "check", CAST(fov_key AS VARCHAR) AS "key", '' AS detail FROM (SELECT DISTINCT fov_key FROM req) WHERE fov_key NOT IN (SELECT user_id FROM events)
       UNION ALL SELECT 'marker_missing', CAST(fov_key AS VARCHAR), marker FROM req ANTI JOIN ch USING (fov_key, marker) WHERE fov_key IN (SELECT user_id FROM events)""",
)
def required_markers(spark, sf):
    e = b.table(spark, sf, "events").select(F.col("user_id").alias("fov_key"), F.col("event_type").alias("marker"), "value")
    gone = b.table(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("bigint").alias("fov_key"), F.lit("click").alias("marker"))
    required = e.select("fov_key", "marker").distinct().unionByName(gone)
    return ops.required_markers(required, e.where("value > 20"), e.select("fov_key"))


@query(
    "failure_gate",
    "SELECT count(*) AS n, count(*) FILTER (value > 200) AS n_failed, count(*) FILTER (value > 200) / count(*) > 0.01 AS abort FROM events",
)
def failure_gate(spark, sf):
    return ops.failure_gate(b.table(spark, sf, "events"), F.col("value") > 200)


@query(
    "length_contract",
    """, d AS (SELECT doc_id, len(string_split(text, ' ')) AS a, len(string_split(replace(text, chr(10), ' '), ' ')) AS b FROM documents)
       SELECT 'length' AS "check", CAST(doc_id AS VARCHAR) AS "key", a || ' vs ' || b AS detail FROM d WHERE a <> b""",
)
def length_contract(spark, sf):
    d = b.table(spark, sf, "documents")
    d = d.select("doc_id", F.split("text", " ").alias("a"), F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("b"))
    return ops.length_contract(d, "doc_id", "a", "b")


@query(
    "tissue_contract",
    """, f AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 500 THEN '' ELSE c_mktsegment END AS tissue FROM customer)
       SELECT 'no_tissue' AS "check", CAST(c_custkey AS VARCHAR) AS "key", '' AS detail FROM f WHERE tissue IS NULL OR tissue = ''
       UNION ALL SELECT 'unknown_tissue', CAST(c_custkey AS VARCHAR), tissue FROM f WHERE tissue > 'H'""",
)
def tissue_contract(spark, sf):
    c = b.table(spark, sf, "customer")
    tissue = F.when(F.col("c_acctbal") >= 500, F.col("c_mktsegment")).when(F.col("c_acctbal") >= 0, F.lit(""))
    vocab = c.where("c_mktsegment <= 'H'").select(F.col("c_mktsegment").alias("name"))
    return ops.tissue_contract(c.select(F.col("c_custkey").alias("fov_key"), tissue.alias("tissue")), vocab)
