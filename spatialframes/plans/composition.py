"""Queries on cohort composition: a supplier is a field, its line items the cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.operators import composition as ops
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6
from spatialframes.plans.registry import query, view

view(
    "typed",
    """SELECT l_suppkey AS fov_key, p_brand AS name, 1 - l_discount AS confidence, l_quantity < 4 AS abstained, l_returnflag AS flag
       FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
view("coarse", "SELECT p_brand AS fine, 'L' || min(p_size) AS coarse FROM part WHERE p_brand <> 'Brand#7' GROUP BY p_brand")


def typed(spark, sf):
    l = b.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_discount", "l_quantity", "l_returnflag")  # noqa: E741
    p = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return l.join(p, "l_partkey").select(
        F.col("l_suppkey").alias("fov_key"),
        F.col("p_brand").alias("name"),
        (1 - F.col("l_discount")).alias("confidence"),
        (F.col("l_quantity") < 4).alias("abstained"),
        F.col("l_returnflag").alias("flag"),
    )


def coarse(spark, sf):
    p = b.table(spark, sf, "part").where("p_brand <> 'Brand#7'")
    return p.groupBy(F.col("p_brand").alias("fine")).agg(F.concat(F.lit("L"), F.min("p_size")).alias("coarse"))


@query("composition", "SELECT fov_key, name, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY fov_key), 6) AS share FROM v_typed GROUP BY fov_key, name")
def composition(spark, sf):
    return ops.composition(typed(spark, sf)).withColumn("share", r6("share"))


LINEAGE = """(SELECT fov_key, coalesce(coarse, 'Other') AS lineage, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY fov_key) AS share
       FROM {rows} t LEFT JOIN v_coarse ON fine = name GROUP BY fov_key, coalesce(coarse, 'Other'))"""
view("lineages", LINEAGE.format(rows="v_typed")[1:-1])


def lineages(spark, sf):
    return ops.lineage_composition(typed(spark, sf), coarse(spark, sf))


@query("lineage_composition", "SELECT fov_key, lineage, n, round(share, 6) AS share FROM v_lineages")
def lineage_composition(spark, sf):
    return lineages(spark, sf).withColumn("share", r6("share"))


@query(
    "fov_confidence",
    "SELECT fov_key, count(*) AS n_cells, round(avg(CAST(abstained AS INTEGER)), 6) AS abstention_rate, round(avg(confidence), 6) AS mean_confidence FROM v_typed GROUP BY fov_key",
)
def fov_confidence(spark, sf):
    out = ops.fov_confidence(typed(spark, sf))
    return out.select("fov_key", "n_cells", r6("abstention_rate").alias("abstention_rate"), r6("mean_confidence").alias("mean_confidence"))


@query(
    "channel_scan",
    """SELECT fov_key, channel, round(avg(CAST(value > 0 AS INTEGER)), 6) AS positive_share, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99,
       round(quantile_cont(value, 0.99) / nullif(quantile_cont(value, 0.5), 0), 6) AS dynamic_range FROM v_pixels GROUP BY ALL""",
)
def channel_scan(spark, sf):
    out = ops.channel_scan(b.pixels(spark, sf))
    return out.select("fov_key", "channel", *[r6(c).alias(c) for c in ("positive_share", "median", "p99", "dynamic_range")])


# panel of a field: the part names it has in quantity; a lineage is marked by the names of its first parts
view("cpanel", "SELECT l_suppkey AS fov_key, p_name AS marker FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL HAVING max(l_quantity) > 45")
view("lmarkers", "SELECT DISTINCT coarse AS lineage, marker FROM (SELECT p_brand, min(p_name) AS marker FROM part GROUP BY p_brand) JOIN v_coarse ON fine = p_brand")
view(
    "biology",
    """SELECT r_name AS tissue, coarse AS lineage, CASE (n_nationkey + len(coarse)) % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'dominant' WHEN 2 THEN 'implausible' ELSE 'absent' END AS role
       FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT DISTINCT coarse, 'NATION_' || CAST(substr(fine, 7) AS INTEGER) AS n_name FROM v_coarse) USING (n_name)""",
)
view("sfovs", "SELECT s_suppkey AS fov_key, r_name AS tissue FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
view(
    "expected",
    """SELECT DISTINCT f.fov_key, y.lineage, role FROM v_sfovs f JOIN v_biology y USING (tissue) WHERE y.lineage IN (SELECT coarse FROM v_coarse WHERE fine <> 'Brand#3') AND (role IN ('implausible', 'absent')
       OR EXISTS (SELECT 1 FROM v_cpanel p JOIN v_lmarkers m USING (marker) WHERE p.fov_key = f.fov_key AND m.lineage = y.lineage))""",
)


def panel(spark, sf):
    l = b.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")  # noqa: E741
    p = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("marker"))
    strongest = l.join(p, "l_partkey").groupBy(F.col("l_suppkey").alias("fov_key"), "marker").agg(F.max("l_quantity").alias("q"))
    return strongest.where("q > 45").select("fov_key", "marker")


def type_markers(spark, sf):
    return b.table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_name").alias("marker"))


def expected(spark, sf):
    n, r = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    where = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", F.col("r_name").alias("tissue"))
    types = coarse(spark, sf)
    by_nation = types.select("coarse", F.concat(F.lit("NATION_"), F.substring("fine", 7, 9).cast("int")).alias("n_name")).distinct()
    roles = F.array(*[F.lit(x) for x in ("present", "dominant", "implausible", "absent")])
    role = F.get(roles, ((F.col("n_nationkey") + F.length("coarse")) % 4).cast("int"))
    biology = where.join(by_nation, "n_name").select("tissue", F.col("coarse").alias("lineage"), role.alias("role"))
    s = b.table(spark, sf, "supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey"))
    fovs = s.select(F.col("s_suppkey").alias("fov_key"), "tissue")
    marks = type_markers(spark, sf).join(types, F.col("name") == F.col("fine")).select(F.col("coarse").alias("lineage"), "marker").distinct()
    classes = types.where("fine <> 'Brand#3'").select(F.col("fine").alias("name"), F.col("coarse").alias("lineage"))
    return ops.expectations(fovs, biology, panel(spark, sf), marks, classes).distinct()


@query("expectations", "SELECT fov_key, lineage, role FROM v_expected")
def expectations(spark, sf):
    return expected(spark, sf)


@query(
    "plausibility",
    """, s AS (SELECT e.*, coalesce(l.share, 0.0) AS share, top FROM v_expected e LEFT JOIN v_lineages l USING (fov_key, lineage)
       LEFT JOIN (SELECT fov_key, arg_max(lineage, (n, lineage)) AS top FROM v_lineages GROUP BY fov_key) USING (fov_key)),
       v AS (SELECT CASE WHEN role = 'present' AND share <= 0 THEN 'expected_missing' WHEN role = 'implausible' AND top = lineage THEN 'implausible_majority'
       WHEN role = 'absent' AND share > 0.04 THEN 'must_be_absent' END AS "check", CAST(fov_key AS VARCHAR) AS "key", lineage AS detail FROM s)
       SELECT * FROM v WHERE "check" IS NOT NULL UNION ALL SELECT 'no_dominant', CAST(fov_key AS VARCHAR), '' FROM s WHERE role = 'dominant' GROUP BY fov_key HAVING max(share) <= 0.04""",
)
def plausibility(spark, sf):
    return ops.plausibility(expected(spark, sf), lineages(spark, sf), noise=0.04)


@query(
    "unsupported_types",
    """, t AS (SELECT fov_key, name, count(*) / sum(count(*)) OVER (PARTITION BY fov_key) AS share FROM v_typed GROUP BY fov_key, name),
       m AS (SELECT p_brand AS name, min(p_name) AS marker FROM part GROUP BY p_brand)
       SELECT t.fov_key, t.name, round(share, 6) AS share, CASE WHEN t.name < 'Brand#2' THEN 'caveat' ELSE 'candidate' END AS kind FROM t JOIN m USING (name)
       WHERE share > 0.03 AND NOT EXISTS (SELECT 1 FROM v_cpanel p WHERE p.fov_key = t.fov_key AND p.marker = m.marker)""",
)
def unsupported_types(spark, sf):
    types = ops.composition(typed(spark, sf))
    caveats = types.where("name < 'Brand#2'")
    out = ops.unsupported_types(types, type_markers(spark, sf), panel(spark, sf), caveats, limit=0.03)
    return out.withColumn("share", r6("share"))


DELTA = (
    ", a AS "
    + LINEAGE.format(rows="v_typed")
    + ", k AS "
    + LINEAGE.format(rows="(SELECT * FROM v_typed WHERE flag <> 'R')")
    + """, d AS (SELECT fov_key, lineage, coalesce(a.share, 0.0) AS before, coalesce(k.share, 0.0) AS after FROM a FULL JOIN k USING (fov_key, lineage)),
       w AS (SELECT coarse AS lineage, CASE WHEN coarse < 'L2' THEN 1 ELSE -1 END AS direction FROM (SELECT DISTINCT coarse FROM v_coarse WHERE coarse <> 'L3'))
       """
)


def delta(spark, sf):
    rows, types = typed(spark, sf), coarse(spark, sf)
    before = ops.lineage_composition(rows, types)
    after = ops.lineage_composition(rows.where("flag <> 'R'"), types)
    direction = F.when(F.col("coarse") < "L2", 1).otherwise(-1)
    wanted = types.where("coarse <> 'L3'").select(F.col("coarse").alias("lineage"), direction.alias("direction")).distinct()
    return ops.config_delta(before, after, wanted)


@query(
    "config_delta",
    DELTA + "SELECT fov_key, lineage, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) + 0 AS change, sign(after - before) = direction AS as_wanted FROM d LEFT JOIN w USING (lineage)",
    views=("typed", "coarse"),
)
def config_delta(spark, sf):
    return delta(spark, sf).select("fov_key", "lineage", *[r6(c).alias(c) for c in ("before", "after", "change")], "as_wanted")


@query(
    "delta_verdict",
    DELTA + "SELECT fov_key, count(*) FILTER (sign(after - before) = direction) AS n_wanted, count(*) FILTER (sign(after - before) <> direction) AS n_against FROM d LEFT JOIN w USING (lineage) GROUP BY fov_key",
    views=("typed", "coarse"),
)
def delta_verdict(spark, sf):
    return ops.delta_verdict(delta(spark, sf))
