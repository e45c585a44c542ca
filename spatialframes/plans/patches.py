"""Queries on windows round cells and on resampling. Images are 8 x 8, see the bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.operators import features, patches as ops
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6
from spatialframes.plans.registry import query, view

CROP = 6

view(
    "icells",
    """SELECT fov_key, cell_id, avg("row") AS c_row, avg("col") AS c_col FROM v_image_mask WHERE cell_id <> 0 GROUP BY ALL""",
)
view(
    "boxes",
    f"""SELECT fov_key, cell_id, CAST(round_even(c_row, 0) AS INTEGER) - {CROP // 2} AS r0, CAST(round_even(c_col, 0) AS INTEGER) - {CROP // 2} AS c0 FROM v_icells""",
)


def icells(spark, sf):
    return features.centroids(b.image_mask(spark, sf))


IN_BOX = f'p.fov_key = k.fov_key AND p."row" >= r0 AND p."row" < r0 + {CROP} AND p."col" >= c0 AND p."col" < c0 + {CROP}'


@query(
    "patch_pixels",
    f"""SELECT k.fov_key, k.cell_id, p.channel, CAST(p."row" - r0 AS INTEGER) AS pr, CAST(p."col" - c0 AS INTEGER) AS pc, p.value FROM v_boxes k JOIN v_images p ON {IN_BOX}""",
)
def patch_pixels(spark, sf):
    return ops.patch_pixels(icells(spark, sf), b.images(spark, sf), CROP).select("fov_key", "cell_id", "channel", "pr", "pc", "value")


@query(
    "patch_pixels_trunc",
    f"""SELECT k.fov_key, k.cell_id, count(*) AS n, round(sum(p.value), 6) + 0 AS total FROM (SELECT fov_key, cell_id, CAST(trunc(c_row) AS INTEGER) - {CROP // 2} AS r0,
       CAST(trunc(c_col) AS INTEGER) - {CROP // 2} AS c0 FROM v_icells) k JOIN v_images p ON {IN_BOX} GROUP BY ALL""",
)
def patch_pixels_trunc(spark, sf):
    out = ops.patch_pixels(icells(spark, sf), b.images(spark, sf), CROP, "trunc")
    return out.groupBy("fov_key", "cell_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total"))


@query(
    "neighbor_area",
    f"""SELECT k.fov_key, k.cell_id, count(*) FILTER (p.cell_id = k.cell_id) AS self_area, count(*) FILTER (p.cell_id <> k.cell_id) AS neighbor_area
       FROM v_boxes k JOIN v_image_mask p ON {IN_BOX} AND p.cell_id <> 0 GROUP BY ALL""",
)
def neighbor_area(spark, sf):
    return ops.neighbor_area(icells(spark, sf), b.image_mask(spark, sf), CROP)


GRID = f"(SELECT unnest(range(0, {CROP})) AS pr) CROSS JOIN (SELECT unnest(range(0, {CROP})) AS pc)"


PATCH_SQL = f"""SELECT k.fov_key, k.cell_id, c.channel, CAST(pr * {CROP} + pc AS INTEGER) AS pos, round(CASE WHEN m.cell_id = k.cell_id THEN p.value ELSE 0 END, 6) + 0 AS value
       FROM v_boxes k JOIN (SELECT DISTINCT fov_key, channel FROM v_images) c USING (fov_key) CROSS JOIN {GRID}
       LEFT JOIN v_images p ON p.fov_key = k.fov_key AND p."row" = r0 + pr AND p."col" = c0 + pc LEFT JOIN v_image_mask m ON m.fov_key = k.fov_key AND m."row" = r0 + pr AND m."col" = c0 + pc"""


@query("patch_arrays", PATCH_SQL)
def patch_arrays(spark, sf):
    out = ops.patch_arrays(icells(spark, sf), b.images(spark, sf), b.image_mask(spark, sf), CROP)
    return b.spread(out, "patch", ["fov_key", "cell_id", "channel"])


PATCH_FULL_SQL = f"""SELECT k.fov_key, k.cell_id, c.channel, CAST(pr * {CROP} + pc AS INTEGER) AS pos, round(coalesce(p.value, 0), 6) + 0 AS value
       FROM v_boxes k JOIN (SELECT DISTINCT fov_key, channel FROM v_images) c USING (fov_key) CROSS JOIN {GRID}
       LEFT JOIN v_images p ON p.fov_key = k.fov_key AND p."row" = r0 + pr AND p."col" = c0 + pc"""


@query("patch_arrays_full", PATCH_FULL_SQL)
def patch_arrays_full(spark, sf):
    out = ops.patch_arrays(icells(spark, sf), b.images(spark, sf), None, CROP)
    return b.spread(out, "patch", ["fov_key", "cell_id", "channel"])


@query(
    "distance_map",
    f""", g AS (SELECT k.fov_key, k.cell_id, pr, pc, coalesce(m.cell_id = k.cell_id, false) AS own FROM v_boxes k CROSS JOIN {GRID}
       LEFT JOIN v_image_mask m ON m.fov_key = k.fov_key AND m."row" = r0 + pr AND m."col" = c0 + pc),
       d AS (SELECT a.fov_key, a.cell_id, a.pr, a.pc, CASE WHEN a.own THEN min(sqrt((a.pr - o.pr) * (a.pr - o.pr) + (a.pc - o.pc) * (a.pc - o.pc))) ELSE 0.0 END AS v
       FROM g a JOIN g o ON a.fov_key = o.fov_key AND a.cell_id = o.cell_id AND NOT o.own GROUP BY a.fov_key, a.cell_id, a.pr, a.pc, a.own),
       n AS (SELECT *, max(v) OVER (PARTITION BY fov_key, cell_id) AS mx FROM d)
       SELECT fov_key, cell_id, CAST(pr * {CROP} + pc AS INTEGER) AS pos, round(v / mx, 6) AS value FROM n WHERE mx > 0""",
)
def distance_map(spark, sf):
    out = ops.distance_map(icells(spark, sf), b.image_mask(spark, sf), CROP)
    return b.spread(out, "distance", ["fov_key", "cell_id"])


# fields by label: shrunk, kept, grown
SCALE_SQL = "(SELECT vec_id AS fov_key, CASE WHEN label < 4 THEN 0.5::DOUBLE WHEN label < 7 THEN 1.5::DOUBLE ELSE 0.75::DOUBLE END AS scale FROM embeddings)"


def scales(spark, sf):
    label = F.col("label")
    scale = F.when(label < 4, 0.5).when(label < 7, 1.5).otherwise(0.75)
    return b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("fov_key"), scale.alias("scale"))


@query(
    "resample_nearest",
    f"""SELECT s.fov_key, CAST(i AS INTEGER) AS "row", CAST(j AS INTEGER) AS "col", m.cell_id FROM {SCALE_SQL} s CROSS JOIN (SELECT unnest(range(0, 12)) AS i) CROSS JOIN (SELECT unnest(range(0, 12)) AS j)
       JOIN v_image_mask m ON m.fov_key = s.fov_key AND m."row" = floor((i + 0.5) / scale) AND m."col" = floor((j + 0.5) / scale)""",
)
def resample_nearest(spark, sf):
    return ops.resample_nearest(b.image_mask(spark, sf), scales(spark, sf))


BILINEAR = """, o AS (SELECT s.fov_key, i, j, (i + 0.5) / scale - 0.5 AS y, (j + 0.5) / scale - 0.5 AS x FROM {scales} s CROSS JOIN (SELECT unnest(range(0, 12)) AS i) CROSS JOIN (SELECT unnest(range(0, 12)) AS j)
       WHERE i < round_even(8 * scale, 0) AND j < round_even(8 * scale, 0)),
       t AS (SELECT fov_key, i, j, floor(y) + a AS r, floor(x) + c AS cc, CASE WHEN a = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE WHEN c = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS w
       FROM o CROSS JOIN (VALUES (0), (1)) va(a) CROSS JOIN (VALUES (0), (1)) vc(c)),
       bil AS (SELECT t.fov_key, p.channel, CAST(i AS INTEGER) AS "row", CAST(j AS INTEGER) AS "col", sum(w * p.value) AS value FROM t JOIN v_images p ON p.fov_key = t.fov_key AND p."row" = greatest(least(r, 7), 0) AND p."col" = greatest(least(cc, 7), 0) GROUP BY ALL) """


@query("resample_bilinear", BILINEAR.format(scales=SCALE_SQL) + 'SELECT fov_key, channel, "row", "col", round(value, 6) + 0 AS value FROM bil', views=("images",))
def resample_bilinear(spark, sf):
    out = ops.resample_bilinear(b.images(spark, sf), scales(spark, sf))
    return out.select("fov_key", "channel", "row", "col", r6("value").alias("value"))


@query(
    "lost_cells",
    f"""SELECT DISTINCT fov_key, cell_id FROM v_image_mask WHERE cell_id <> 0 EXCEPT SELECT s.fov_key, m.cell_id FROM {SCALE_SQL} s CROSS JOIN (SELECT unnest(range(0, 12)) AS i) CROSS JOIN (SELECT unnest(range(0, 12)) AS j)
       JOIN v_image_mask m ON m.fov_key = s.fov_key AND m."row" = floor((i + 0.5) / scale) AND m."col" = floor((j + 0.5) / scale)""",
)
def lost_cells(spark, sf):
    m = b.image_mask(spark, sf)
    return ops.lost_cells(m, ops.resample_nearest(m, scales(spark, sf)))


RECIPE_SCALES = "(SELECT vec_id AS fov_key, CASE WHEN label < 3 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM embeddings)"


@query(
    "fov_recipe",
    BILINEAR.format(scales=RECIPE_SCALES)
    + """, q AS (SELECT fov_key, channel, quantile_cont(value, 0.999) AS q FROM bil WHERE value <> 0 GROUP BY ALL), c AS (SELECT bil.*, least(value, q) AS v FROM bil JOIN q USING (fov_key, channel)),
       n AS (SELECT *, min(v) OVER w AS mn, max(v) OVER w AS mx FROM c WINDOW w AS (PARTITION BY fov_key, channel))
       SELECT fov_key, channel, "row", "col", round((v - mn) / (mx - mn), 6) AS value FROM n""",
    views=("images",),
)
def fov_recipe(spark, sf):
    label = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("fov_key"), F.when(F.col("label") < 3, 0.375).otherwise(0.5).alias("native_mpp"))
    pixels, _, _ = ops.fov_recipe(b.images(spark, sf), b.image_mask(spark, sf), label)
    return pixels.select("fov_key", "channel", "row", "col", r6("value").alias("value"))


@query(
    "fov_recipe_centroids",
    f"""SELECT s.fov_key, cell_id, round(avg(i), 6) AS c_row, round(avg(j), 6) AS c_col, count(*) AS area FROM {RECIPE_SCALES} s CROSS JOIN (SELECT unnest(range(0, 12)) AS i) CROSS JOIN (SELECT unnest(range(0, 12)) AS j)
       JOIN v_image_mask m ON m.fov_key = s.fov_key AND m."row" = floor((i + 0.5) / scale) AND m."col" = floor((j + 0.5) / scale) WHERE cell_id <> 0 GROUP BY ALL""",
)
def fov_recipe_centroids(spark, sf):
    label = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("fov_key"), F.when(F.col("label") < 3, 0.375).otherwise(0.5).alias("native_mpp"))
    _, _, found = ops.fov_recipe(b.images(spark, sf), b.image_mask(spark, sf), label)
    return found.select("fov_key", "cell_id", r6("c_row").alias("c_row"), r6("c_col").alias("c_col"), "area")
