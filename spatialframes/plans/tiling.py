"""Queries on image tiles, against the SQL of the same operators on pixels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spatialframes.functions.names import index_names
from spatialframes.operators import tile_ops as ops
from spatialframes.operators import tile_patches as windows
from spatialframes.operators.phenotype import predict_windows
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6
from spatialframes.plans.patches import BILINEAR, CROP, GRID, PATCH_FULL_SQL, PATCH_SQL, RECIPE_SCALES, SCALE_SQL, icells, scales
from spatialframes.plans.registry import query
from spatialframes.plans.signal import GAUSSIAN_SQL, MEDIAN_SQL
from spatialframes.session import settle
from spatialframes.sources.tiles import tiles_to_pixels


def rounded(tiles):
    return tiles_to_pixels(tiles).select("fov_key", "channel", "row", "col", r6("value").alias("value"))


# 3 x 5 tiles of 8 x 8 images: the last of either axis is smaller, and the Gaussian reaches beyond a neighbour
@query("denoise_median_tiles", MEDIAN_SQL)
def denoise_median_tiles(spark, sf):
    return rounded(ops.denoise_tiles(b.image_tiles(spark, sf, 3, 5), "median", 3))


@query("denoise_gaussian_tiles", GAUSSIAN_SQL)
def denoise_gaussian_tiles(spark, sf):
    return rounded(ops.denoise_tiles(b.image_tiles(spark, sf, 3, 5), "gaussian", 3))


@query(
    "resample_bilinear_tiles",
    BILINEAR.format(scales=SCALE_SQL) + 'SELECT fov_key, channel, "row", "col", round(value, 6) + 0 AS value FROM bil',
    views=("images",),
)
def resample_bilinear_tiles(spark, sf):
    return rounded(ops.resample_bilinear_tiles(b.image_tiles(spark, sf, 5, 3), scales(spark, sf)))


@query(
    "resample_nearest_tiles",
    f"""SELECT s.fov_key, CAST(i AS INTEGER) AS "row", CAST(j AS INTEGER) AS "col", m.cell_id FROM {SCALE_SQL} s CROSS JOIN (SELECT unnest(range(0, 12)) AS i) CROSS JOIN (SELECT unnest(range(0, 12)) AS j)
       JOIN v_image_mask m ON m.fov_key = s.fov_key AND m."row" = floor((i + 0.5) / scale) AND m."col" = floor((j + 0.5) / scale)""",
)
def resample_nearest_tiles(spark, sf):
    out = ops.resample_nearest_tiles(b.mask_tiles(spark, sf, 5, 3), scales(spark, sf))
    return tiles_to_pixels(out.withColumnRenamed("labels", "values")).selectExpr("fov_key", "`row`", "`col`", "value AS cell_id")


# --- windows ------------------------------------------------------------------------------------------------


def cut(spark, sf, **more):
    """Windows of 6 x 6 from 3 x 5 tiles; a window meets up to nine of them."""
    return windows.cell_windows(icells(spark, sf), b.image_tiles(spark, sf, 3, 5), b.mask_tiles(spark, sf, 3, 5), CROP, **more)


def by_channel(out, size):
    """The stack as rows ``(fov_key, cell_id, channel, pos, value)``."""
    rows = out.select("fov_key", "cell_id", "panel", F.posexplode("stack").alias("at", "value"))
    channel = F.get("panel", F.floor(F.col("at") / (size * size)).cast("int"))
    return rows.select("fov_key", "cell_id", channel.alias("channel"), (F.col("at") % (size * size)).cast("int").alias("pos"), r6("value").alias("value"))


@query("patch_arrays_of_tiles", PATCH_SQL)
def patch_arrays_of_tiles(spark, sf):
    return by_channel(cut(spark, sf), CROP)


@query(
    "context_planes",
    f""", g AS (SELECT k.fov_key, k.cell_id, pr, pc, coalesce(m.cell_id, 0) AS label FROM v_boxes k CROSS JOIN {GRID}
       LEFT JOIN v_image_mask m ON m.fov_key = k.fov_key AND m."row" = r0 + pr AND m."col" = c0 + pc),
       d AS (SELECT a.fov_key, a.cell_id, a.pr, a.pc, a.label, CASE WHEN a.label = a.cell_id THEN min(sqrt((a.pr - o.pr) * (a.pr - o.pr) + (a.pc - o.pc) * (a.pc - o.pc))) ELSE 0.0 END AS v
       FROM g a JOIN g o ON a.fov_key = o.fov_key AND a.cell_id = o.cell_id AND o.label <> o.cell_id GROUP BY a.fov_key, a.cell_id, a.pr, a.pc, a.label)
       SELECT fov_key, cell_id, CAST(pr * {CROP} + pc AS INTEGER) AS pos, label = cell_id AS own, label <> cell_id AND label <> 0 AS neighbor,
       round(v / max(v) OVER (PARTITION BY fov_key, cell_id), 6) AS distance FROM d""",
)
def context_planes(spark, sf):
    out = cut(spark, sf, channels=False).select("fov_key", "cell_id", F.posexplode(F.arrays_zip(*windows.PLANES)).alias("pos", "p"))
    return out.select(
        "fov_key", "cell_id", "pos", (F.col("p.self_mask") > 0).alias("own"), (F.col("p.neighbor_mask") > 0).alias("neighbor"), r6("p.distance").alias("distance")
    )


# a 6 x 6 window at half its size: a Gaussian of sigma 1/2 over five pixels, mirrored at the ends, then the mean of two
_smooth = [math.exp(-2.0 * d * d) for d in range(-2, 3)]
_taps: dict[tuple[int, int], float] = {}
for _o in range(3):
    for _at in (2 * _o, 2 * _o + 1):
        for _d, _w in zip(range(-2, 3), _smooth):
            _s = abs(_at + _d)
            _s = 10 - _s if _s > 5 else _s
            _taps[_o, _s] = _taps.get((_o, _s), 0.0) + _w / sum(_smooth) / 2
TAPS = ", ".join(f"({o}, {s}, {w!r})" for (o, s), w in sorted(_taps.items()))


@query(
    "patch_half_size",
    f""", taps AS (SELECT o, s, CAST(w AS DOUBLE) AS w FROM (VALUES {TAPS}) t(o, s, w)),
       a AS ({PATCH_FULL_SQL.replace("round(coalesce(p.value, 0), 6) + 0", "coalesce(p.value, 0)")}),
       z AS (SELECT a.fov_key, a.cell_id, a.channel, r.o AS i, c.o AS j, sum(r.w * c.w * a.value) AS v FROM a JOIN taps r ON r.s = a.pos // {CROP} JOIN taps c ON c.s = a.pos % {CROP} GROUP BY ALL),
       n AS (SELECT k.fov_key, k.cell_id, i, j, coalesce(m.cell_id = k.cell_id, false) AS own FROM v_boxes k CROSS JOIN (SELECT unnest(range(0, 3)) AS i) CROSS JOIN (SELECT unnest(range(0, 3)) AS j)
       LEFT JOIN v_image_mask m ON m.fov_key = k.fov_key AND m."row" = r0 + 2 * i + 1 AND m."col" = c0 + 2 * j + 1)
       SELECT z.fov_key, z.cell_id, channel, CAST(i * 3 + j AS INTEGER) AS pos, round(CASE WHEN own THEN v ELSE 0 END, 6) + 0 AS value FROM z JOIN n USING (fov_key, cell_id, i, j)""",
    views=("boxes", "images", "image_mask"),
)
def patch_half_size(spark, sf):
    return by_channel(cut(spark, sf, output_size=CROP // 2), CROP // 2)


# --- cell types from windows --------------------------------------------------------------------------------

# the user model: fixed weights of the summed own signal by marker, and of the three context planes
PLANE_WEIGHTS = [[2.0, -1.0, 0.5], [-1.0, 1.5, 1.0], [0.5, 0.25, -1.0]]


def window_model():
    import numpy as np

    by_marker = np.array([[float((m * 3 + c * 5) % 7 - 3) for c in range(3)] for m in range(10)])
    by_plane = np.array(PLANE_WEIGHTS)

    def model(sample, context, positions, absent):
        signal = np.where(absent, 0.0, sample.sum(axis=(2, 3, 4)))
        logits = (signal[:, :, None] * by_marker[np.where(absent, 0, positions)]).sum(axis=1) / 10
        return logits + context.sum(axis=(2, 3)) / 36 @ by_plane

    return model


_planes = ", ".join(f"({c}, {a}, {b_}, {d})" for c, (a, b_, d) in enumerate(zip(*PLANE_WEIGHTS)))


@query(
    "predict_patches",
    BILINEAR.format(scales=RECIPE_SCALES)
    + f""", q AS (SELECT fov_key, channel, quantile_cont(value, 0.999) AS q FROM bil WHERE value <> 0 GROUP BY ALL),
       c AS (SELECT bil.*, least(value, q) AS v FROM bil JOIN q USING (fov_key, channel)),
       n AS (SELECT fov_key, "row", "col", (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS value FROM c WINDOW w AS (PARTITION BY fov_key, channel)),
       m AS (SELECT s.fov_key, i AS "row", j AS "col", m.cell_id FROM {RECIPE_SCALES} s CROSS JOIN (SELECT unnest(range(0, 8)) AS i) CROSS JOIN (SELECT unnest(range(0, 8)) AS j)
       JOIN v_image_mask m ON m.fov_key = s.fov_key AND m."row" = floor((i + 0.5) / scale) AND m."col" = floor((j + 0.5) / scale)),
       k AS (SELECT fov_key, cell_id, CAST(round_even(avg("row"), 0) AS INTEGER) - {CROP // 2} AS r0, CAST(round_even(avg("col"), 0) AS INTEGER) - {CROP // 2} AS c0 FROM m WHERE cell_id <> 0 GROUP BY ALL),
       g AS (SELECT k.fov_key, k.cell_id, pr, pc, coalesce(m.cell_id, 0) AS label, coalesce(n.value, 0) AS value FROM k CROSS JOIN {GRID}
       LEFT JOIN m ON m.fov_key = k.fov_key AND m."row" = r0 + pr AND m."col" = c0 + pc LEFT JOIN n ON n.fov_key = k.fov_key AND n."row" = r0 + pr AND n."col" = c0 + pc),
       d AS (SELECT a.fov_key, a.cell_id, a.pr, a.pc, a.label, a.value, CASE WHEN a.label = a.cell_id THEN min(sqrt((a.pr - o.pr) * (a.pr - o.pr) + (a.pc - o.pc) * (a.pc - o.pc))) ELSE 0.0 END AS v
       FROM g a JOIN g o ON a.fov_key = o.fov_key AND a.cell_id = o.cell_id AND o.label <> o.cell_id GROUP BY a.fov_key, a.cell_id, a.pr, a.pc, a.label, a.value),
       f AS (SELECT fov_key, cell_id, sum(value) FILTER (label = cell_id) AS signal, count(*) FILTER (label = cell_id) AS own, count(*) FILTER (label <> cell_id AND label <> 0) AS other, sum(v / mx) AS dist
       FROM (SELECT *, max(v) OVER (PARTITION BY fov_key, cell_id) AS mx FROM d) GROUP BY ALL),
       x AS (SELECT vec_id AS fov_key, dense_rank() OVER (ORDER BY 't' || label) - 1 AS m FROM embeddings),
       l AS (SELECT fov_key, cell_id, c, coalesce(signal, 0) * CAST((m * 3 + c * 5) % 7 - 3 AS DOUBLE) / 10 + (own * CAST(wa AS DOUBLE) + other * CAST(wb AS DOUBLE) + dist * CAST(wd AS DOUBLE)) / 36 AS l
       FROM f JOIN x USING (fov_key) CROSS JOIN (VALUES {_planes}) t(c, wa, wb, wd)),
       e AS (SELECT fov_key, cell_id, list(exp(l) ORDER BY c) AS ex FROM l GROUP BY ALL),
       p AS (SELECT fov_key, cell_id, list_transform(ex, lambda y: y / list_sum(ex)) AS probs FROM e),
       s AS (SELECT *, list_max(probs) AS top, 'k' || (list_position(probs, list_max(probs)) - 1) AS ct FROM p),
       z AS (SELECT fov_key, CASE WHEN count(*) >= 4 THEN quantile_cont(top, 0.25) - 0.2 * (quantile_cont(top, 0.75) - quantile_cont(top, 0.25)) END AS fence FROM s GROUP BY fov_key),
       r AS (SELECT s.*, coalesce(top < fence, false) AS abstained FROM s JOIN z USING (fov_key))
       SELECT i.fov_key, i.cell_id, CASE WHEN abstained OR ct IS NULL THEN 'Unknown' ELSE ct END AS predicted_ct, coalesce(ct, 'Unknown') AS predicted_ct_raw,
       coalesce(abstained, false) AS abstained, round(coalesce(probs[1], 0.0), 6) AS k0, round(coalesce(probs[2], 0.0), 6) AS k1, round(coalesce(probs[3], 0.0), 6) AS k2
       FROM (SELECT DISTINCT fov_key, cell_id FROM v_image_mask WHERE cell_id <> 0) i LEFT JOIN r ON i.fov_key = r.fov_key AND i.cell_id = r.cell_id""",
    views=("images", "image_mask"),
)
def predict_patches(spark, sf):
    """Some fields are resampled first; every labelled cell has a row, also those that shrinking lost."""
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("fov_key"), "label", F.concat(F.lit("t"), F.col("label")).alias("channel"))
    markers = settle(index_names(e, "channel"))
    aliases = markers.select(F.concat(F.lit("anti-"), "name").alias("alias"), F.col("name").alias("target"), F.col("idx").cast("bigint").alias("ord"))
    panel = e.select("fov_key", F.lit(0).alias("pos"), F.concat(F.lit("anti-"), "channel").alias("channel"))
    fovs = e.select("fov_key", F.when(F.col("label") < 3, 0.375).otherwise(0.5).alias("native_mpp"))
    tiles = b.image_tiles(spark, sf, 3, 5).withColumn("channel", F.concat(F.lit("anti-"), "channel"))
    out = predict_windows(tiles, b.mask_tiles(spark, sf, 3, 5), panel, fovs, markers, aliases, window_model, ["k0", "k1", "k2"], abstention_k=0.2, crop=CROP)
    return out.select("*", *[r6(F.get("probs", F.lit(i))).alias(f"k{i}") for i in range(3)]).drop("probs")
