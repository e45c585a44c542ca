"""Queries on signal conditioning."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spatialframes.operators import signal as ops
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6
from spatialframes.plans.registry import query, view
from spatialframes.session import settle

PIXEL = ["fov_key", "channel", "row", "col"]


def rounded(df):
    return df.select(*PIXEL, r6("value").alias("value"))


view(
    "clip",
    """SELECT p.fov_key, p.channel, p."row", p."col", least(p.value, q) AS value FROM v_pixels p
       LEFT JOIN (SELECT fov_key, channel, quantile_cont(value, 0.999) AS q FROM v_pixels WHERE value <> 0 GROUP BY ALL)
       USING (fov_key, channel)""",
)


@query("clip_percentile", """SELECT fov_key, channel, "row", "col", round(value, 6) AS value FROM v_clip""")
def clip_percentile(spark, sf):
    return rounded(ops.clip_percentile(b.pixels(spark, sf), 99.9))


MIN_MAX = """SELECT fov_key, channel, "row", "col", round((value - mn) / CASE WHEN mx = mn THEN 1.0 ELSE mx - mn END, 6) + 0 AS value
       FROM (SELECT *, min(value) OVER w AS mn, max(value) OVER w AS mx FROM {source} WINDOW w AS (PARTITION BY fov_key, channel))"""


@query("min_max", MIN_MAX.format(source="v_pixels"))
def min_max(spark, sf):
    return rounded(ops.min_max_normalize(b.pixels(spark, sf)))


@query("default_config", MIN_MAX.format(source="v_clip"))
def default_config(spark, sf):
    return rounded(ops.apply_config(b.pixels(spark, sf), ops.DEFAULT_CONFIG))


CHAIN = [
    {"op": "background_subtract", "value": 5},
    {"op": "log1p"},
    {"op": "channel_weight", "weights": {"click": 0.25, "error": 2.0}},
    {"op": "channel_drop", "names": ["signup"]},
    {"op": "gamma", "g": 0.5},
    {"op": "min_max_normalize"},
]

CHAIN_SQL = """, a AS (SELECT fov_key, channel, "row", "col",
       CASE channel WHEN 'click' THEN 0.25 WHEN 'error' THEN 2.0 WHEN 'signup' THEN 0.0 ELSE 1.0 END * ln(1 + greatest(value - 5, 0)) AS v FROM v_pixels),
       m AS (SELECT fov_key, channel, CASE WHEN max(v) = 0 THEN 1.0 ELSE max(v) END AS mx FROM a GROUP BY ALL),
       g AS (SELECT fov_key, channel, "row", "col", pow(least(greatest(v / mx, 0), 1), 0.5) * mx AS value FROM a JOIN m USING (fov_key, channel))
       """


@query("signal_chain", CHAIN_SQL + MIN_MAX.format(source="g"), views=("pixels",))
def signal_chain(spark, sf):
    return rounded(ops.make_preprocessor(CHAIN)(b.pixels(spark, sf)))


@query("custom_hook", CHAIN_SQL + MIN_MAX.format(source="g"), views=("pixels",))
def custom_hook(spark, sf):
    return rounded(ops.run_hook(b.pixels(spark, sf), ops.make_preprocessor(CHAIN)))


@query(
    "background_per_channel",
    """SELECT p.fov_key, p.channel, p."row", p."col", round(CASE WHEN q IS NULL THEN value ELSE greatest(value - q, 0.0) END, 6) AS value
       FROM v_pixels p LEFT JOIN (SELECT fov_key, channel, quantile_cont(value, 0.25) AS q FROM v_pixels
       WHERE value <> 0 AND channel IN ('click', 'view') GROUP BY ALL) USING (fov_key, channel)""",
)
def background_per_channel(spark, sf):
    return rounded(ops.background_subtract_per_channel(b.pixels(spark, sf), 25.0, ["click", "view"]))


@query(
    "gamma",
    """, m AS (SELECT fov_key, channel, CASE WHEN max(value) = 0 THEN 1.0 ELSE max(value) END AS mx FROM v_pixels GROUP BY ALL)
       SELECT fov_key, channel, "row", "col", round(pow(least(greatest(value / mx, 0), 1), 0.7) * mx, 6) AS value
       FROM v_pixels JOIN m USING (fov_key, channel)""",
)
def gamma(spark, sf):
    return rounded(ops.gamma(b.pixels(spark, sf), 0.7))


@query(
    "hot_pixel",
    """, med AS (SELECT fov_key, channel, quantile_cont(value, 0.5) AS m FROM v_pixels GROUP BY ALL),
       dev AS (SELECT fov_key, channel, any_value(m) AS m, quantile_cont(abs(value - m), 0.5) AS d FROM v_pixels JOIN med USING (fov_key, channel) GROUP BY ALL)
       SELECT fov_key, channel, "row", "col", round(least(value, m + 2 * 1.4826 * CASE WHEN d = 0 THEN 1.0 ELSE d END), 6) AS value
       FROM v_pixels JOIN dev USING (fov_key, channel)""",
)
def hot_pixel(spark, sf):
    return rounded(ops.hot_pixel_removal(b.pixels(spark, sf), z=2.0))


@query(
    "channel_weight",
    """SELECT fov_key, channel, "row", "col", round(CASE channel WHEN 'view' THEN value * 0.25 WHEN 'error' THEN 0.0 ELSE value END, 6) AS value
       FROM v_pixels""",
)
def channel_weight(spark, sf):
    out = ops.channel_weight(b.pixels(spark, sf), {"view": 0.25})
    return rounded(ops.channel_drop(out, ["error"]))


REFLECT = "CASE WHEN (({i}) + 160) % 16 < 8 THEN (({i}) + 160) % 16 ELSE 15 - (({i}) + 160) % 16 END"


MEDIAN_SQL = f"""SELECT t.fov_key, t.channel, t."row", t."col", round(list_sort(list(s.value))[5], 6) + 0 AS value
       FROM v_images t CROSS JOIN (SELECT unnest(range(-1, 2)) AS dr) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dc)
       JOIN v_images s ON s.fov_key = t.fov_key AND s."row" = {REFLECT.format(i='t."row" + dr')} AND s."col" = {REFLECT.format(i='t."col" + dc')}
       GROUP BY ALL"""


@query("denoise_median", MEDIAN_SQL)
def denoise_median(spark, sf):
    return rounded(ops.denoise(b.images(spark, sf), "median", 3))


_weights = [math.exp(-0.5 * (d / 1.5) ** 2) for d in range(-6, 7)]
_kernel = ", ".join(f"({d}, {w / sum(_weights)!r})" for d, w in zip(range(-6, 7), _weights))


GAUSSIAN_SQL = f""", kernel AS (SELECT * FROM (VALUES {_kernel}) k(d, w)),
       p1 AS (SELECT t.fov_key, t.channel, t."row", t."col", sum(CAST(w AS DOUBLE) * s.value) AS value FROM v_images t CROSS JOIN kernel
       JOIN v_images s ON s.fov_key = t.fov_key AND s."col" = t."col" AND s."row" = {REFLECT.format(i='t."row" + d')} GROUP BY ALL)
       SELECT t.fov_key, t.channel, t."row", t."col", round(sum(CAST(w AS DOUBLE) * s.value), 6) + 0 AS value FROM p1 t CROSS JOIN kernel
       JOIN p1 s ON s.fov_key = t.fov_key AND s."row" = t."row" AND s."col" = {REFLECT.format(i='t."col" + d')} GROUP BY ALL"""


@query("denoise_gaussian", GAUSSIAN_SQL)
def denoise_gaussian(spark, sf):
    return rounded(ops.denoise(b.images(spark, sf), "gaussian", 3))


@query(
    "value_contract",
    """SELECT 'out_of_range' AS "check", CAST(fov_key AS VARCHAR) AS "key", printf('%.3f..%.3f', min(value), max(value)) AS detail
       FROM v_pixels GROUP BY fov_key HAVING min(value) < -1e-6 OR max(value) > 200 + 1e-6""",
)
def value_contract(spark, sf):
    return ops.value_contract(b.pixels(spark, sf), high=200.0)


# the user model of the query below: fixed weights from five marker means to three classes
WEIGHTS = [[float((m * 3 + c * 5) % 7 - 3) for c in range(3)] for m in range(5)]


def panel_model():
    import numpy as np

    weights = np.array(WEIGHTS)
    return lambda x: x @ weights


_weights_sql = ", ".join(f"({m}, {c}, {w})" for m, row in enumerate(WEIGHTS) for c, w in enumerate(row))


@query(
    "predict_cells",
    f""", n AS (SELECT fov_key, channel, "row", "col", (value - mn) / CASE WHEN mx = mn THEN 1.0 ELSE mx - mn END AS v
       FROM (SELECT *, min(value) OVER w AS mn, max(value) OVER w AS mx FROM v_clip WINDOW w AS (PARTITION BY fov_key, channel)) WHERE mx <> 0),
       f AS (SELECT fov_key, cell_id, channel, avg(v) AS x FROM n JOIN v_mask USING (fov_key, "row", "col") WHERE cell_id <> 0 GROUP BY ALL),
       w AS (SELECT * FROM (VALUES {_weights_sql}) t(m, c, w)), names AS (SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS m FROM (SELECT DISTINCT event_type AS channel FROM events)),
       l AS (SELECT fov_key, cell_id, c, sum(x * CAST(w AS DOUBLE)) AS l FROM f JOIN names USING (channel) JOIN w USING (m) GROUP BY ALL),
       e AS (SELECT fov_key, cell_id, list(exp(l) ORDER BY c) AS ex FROM l GROUP BY ALL),
       p AS (SELECT fov_key, cell_id, list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM e),
       s AS (SELECT *, list_max(probs) AS top, 'k' || (list_position(probs, list_max(probs)) - 1) AS ct FROM p),
       q AS (SELECT fov_key, CASE WHEN count(*) >= 4 THEN quantile_cont(top, 0.25) - 0.2 * (quantile_cont(top, 0.75) - quantile_cont(top, 0.25)) END AS fence FROM s GROUP BY fov_key),
       r AS (SELECT s.*, coalesce(top < fence, false) AS abstained FROM s JOIN q USING (fov_key))
       SELECT i.fov_key, i.cell_id, CASE WHEN abstained OR ct IS NULL THEN 'Unknown' ELSE ct END AS predicted_ct, coalesce(ct, 'Unknown') AS predicted_ct_raw,
       coalesce(abstained, false) AS abstained, round(coalesce(probs[1], 0.0), 6) AS k0, round(coalesce(probs[2], 0.0), 6) AS k1, round(coalesce(probs[3], 0.0), 6) AS k2
       FROM (SELECT DISTINCT fov_key, cell_id FROM v_mask WHERE cell_id <> 0) i LEFT JOIN r ON i.fov_key = r.fov_key AND i.cell_id = r.cell_id""",
)
def predict_cells(spark, sf):
    from spatialframes.functions.names import index_names
    from spatialframes.operators.phenotype import predict

    p = b.pixels(spark, sf)
    events = b.table(spark, sf, "events")
    markers = settle(index_names(events, "event_type"))
    panel = events.select(F.col("user_id").alias("fov_key"), F.col("event_type").alias("channel")).distinct()
    panel = panel.join(markers, F.col("channel") == F.col("name")).select("fov_key", F.col("idx").alias("pos"), F.lower("channel").alias("channel"))
    aliases = markers.select(F.concat(F.lit("anti-"), "name").alias("alias"), F.col("name").alias("target"), F.col("idx").cast("bigint").alias("ord"))
    fovs = panel.select("fov_key").distinct().withColumn("native_mpp", F.lit(0.5))
    out = predict(p, b.mask(spark, sf), panel, fovs, markers, aliases, panel_model, ["k0", "k1", "k2"], abstention_k=0.2)
    return out.select("*", *[r6(F.get("probs", F.lit(i))).alias(f"k{i}") for i in range(3)]).drop("probs")
