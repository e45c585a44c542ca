"""Queries on weighting and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.operators import sampling as ops
from spatialframes.operators import splits
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6
from spatialframes.plans.registry import query, view

FOV = ["dataset_name", "fov_name"]

view(
    "wsqrt",
    """SELECT ct_label, n, sqrt(t / greatest(n, 50)) AS weight, t FROM (SELECT ct_label, count(*) AS n, sum(count(*)) OVER () AS t FROM v_labeled GROUP BY ct_label)""",
)


@query(
    "weights_sqrt",
    """SELECT cell_id, round(weight * (SELECT sum(n) / sum(n * weight) FROM v_wsqrt), 6) AS weight FROM v_labeled JOIN v_wsqrt USING (ct_label)""",
)
def weights_sqrt(spark, sf):
    return ops.with_weights(b.labeled(spark, sf), "ct_label", "sqrt", 50, normalize=True).select("cell_id", r6("weight").alias("weight"))


@query("weights_inverse", "SELECT cell_id, round(t / n, 6) AS weight FROM v_labeled JOIN v_wsqrt USING (ct_label)")
def weights_inverse(spark, sf):
    return ops.with_weights(b.labeled(spark, sf), "ct_label", "inverse").select("cell_id", r6("weight").alias("weight"))


@query(
    "cap_per_class",
    """SELECT cell_id, ct_label FROM v_labeled QUALIFY row_number() OVER (PARTITION BY ct_label ORDER BY md5('42|' || cell_id), cell_id) <= 1000""",
)
def cap_per_class(spark, sf):
    return ops.cap_per_class(b.labeled(spark, sf).select("cell_id", "ct_label"), "ct_label", 1000, ["cell_id"])


@query("cap_rows", "SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 2000")
def cap_rows(spark, sf):
    return ops.cap_rows(b.table(spark, sf, "orders").select("o_orderkey"), 2000, ["o_orderkey"])


@query(
    "class_pad",
    """, s AS (SELECT cell_id, ct_label FROM v_labeled ORDER BY md5('42|' || cell_id), cell_id LIMIT 1000)
       SELECT cell_id, ct_label FROM s UNION ALL SELECT min(cell_id), ct_label FROM v_labeled WHERE ct_label NOT IN (SELECT ct_label FROM s) GROUP BY ct_label""",
)
def class_pad(spark, sf):
    rows = b.labeled(spark, sf).select("cell_id", "ct_label")
    return ops.class_pad(ops.cap_rows(rows, 1000, ["cell_id"]), rows, "ct_label", "cell_id")


view(
    "line",
    """SELECT cell_id, ct_label, dataset_name, fov_name, CAST(c - w AS DOUBLE) AS lo, CAST(c AS DOUBLE) AS hi, CAST(t AS DOUBLE) AS total FROM
       (SELECT cell_id, ct_label, dataset_name, fov_name, w, sum(w) OVER (ORDER BY md5('42|' || cell_id || '|' || dataset_name || '|' || fov_name), cell_id ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER () AS t
       FROM (SELECT *, CAST(weight AS DECIMAL(28, 12)) AS w FROM v_labeled JOIN v_wsqrt USING (ct_label)))""",
)
view(
    "drawn",
    """SELECT draw, cell_id, dataset_name, fov_name FROM (SELECT i AS draw, CAST(CAST('0x' || substr(md5('42|draw|' || i), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE * (SELECT max(total) FROM v_line) AS x
       FROM range(0, 5000) r(i)) ASOF JOIN v_line ON x >= lo""",
)


@query("weighted_draw", "SELECT draw, cell_id, dataset_name, fov_name FROM v_drawn")
def weighted_draw(spark, sf):
    rows = ops.with_weights(b.labeled(spark, sf), "ct_label", "sqrt", 50)
    return ops.weighted_draw(rows, "weight", 5000, ["cell_id", *FOV])


GROUPED = """, f AS (SELECT dataset_name, fov_name, sum(n) OVER (ORDER BY md5('{seed}|' || dataset_name || '|' || fov_name), dataset_name, fov_name ROWS UNBOUNDED PRECEDING) - n AS start
       FROM (SELECT dataset_name, fov_name, count(*) AS n FROM {rows} GROUP BY ALL)),
       o AS (SELECT r.*, CAST(start + row_number() OVER (PARTITION BY r.dataset_name, r.fov_name ORDER BY md5('{seed}|' || {key}), {key}) - 1 AS BIGINT) AS "position"
       FROM {rows} r JOIN f ON r.dataset_name = f.dataset_name AND r.fov_name = f.fov_name) """


@query("fov_grouped_order", GROUPED.format(seed=43, rows="v_drawn", key="draw") + 'SELECT draw, cell_id, fov_name, "position" FROM o', views=("drawn",))
def fov_grouped_order(spark, sf):
    drawn = weighted_draw(spark, sf)
    return ops.fov_grouped_order(drawn, FOV, ["draw"], epoch=1).select("draw", "cell_id", "fov_name", "position")


@query(
    "fov_sequential",
    GROUPED.format(seed=42, rows="v_labeled", key="cell_id") + 'SELECT cell_id, fov_name, "position" FROM o WHERE "position" < 10000',
    views=("labeled",),
)
def fov_sequential(spark, sf):
    rows = b.labeled(spark, sf).select(*FOV, "cell_id")
    return ops.fov_sequential(rows, FOV, ["cell_id"], cap=10000).select("cell_id", "fov_name", "position")


def epoch_sql(pool: str, weight: str) -> str:
    """Draws of an epoch from the inner-train fields; ``pool`` filters the rows, ``weight`` is that of a class."""
    return (
        f""", ranked AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42|' || dataset_name || '|' || fov_name), dataset_name, fov_name) AS rk FROM v_fovs),
       inner_train AS (SELECT dataset_name, fov_name FROM ranked WHERE rk > least(greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT)), n - 1)),
       pool AS (SELECT l.* FROM v_labeled l SEMI JOIN inner_train USING (dataset_name, fov_name) {pool}),
       w AS (SELECT ct_label, CAST({weight} AS DECIMAL(28, 12)) AS w FROM pool GROUP BY ct_label),
       line AS (SELECT cell_id, dataset_name, fov_name, w, sum(w) OVER (ORDER BY md5('42|' || cell_id || '|' || dataset_name || '|' || fov_name), cell_id ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER () AS t FROM pool JOIN w USING (ct_label)),
       ends AS (SELECT cell_id, dataset_name, fov_name, CAST(c - w AS DOUBLE) AS lo, CAST(t AS DOUBLE) AS total FROM line),
       d AS (SELECT draw, cell_id, dataset_name, fov_name FROM (SELECT i AS draw, CAST(CAST('0x' || substr(md5('42|draw|' || i), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE * (SELECT max(total) FROM ends) AS x
       FROM range(0, 3000) r(i) WHERE i < (SELECT count(*) FROM pool)) ASOF JOIN ends ON x >= lo)"""
        + GROUPED.format(seed=42, rows="d", key="draw")
        + 'SELECT draw, cell_id, "position" FROM o'
    )


def epoch(spark, sf, scheme, cap=None):
    cells = b.labeled(spark, sf)
    inner = splits.inner_val(splits.fov_frame(cells), 0.1).where("split = 'train'")
    out = ops.balanced_epoch(cells, inner, "ct_label", ["cell_id"], n=3000, scheme=scheme, cap=cap)
    return out.select("draw", "cell_id", "position")


CAPPED = "QUALIFY row_number() OVER (PARTITION BY ct_label ORDER BY md5('42|' || cell_id), cell_id) <= 1500"


@query("balanced_epoch", epoch_sql(CAPPED, "sum(count(*)) OVER () / count(*)"), views=("labeled", "fovs"))
def balanced_epoch(spark, sf):
    return epoch(spark, sf, "equal", 1500)


@query("balanced_epoch_sqrt", epoch_sql("", "sqrt(sum(count(*)) OVER () / greatest(count(*), 1000))"), views=("labeled", "fovs"))
def balanced_epoch_sqrt(spark, sf):
    return epoch(spark, sf, "sqrt")


@query("balanced_epoch_none", epoch_sql("", "1"), views=("labeled", "fovs"))
def balanced_epoch_none(spark, sf):
    return epoch(spark, sf, "none")


RANKED_CHANNELS = """(SELECT fov_key, cell_id, marker, count(*) OVER (PARTITION BY fov_key, cell_id) AS valid, row_number() OVER (PARTITION BY fov_key, cell_id
       ORDER BY md5('42|' || fov_key || '|' || cell_id || '|' || marker), marker) AS rk FROM v_channel_features)"""


@query(
    "drop_channels",
    f"SELECT fov_key, cell_id, marker FROM {RANKED_CHANNELS} WHERE rk > CASE WHEN valid > 3 THEN least(3, floor(valid * 0.3::DOUBLE)) ELSE 0 END",
    views=("channel_features",),
)
def drop_channels(spark, sf):
    from spatialframes.plans.features import channel_features

    return ops.drop_channels(channel_features(spark, sf).select("fov_key", "cell_id", "marker"), ["fov_key", "cell_id"], "marker")


@query(
    "mask_markers",
    """, lit AS (SELECT fov_key, cell_id, count(*) AS area FROM (SELECT DISTINCT fov_key, cell_id, "row", "col" FROM v_pixels JOIN v_mask USING (fov_key, "row", "col") WHERE cell_id <> 0 AND value <> 0) GROUP BY ALL),
       t AS (SELECT fov_key, cell_id, channel AS marker, sum(value) / coalesce(any_value(area), 1) AS target FROM v_pixels JOIN v_mask USING (fov_key, "row", "col") LEFT JOIN lit USING (fov_key, cell_id) WHERE cell_id <> 0 GROUP BY ALL)
       SELECT fov_key, cell_id, marker, valid > 2 AND rk <= least(greatest(1, floor(valid * 0.5::DOUBLE)), valid - 2) AS masked, round(target, 6) AS target
       FROM """
    + RANKED_CHANNELS
    + " JOIN t USING (fov_key, cell_id, marker)",
    views=("pixels", "mask", "channel_features"),
)
def mask_markers(spark, sf):
    target = ops.mask_targets(b.pixels(spark, sf), b.mask(spark, sf))
    out = ops.mask_markers(target, ["fov_key", "cell_id"], "channel", ratio=0.5, keep=2)
    return out.select("fov_key", "cell_id", F.col("channel").alias("marker"), "masked", r6("target").alias("target"))
