"""Queries on per-cell features."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.functions.names import index_names
from spatialframes.operators import features as ops
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6, spread_sql
from spatialframes.plans.registry import query, view
from spatialframes.session import settle


@query(
    "cell_means",
    """SELECT fov_key, cell_id, channel, round(avg(value), 6) AS mean_value, round(sum(value), 6) AS sum_value,
       count(*) AS n_pixels FROM v_pixels JOIN v_mask USING (fov_key, "row", "col") WHERE cell_id <> 0
       GROUP BY ALL""",
)
def cell_means(spark, sf):
    out = ops.cell_means(b.pixels(spark, sf), b.mask(spark, sf))
    return out.select("fov_key", "cell_id", "channel", r6("mean_value").alias("mean_value"), r6("sum_value").alias("sum_value"), "n_pixels")


@query(
    "cell_means_of_tiles",
    """SELECT fov_key, cell_id, channel, round(avg(value), 6) + 0 AS mean_value, round(sum(value), 6) + 0 AS sum_value,
       count(*) AS n_pixels FROM v_images JOIN v_image_mask USING (fov_key, "row", "col") WHERE cell_id <> 0
       GROUP BY ALL""",
)
def cell_means_of_tiles(spark, sf):
    from spatialframes.sources.tiles import pixels_to_tiles

    tiles = pixels_to_tiles(b.images(spark, sf), 4, 4)
    labels = b.image_mask(spark, sf).select("fov_key", F.lit("mask").alias("channel"), "row", "col", F.col("cell_id").alias("value"))
    labels = pixels_to_tiles(labels, 4, 4).withColumnRenamed("values", "labels")
    out = ops.cell_means_of_tiles(tiles, labels)
    return out.select("fov_key", "cell_id", "channel", r6("mean_value").alias("mean_value"), r6("sum_value").alias("sum_value"), "n_pixels")


@query(
    "tile_roundtrip",
    """SELECT fov_key, channel, "row", "col", value FROM v_images""",
)
def tile_roundtrip(spark, sf):
    from spatialframes.sources.tiles import pixels_to_tiles, tiles_to_pixels

    return tiles_to_pixels(pixels_to_tiles(b.images(spark, sf), 3, 5))


@query(
    "centroids",
    """SELECT fov_key, cell_id, round(avg("row"), 6) AS c_row, round(avg("col"), 6) AS c_col, count(*) AS area
       FROM v_mask WHERE cell_id <> 0 GROUP BY ALL""",
)
def centroids(spark, sf):
    out = ops.centroids(b.mask(spark, sf))
    return out.select("fov_key", "cell_id", r6("c_row").alias("c_row"), r6("c_col").alias("c_col"), "area")


@query(
    "label_means",
    """SELECT fov_key, cell_id, round(coalesce(avg(value) FILTER (channel IN ('click', 'view')), 0), 6) AS score
       FROM v_mask LEFT JOIN v_pixels USING (fov_key, "row", "col") WHERE cell_id <> 0 GROUP BY ALL""",
)
def label_means(spark, sf):
    score = b.pixels(spark, sf).where(F.col("channel").isin("click", "view"))
    out = ops.label_means(b.mask(spark, sf), score)
    return out.select("fov_key", "cell_id", r6("score").alias("score"))


@query(
    "view_average",
    """SELECT cell_id, marker, round(avg(value), 6) AS mean_value, count(*) AS n_views FROM v_readings GROUP BY ALL""",
)
def view_average(spark, sf):
    out = ops.view_average(b.readings(spark, sf), ["cell_id", "marker"])
    return out.select("cell_id", "marker", r6("mean_value").alias("mean_value"), "n_views")


view(
    "fov_factor",
    """SELECT channel, avg(q) AS factor, count(*) AS n_fovs FROM (
       SELECT fov_key, channel, quantile_cont(value, 0.999) AS q FROM v_pixels
       WHERE value > 0 AND fov_key IN (SELECT fov_key FROM (SELECT DISTINCT fov_key FROM v_pixels)
       ORDER BY md5('42|' || fov_key), fov_key LIMIT 10) GROUP BY ALL) WHERE q > 0 GROUP BY channel""",
)


@query(
    "cross_fov_norm",
    "SELECT channel, round(factor, 6) AS factor, n_fovs FROM v_fov_factor",
)
def cross_fov_norm(spark, sf):
    out = ops.cross_fov_norm(b.pixels(spark, sf))
    return out.select("channel", r6("factor").alias("factor"), "n_fovs")


@query(
    "apply_fov_norm",
    """, own AS (SELECT fov_key, channel, quantile_cont(value, 0.999) AS q FROM v_pixels WHERE value > 0 GROUP BY ALL),
       d AS (SELECT p.*, coalesce(CASE WHEN channel <> 'error' THEN factor END, q) AS divisor FROM v_pixels p
       LEFT JOIN v_fov_factor USING (channel) LEFT JOIN own USING (fov_key, channel))
       SELECT fov_key, channel, "row", "col", round(CASE WHEN divisor IS NULL THEN value
       ELSE greatest(least(value / divisor, 1.0), 0.0) END, 6) AS value FROM d""",
)
def apply_fov_norm(spark, sf):
    p = b.pixels(spark, sf)
    factors = ops.cross_fov_norm(p).where(F.col("channel") != "error")  # one channel takes the fallback
    return ops.apply_fov_norm(p, factors).select("fov_key", "channel", "row", "col", r6("value").alias("value"))


view(
    "moments",
    """SELECT domain, marker, coalesce(n, 0) AS n, coalesce(s / n, 0.0) AS mean,
       CASE WHEN n IS NULL THEN 1.0 ELSE greatest(sqrt(greatest(s2 / n - (s / n) * (s / n), 0.0)), 1e-6) END AS std
       FROM (SELECT DISTINCT domain FROM v_readings) CROSS JOIN (SELECT DISTINCT marker FROM v_readings)
       LEFT JOIN (SELECT domain, marker, count(*) AS n, sum(value) AS s, sum(value * value) AS s2
       FROM v_readings GROUP BY ALL) USING (domain, marker)""",
)


@query(
    "domain_moments",
    "SELECT domain, marker, n, round(mean, 6) AS mean, round(std, 6) AS std FROM v_moments",
)
def domain_moments(spark, sf):
    out = ops.domain_moments(b.readings(spark, sf))
    return out.select("domain", "marker", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "apply_domain_norm",
    """SELECT domain, marker, cell_id, round((value - mean) / std, 6) + 0 AS value
       FROM v_readings JOIN v_moments USING (domain, marker)""",
)
def apply_domain_norm(spark, sf):
    r = b.readings(spark, sf)
    out = ops.apply_domain_norm(r, ops.domain_moments(r))
    return out.select("domain", "marker", "cell_id", r6("value").alias("value"))


@query(
    "apply_domain_norm_unseen",
    """SELECT domain, marker, cell_id, round((value - coalesce(mean, 0)) / coalesce(std, 1), 6) + 0 AS value
       FROM v_readings LEFT JOIN (SELECT * FROM v_moments WHERE domain <> (SELECT min(domain) FROM v_readings)) USING (domain, marker)""",
)
def apply_domain_norm_unseen(spark, sf):
    """Fitted without the first domain, applied to all."""
    r = b.readings(spark, sf)
    first = r.agg(F.min("domain").alias("_first"))
    fitted = r.join(first, F.col("domain") != F.col("_first")).drop("_first")
    out = ops.apply_domain_norm(r, ops.domain_moments(fitted))
    return out.select("domain", "marker", "cell_id", r6("value").alias("value"))


view("cell_features", "SELECT cell_id, marker, avg(value) AS mean_value FROM v_readings GROUP BY ALL")


def cell_features(spark, sf):
    return b.readings(spark, sf).groupBy("cell_id", "marker").agg(F.avg("value").alias("mean_value"))


@query(
    "zscore_features",
    """SELECT cell_id, marker, round((mean_value - m) / s / 255.0, 6) + 0 AS scaled,
       round(mean_value / 255.0, 6) AS plain
       FROM v_cell_features JOIN (SELECT marker, avg(mean_value) AS m,
       CASE WHEN stddev_pop(mean_value) = 0 THEN 1.0 ELSE stddev_pop(mean_value) END AS s
       FROM v_cell_features GROUP BY marker) USING (marker)""",
)
def zscore_features(spark, sf):
    f = cell_features(spark, sf)
    out = ops.zscore_features(f, f)
    out = ops.zscore_features(out.withColumnRenamed("scaled", "z"), f, z=False)
    return out.select("cell_id", "marker", r6("z").alias("scaled"), r6("scaled").alias("plain"))


@query(
    "zscore_features_unseen",
    """SELECT cell_id, marker, round((mean_value - coalesce(m, 0)) / coalesce(s, 1) / 255.0, 6) + 0 AS scaled
       FROM v_cell_features LEFT JOIN (SELECT marker, avg(mean_value) AS m,
       CASE WHEN stddev_pop(mean_value) = 0 THEN 1.0 ELSE stddev_pop(mean_value) END AS s
       FROM v_cell_features WHERE marker <> (SELECT min(marker) FROM v_cell_features) GROUP BY marker) USING (marker)""",
)
def zscore_features_unseen(spark, sf):
    """Fitted without the first marker, applied to all."""
    f = cell_features(spark, sf)
    first = f.agg(F.min("marker").alias("_first"))
    train = f.join(first, F.col("marker") != F.col("_first")).drop("_first")
    return ops.zscore_features(f, train).select("cell_id", "marker", r6("scaled").alias("scaled"))


view(
    "channel_features",
    """SELECT fov_key, cell_id, channel AS marker, avg(value) AS mean_value, count(*) AS n_pixels
       FROM v_pixels JOIN v_mask USING (fov_key, "row", "col") WHERE cell_id <> 0 GROUP BY ALL""",
)


def channel_features(spark, sf):
    out = ops.cell_means(b.pixels(spark, sf), b.mask(spark, sf))
    return out.withColumnRenamed("channel", "marker")


def channel_vocab(spark, sf):
    return index_names(b.table(spark, sf, "events"), "event_type")


@query(
    "feature_matrix",
    """, vocab AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT DISTINCT event_type AS name FROM events)),
       panel AS (SELECT DISTINCT fov_key, channel AS marker FROM v_pixels),
       cell AS (SELECT fov_key, cell_id, count(*) AS area FROM v_mask WHERE cell_id <> 0 GROUP BY ALL),
       g AS (SELECT c.fov_key, c.cell_id, c.area, v.idx, CASE WHEN p.marker IS NULL THEN -1.0 ELSE coalesce(f.mean_value, 0.0) END AS value
       FROM cell c CROSS JOIN vocab v LEFT JOIN panel p ON p.fov_key = c.fov_key AND p.marker = v.name
       LEFT JOIN v_channel_features f ON f.fov_key = c.fov_key AND f.cell_id = c.cell_id AND f.marker = v.name)
       """
    + spread_sql("fov_key, cell_id", "features", """(SELECT fov_key, cell_id, list_append(list(round(value, 6) ORDER BY idx), CAST(max(area) AS DOUBLE)) AS features
       FROM g GROUP BY fov_key, cell_id)"""),
)
def feature_matrix(spark, sf):
    feats = channel_features(spark, sf).join(ops.cell_areas(b.mask(spark, sf)), ["fov_key", "cell_id"])
    panel = b.pixels(spark, sf).select("fov_key", F.col("channel").alias("marker")).distinct()
    vocab = settle(channel_vocab(spark, sf))
    out = ops.feature_matrix(feats, vocab, vocab.count(), panel, missing=-1.0, size="area")
    return b.spread(out, "features", ["fov_key", "cell_id"])


@query(
    "absent_fill",
    """, vocab AS (SELECT DISTINCT event_type AS name FROM events),
       panel AS (SELECT DISTINCT fov_key, channel AS marker FROM v_pixels),
       cell AS (SELECT DISTINCT fov_key, cell_id FROM v_mask WHERE cell_id <> 0)
       SELECT c.fov_key, c.cell_id, v.name AS marker,
       round(CASE WHEN p.marker IS NULL THEN NULL ELSE coalesce(f.mean_value, 0.0) END, 6) AS mean_value
       FROM cell c CROSS JOIN vocab v LEFT JOIN panel p ON p.fov_key = c.fov_key AND p.marker = v.name
       LEFT JOIN v_channel_features f ON f.fov_key = c.fov_key AND f.cell_id = c.cell_id AND f.marker = v.name""",
)
def absent_fill(spark, sf):
    panel = b.pixels(spark, sf).select("fov_key", F.col("channel").alias("marker"))
    cells = ops.foreground(b.mask(spark, sf)).select("fov_key", "cell_id").distinct()
    out = ops.fill_absent(channel_features(spark, sf), cells, panel, channel_vocab(spark, sf), None)
    return out.withColumn("mean_value", r6("mean_value"))


@query(
    "embedding_align",
    """, mean AS (SELECT 'm' || label AS name, pos, avg(CAST(v AS DOUBLE)) AS v FROM v_image_pos WHERE label < 7 GROUP BY ALL),
       saved AS (SELECT name, list(round(v, 6) + 0 ORDER BY pos) AS vec FROM mean GROUP BY name),
       vocab AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT 'm' || label AS name FROM embeddings))
       """
    + spread_sql("name, idx", "vec", "(SELECT name, idx, coalesce(vec, list_transform(range(64), lambda e: 0.0::DOUBLE)) AS vec FROM vocab LEFT JOIN saved USING (name))"),
)
def embedding_align(spark, sf):
    """The registry has every label, vectors were saved (as the mean of their rows) for the first seven."""
    e = b.table(spark, sf, "embeddings").withColumn("marker", F.concat(F.lit("m"), "label"))
    means = e.where("label < 7").select("marker", F.posexplode("embedding").alias("pos", "v"))
    means = means.groupBy("marker", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    packed = means.groupBy("marker").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("p"))
    saved = packed.select("marker", F.transform("p", lambda x: x["v"]).alias("vec"))
    out = ops.embedding_align(index_names(e, "marker"), saved, 64)
    return b.spread(out, "vec", ["name", "idx"])


@query(
    "scatter_dense",
    """, vocab AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT DISTINCT marker AS name FROM v_readings)),
       cell AS (SELECT DISTINCT cell_id FROM v_readings)
       SELECT c.cell_id, CAST(v.idx AS INTEGER) AS pos, round(coalesce(f.mean_value, 0.0), 6) AS value FROM cell c CROSS JOIN vocab v
       LEFT JOIN v_cell_features f ON f.cell_id = c.cell_id AND f.marker = v.name""",
)
def scatter_dense(spark, sf):
    f = cell_features(spark, sf)
    vocab = settle(index_names(f, "marker"))
    out = ops.scatter_dense(f, vocab, vocab.count(), ["cell_id"], "mean_value")
    return b.spread(out, "dense", ["cell_id"])


@query(
    "known_labels",
    """SELECT cell_id, ct_label FROM v_labeled WHERE ct_label IN (SELECT DISTINCT o_orderpriority FROM orders)""",
)
def known_labels(spark, sf):
    vocab = b.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name")).distinct()
    return ops.known_labels(b.labeled(spark, sf), "ct_label", vocab).select("cell_id", "ct_label")


@query(
    "seen_classes",
    """SELECT cell_id, fov_name, ct_label FROM v_labeled WHERE domain <> 'BUILDING' AND ct_label IN
       (SELECT ct_label FROM v_labeled WHERE domain = 'BUILDING')""",
)
def seen_classes(spark, sf):
    rows = b.labeled(spark, sf)
    out = ops.seen_classes(rows.where("domain <> 'BUILDING'"), rows.where("domain = 'BUILDING'"), "ct_label")
    return out.select("cell_id", "fov_name", "ct_label")


@query(
    "keep_skip",
    """SELECT cell_id, fov_name, 'keep' AS rule FROM v_labeled WHERE fov_name IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
       UNION ALL SELECT cell_id, fov_name, 'skip' FROM v_labeled WHERE fov_name NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def keep_skip(spark, sf):
    listed = b.table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("fov_name"))
    rows = b.labeled(spark, sf).select("cell_id", "fov_name")
    kept = ops.keep_skip(rows, "fov_name", keep=listed).withColumn("rule", F.lit("keep"))
    return kept.unionByName(ops.keep_skip(rows, "fov_name", skip=listed).withColumn("rule", F.lit("skip")))
