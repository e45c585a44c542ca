"""Domain tables read from the driver tables, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialframes.plans.registry import view


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(column: Column | str) -> Column:
    """Rounded to six places; adding zero turns a negative zero into zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + F.lit(0.0)


def spread(df: DataFrame, column: str, keys: list[str], value: Column | None = None) -> DataFrame:
    """An array column as rows ``(keys..., pos, value)``."""
    out = df.select(*keys, F.posexplode(column).alias("pos", "value"))
    return out.withColumn("value", r6("value") if value is None else value)


def spread_sql(keys: str, column: str, source: str) -> str:
    return f"SELECT {keys}, CAST(unnest(range(0, len({column}))) AS INTEGER) AS pos, unnest({column}) AS value FROM {source}"


# --- pixels and masks: one event is one pixel -------------------------------------------------

view(
    "pixels",
    """SELECT user_id AS fov_key, event_type AS channel, CAST(event_id // 100 AS INTEGER) AS "row",
       CAST(event_id % 100 AS INTEGER) AS "col", CASE WHEN value < 2.5 THEN 0.0 ELSE value END AS value
       FROM events""",
)


def pixels(spark, sf) -> DataFrame:
    """Events as pixels; readings under the detector floor of 2.5 are zero."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("fov_key"),
        F.col("event_type").alias("channel"),
        F.floor(F.col("event_id") / 100).cast("int").alias("row"),
        (F.col("event_id") % 100).cast("int").alias("col"),
        F.when(F.col("value") < 2.5, 0.0).otherwise(F.col("value")).alias("value"),
    )


view(
    "mask",
    """SELECT user_id AS fov_key, CAST(event_id // 100 AS INTEGER) AS "row",
       CAST(event_id % 100 AS INTEGER) AS "col",
       CAST(json_extract_string(props, '$.k') AS BIGINT) // 15 AS cell_id FROM events""",
)


def mask(spark, sf) -> DataFrame:
    """Label of each pixel from the event properties; 0 is background."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.col("user_id").alias("fov_key"),
        F.floor(F.col("event_id") / 100).cast("int").alias("row"),
        (F.col("event_id") % 100).cast("int").alias("col"),
        F.floor(k / 15).alias("cell_id"),
    )


# --- small dense images: one embedding is one 8 x 8 image -------------------------------------

view(
    "image_pos",
    """SELECT vec_id, label, unnest(range(0, len(embedding))) AS pos, unnest(embedding) AS v FROM embeddings""",
)
view(
    "images",
    """SELECT vec_id AS fov_key, 't' || label AS channel, CAST(pos // 8 AS INTEGER) AS "row",
       CAST(pos % 8 AS INTEGER) AS "col", CAST(v AS DOUBLE) AS value FROM v_image_pos""",
)
view(
    "image_mask",
    """SELECT fov_key, "row", "col", CASE WHEN value > 0 THEN 1 + 2 * ("row" // 4) + ("col" // 4) ELSE 0 END AS cell_id
       FROM (SELECT fov_key, CAST("row" AS BIGINT) AS "row", CAST("col" AS BIGINT) AS "col", value FROM v_images)""",
)


def images(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    e = e.select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    return e.select(
        F.col("vec_id").alias("fov_key"),
        F.concat(F.lit("t"), F.col("label")).alias("channel"),
        F.floor(F.col("pos") / 8).cast("int").alias("row"),
        (F.col("pos") % 8).cast("int").alias("col"),
        F.col("v").cast("double").alias("value"),
    )


def image_mask(spark, sf) -> DataFrame:
    """Positive pixels belong to the cell of their quadrant."""
    quadrant = 1 + 2 * F.floor(F.col("row") / 4) + F.floor(F.col("col") / 4)
    return images(spark, sf).select(
        "fov_key", "row", "col", F.when(F.col("value") > 0, quadrant).otherwise(0).cast("bigint").alias("cell_id")
    )


# --- cells, annotations and predictions from embeddings ----------------------------------------

view(
    "points",
    """SELECT vec_id, label, 'f' || CAST(embedding[3] > 0 AS INTEGER) || CAST(embedding[4] > 0 AS INTEGER) AS fov_key,
       100 * CAST(embedding[1] AS DOUBLE) AS x, 100 * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings""",
)
view("cells", "SELECT fov_key, vec_id AS cell_id, x AS c_row, y AS c_col FROM v_points WHERE label < 5")
view(
    "marks",
    """SELECT fov_key, 't' || label AS ct_name, vec_id AS pos, x AS "row", y AS "col" FROM v_points WHERE label >= 5""",
)


def points(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    bit = lambda i: (F.col("embedding")[i] > 0).cast("int").cast("string")
    return e.select(
        "vec_id",
        "label",
        F.concat(F.lit("f"), bit(2), bit(3)).alias("fov_key"),
        (100 * F.col("embedding")[0].cast("double")).alias("x"),
        (100 * F.col("embedding")[1].cast("double")).alias("y"),
    )


def cells(spark, sf) -> DataFrame:
    """Points labelled below 5 are segmented cells."""
    return points(spark, sf).where("label < 5").selectExpr("fov_key", "vec_id AS cell_id", "x AS c_row", "y AS c_col")


def marks(spark, sf) -> DataFrame:
    """The other points are hand-placed annotations given as coordinates."""
    return points(spark, sf).where("label >= 5").selectExpr(
        "fov_key", "concat('t', label) AS ct_name", "vec_id AS pos", "x AS `row`", "y AS `col`"
    )


N_CLASSES = 10
CLASSES = [f"t{i}" for i in range(N_CLASSES)]

view(
    "logits",
    """SELECT 'd' || CAST(embedding[11] > 0 AS INTEGER) AS dataset_name,
       'f' || CAST(embedding[12] > 0 AS INTEGER) || CAST(embedding[13] > 0 AS INTEGER) AS fov_name,
       vec_id AS cell_index, 't' || label AS cell_type_actual,
       list_transform(embedding[1:10], lambda e: 10 * CAST(e AS DOUBLE)) AS logits FROM embeddings""",
)
view(
    "exps",
    """SELECT dataset_name, fov_name, cell_index, cell_type_actual,
       list_transform(logits, lambda e: exp(e - list_max(logits))) AS ex FROM v_logits""",
)
view(
    "predictions",
    """SELECT dataset_name, fov_name, cell_index, cell_type_actual,
       list_transform(ex, lambda e: e / list_sum(ex)) AS probs FROM v_exps""",
)
view(
    "scored",
    """SELECT dataset_name, fov_name, cell_index, cell_type_actual, probs,
       't' || (list_position(probs, list_max(probs)) - 1) AS predicted_ct, list_max(probs) AS max_softmax
       FROM v_predictions""",
)


def logits(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    bit = lambda i: (F.col("embedding")[i] > 0).cast("int").cast("string")
    return e.select(
        F.concat(F.lit("d"), bit(10)).alias("dataset_name"),
        F.concat(F.lit("f"), bit(11), bit(12)).alias("fov_name"),
        F.col("vec_id").alias("cell_index"),
        F.concat(F.lit("t"), F.col("label")).alias("cell_type_actual"),
        F.transform(F.slice("embedding", 1, N_CLASSES), lambda v: 10 * v.cast("double")).alias("logits"),
    )


# --- labelled cells: an order is a cell, its customer the field of view -------------------------

RARE_FROM = 499_000

view(
    "labeled",
    f"""SELECT n_name AS dataset_name, o_custkey AS fov_name, c_mktsegment AS domain, n_regionkey AS tissue,
       o_orderkey AS cell_id,
       CASE WHEN o_totalprice >= {RARE_FROM} THEN 'rare_' || n_nationkey || '_' || year(o_orderdate) ELSE o_orderpriority END AS ct_label
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)


def labeled(spark, sf) -> DataFrame:
    """The dearest orders are a rare class of their nation and year, often with a single source."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    rare = F.concat(F.lit("rare_"), "n_nationkey", F.lit("_"), F.year("o_orderdate"))
    return j.select(
        F.col("n_name").alias("dataset_name"),
        F.col("o_custkey").alias("fov_name"),
        F.col("c_mktsegment").alias("domain"),
        F.col("n_regionkey").alias("tissue"),
        F.col("o_orderkey").alias("cell_id"),
        F.when(F.col("o_totalprice") >= RARE_FROM, rare).otherwise(F.col("o_orderpriority")).alias("ct_label"),
    )


view(
    "patients",
    """SELECT 'cohort' || n_regionkey AS dataset_name,
       'scan_Patient' || (c_custkey // 3) || '-' || c_custkey AS fov_name, c_mktsegment AS domain,
       c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)


def patients(spark, sf) -> DataFrame:
    """Customers as fields of view whose name carries a patient shared by three neighbours."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    unit = F.floor(F.col("c_custkey") / 3)
    return j.select(
        F.concat(F.lit("cohort"), "n_regionkey").alias("dataset_name"),
        F.concat(F.lit("scan_Patient"), unit, F.lit("-"), "c_custkey").alias("fov_name"),
        F.col("c_mktsegment").alias("domain"),
        "c_custkey",
        "c_nationkey",
    )


# --- marker positivity ---------------------------------------------------------------------------

view(
    "positivity",
    """SELECT doc_id AS cell_index, source AS dataset_name, lang AS cell_type, 'quality' AS marker,
       least(n_chars / 5000.0, 1.0) AS score, quality AS target FROM documents JOIN labels USING (doc_id)
       UNION ALL
       SELECT doc_id, source, lang, 'toxic', least(n_chars / 5000.0, 1.0), toxic FROM documents JOIN labels USING (doc_id)""",
)
view(
    "truth",
    """SELECT dataset_name, cell_type, marker,
       CASE (CAST(substr(dataset_name, 4) AS INTEGER) + length(marker) + ascii(cell_type)) % 6
       WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '?' WHEN 3 THEN '0.5' WHEN 4 THEN '2' ELSE 'NaN' END AS value
       FROM (SELECT DISTINCT source AS dataset_name, lang AS cell_type FROM documents)
       CROSS JOIN (VALUES ('quality'), ('toxic')) m(marker)""",
)


def positivity(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    wide = d.join(table(spark, sf, "labels"), "doc_id")
    score = F.least(F.col("n_chars") / 5000.0, F.lit(1.0))
    wide = wide.select(
        F.col("doc_id").alias("cell_index"),
        F.col("source").alias("dataset_name"),
        F.col("lang").alias("cell_type"),
        score.alias("score"),
        "quality",
        "toxic",
    )
    return wide.unpivot(["cell_index", "dataset_name", "cell_type", "score"], ["quality", "toxic"], "marker", "target")


def truth(spark, sf) -> DataFrame:
    """A positivity matrix in long form with every kind of entry."""
    pairs = table(spark, sf, "documents").select(F.col("source").alias("dataset_name"), F.col("lang").alias("cell_type")).distinct()
    rows = pairs.select("*", F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("marker"))
    number = (F.substring("dataset_name", 4, 9).cast("int") + F.length("marker") + F.ascii("cell_type")) % 6
    value = F.element_at(F.array(*[F.lit(v) for v in ("0", "1", "?", "0.5", "2", "NaN")]), number + 1)
    return rows.withColumn("value", value)


# --- tabular features ----------------------------------------------------------------------------

view(
    "readings",
    """SELECT l_linenumber AS domain, l_orderkey AS cell_id, l_returnflag || l_linestatus AS marker,
       l_quantity AS value FROM lineitem""",
)


def readings(spark, sf) -> DataFrame:
    """Line items as repeated readings of a marker in a cell."""
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("domain"),
        F.col("l_orderkey").alias("cell_id"),
        F.concat("l_returnflag", "l_linestatus").alias("marker"),
        F.col("l_quantity").alias("value"),
    )


view(
    "hierarchy",
    "SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey",
)


def hierarchy(spark, sf) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))


# --- the same images as tiles: every image is cut from its array, no pixel becomes a row ---------


def _cut(images: DataFrame, height: int, width: int, channel: Column, pixel: Column, name: str) -> DataFrame:
    """Tiles of an 8 x 8 image given as one array of 64 pixels."""
    down, across = -(-8 // height), -(-8 // width)
    tiles = images.select(F.col("vec_id").alias("fov_key"), channel.alias("channel"), pixel.alias("_image"))
    tiles = tiles.withColumn("tile_r", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    tiles = tiles.withColumn("tile_c", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    h = F.least(F.lit(height), F.lit(8) - F.col("tile_r") * height)
    w = F.least(F.lit(width), F.lit(8) - F.col("tile_c") * width)
    lines = F.sequence(F.col("tile_r") * height, F.col("tile_r") * height + h - 1)
    values = F.flatten(F.transform(lines, lambda i: F.slice("_image", i * 8 + F.col("tile_c") * width + 1, w)))
    return tiles.select(
        "fov_key", "channel", "tile_r", "tile_c", F.lit(height).alias("tile_h"), F.lit(width).alias("tile_w"), h.alias("h"), w.alias("w"), values.alias(name)
    )


def image_tiles(spark, sf, height: int, width: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return _cut(e, height, width, F.concat(F.lit("t"), F.col("label")), F.col("embedding").cast("array<double>"), "values")


def mask_tiles(spark, sf, height: int, width: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    quadrant = lambda i: 1 + 2 * F.floor(i / 32) + F.floor(i % 8 / 4)
    label = F.transform("embedding", lambda v, i: F.when(v > 0, quadrant(i)).otherwise(0).cast("bigint"))
    return _cut(e, height, width, F.lit("mask"), label, "labels")
