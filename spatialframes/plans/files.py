"""Queries that write a file of the library's formats and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.functions.vectors import softmax
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import CLASSES, r6
from spatialframes.plans.registry import query
from spatialframes.plans.splits import strat
from spatialframes.session import fresh_path
from spatialframes.sources import archive, tables, tiles


@query("split_file", "SELECT dataset_name, CAST(fov_name AS VARCHAR) AS fov_name, split FROM v_strat")
def split_file(spark, sf):
    path = fresh_path(spark, "splits")
    splits = strat(spark, sf).withColumn("fov_name", F.col("fov_name").cast("string"))
    tables.write_splits(splits, path, {"seed": 42, "train_ratio": 0.8})
    return tables.read_splits(spark, path)[0]


@query(
    "prediction_file",
    "SELECT " + ", ".join(f"round(probs[{i + 1}], 6) AS {c}" for i, c in enumerate(CLASSES)) + ", cell_type_actual, cell_index, dataset_name, fov_name FROM v_predictions",
    views=("logits", "exps", "predictions"),
)
def prediction_file(spark, sf):
    path = fresh_path(spark, "predictions")
    df = b.logits(spark, sf).withColumn("probs", F.transform(softmax(F.col("logits")), r6))
    tables.write_predictions(df, CLASSES, path)
    return spark.read.parquet(path)


@query(
    "registry_file",
    """SELECT 'cell_type' AS kind, name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT p_type AS name FROM part)
       UNION ALL SELECT 'marker', name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) FROM (SELECT DISTINCT p_brand AS name FROM part)
       UNION ALL SELECT 'domain', name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS name FROM part)""",
)
def registry_file(spark, sf):
    names = lambda c: F.array_sort(F.collect_set(c)).alias(c)
    # vocabularies of bounded size: the file is one document
    part = b.table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("string"))
    lists = part.agg(names("p_type"), names("p_brand"), names("p_size"))
    places = F.transform("p_type", lambda x, i: i)
    doc = lists.select(
        F.map_from_arrays("p_type", places).alias("cell_type_mapping"),
        F.col("p_brand").alias("all_standardized_channels"),
        F.col("p_size").alias("domains"),
    )
    path = fresh_path(spark, "registry")
    doc.coalesce(1).write.json(path)
    return archive.read_registry(spark, path)


@query("tile_file", """SELECT fov_key, channel, "row", "col", value FROM v_images WHERE channel IN ('t1', 't2')""")
def tile_file(spark, sf):
    path = fresh_path(spark, "tiles")
    tiles.write_tiles(tiles.pixels_to_tiles(b.images(spark, sf), 4, 8), path)
    return tiles.tiles_to_pixels(tiles.read_tiles(spark, path, ["t1", "t2"]))


@query("tile_hook", """SELECT fov_key, channel, "row", "col", round(greatest(value, 0.0), 6) + 0 AS value FROM v_images""")
def tile_hook(spark, sf):
    out = tiles.hook_on_tiles(tiles.pixels_to_tiles(b.images(spark, sf), 4, 4), lambda raw, names: raw.clip(0, 1))
    return tiles.tiles_to_pixels(out).withColumn("value", r6("value"))
