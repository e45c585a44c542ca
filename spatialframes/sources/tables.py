"""Split manifests and prediction files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialframes.functions.ordering import seeded_rank
from spatialframes.operators.scoring import predictions_wide

_LINE_FIELDS = 1000


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(splits, meta)`` of a manifest document: train, val and, if there, heldout."""
    lists = "map<string,array<string>>"
    doc = spark.read.schema(f"metadata map<string,string>, train {lists}, val {lists}, heldout {lists}").json(path, multiLine=True)
    sides = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("m")) for s in ("train", "val", "heldout")])
    rows = doc.select(F.explode(sides).alias("s")).select("s.split", F.explode("s.m").alias("dataset_name", "fovs"))
    splits = rows.select("dataset_name", F.explode("fovs").alias("fov_name"), "split")
    return splits, doc.select(F.explode("metadata").alias("key", "value"))


def write_splits(splits: DataFrame, path: str, metadata: Mapping[str, object]) -> None:
    """JSON lines ``(split, dataset_name, fov_names)`` under ``path``/splits, metadata beside them.

    A line lists at most a thousand fields; a larger dataset takes several lines.
    """
    ranked = seeded_rank(splits.select("split", "dataset_name", "fov_name"), ["split", "dataset_name"], ["fov_name"], "line")
    line = F.floor((F.col("rank") - 1) / _LINE_FIELDS)
    lines = ranked.groupBy("split", "dataset_name", line.alias("_line")).agg(F.array_sort(F.collect_list("fov_name")).alias("fov_names"))
    lines.drop("_line").write.json(f"{path}/splits")
    pairs = [(k, str(v)) for k, v in metadata.items()]
    meta = splits.sparkSession.createDataFrame(pairs, "key string, value string")
    created = splits.sparkSession.range(1).select(F.lit("created").alias("key"), F.current_timestamp().cast("string").alias("value"))
    meta.unionByName(created).coalesce(1).write.json(f"{path}/metadata")


def read_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.schema("split string, dataset_name string, fov_names array<string>").json(f"{path}/splits")
    splits = lines.select("dataset_name", F.explode("fov_names").alias("fov_name"), "split")
    return splits, spark.read.schema("key string, value string").json(f"{path}/metadata")


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, keys: Sequence[str]) -> None:
    """Save as a table bucketed and sorted by ``keys``.

    Pixels and masks saved with the same buckets by (fov_key, row, col) are joined without a shuffle,
    as often as they are read.
    """
    writer = df.repartition(buckets, *keys).write.option("path", path).format("parquet")
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_predictions(df: DataFrame, names: Sequence[str], path: str, fmt: str = "parquet") -> None:
    """One probability column per class in index order, then label and keys; the commit is atomic."""
    wide = predictions_wide(df, names)
    if fmt == "csv":
        wide.write.option("header", "true").csv(path)
    else:
        wide.write.format(fmt).save(path)
