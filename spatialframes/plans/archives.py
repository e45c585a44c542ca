"""Queries on an archive tree: every user is a field whose metadata files are written from the events and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.operators import annotations, features, positivity
from spatialframes.plans import bindings as b
from spatialframes.plans.registry import query, view
from spatialframes.session import fresh_path
from spatialframes.sources import archive

view(
    "tree",
    """SELECT 'batch' || user_id % 3 || '/f' || user_id AS fov_key, user_id, event_id, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
)


def tree(spark, sf) -> str:
    """Root of the tree. Every seventh field has no annotations, every fifth no matrix, every eleventh a broken top file."""
    e = b.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    key = F.concat(F.lit("batch"), F.col("user_id") % 3, F.lit("/f"), F.col("user_id"))
    # a field has as many cells as its user has events
    e = e.select("user_id", key.alias("fov_key"), "event_id", "event_type", "k", "value")
    entry = F.when(F.col("k") < 50, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("["), F.floor(F.col("event_id") / 100), F.lit(", "), F.col("event_id") % 100, F.lit("]")))
    types = e.groupBy("user_id", "fov_key", "event_type").agg(
        F.concat(F.lit('"'), "event_type", F.lit('": ['), F.array_join(F.collect_list(entry), ", "), F.lit("]")).alias("list"),
        F.when(F.max("value") > 90, F.lit('"1"')).otherwise(F.lit('"?"')).alias("mark"),
        F.concat(F.lit('"'), F.first("event_type"), F.lit('"')).alias("name"),
    )
    fields = types.groupBy("user_id", "fov_key").agg(F.array_sort(F.collect_list(F.struct("name", "list", "mark"))).alias("t"))
    joined = lambda n: F.array_join(F.transform("t", lambda t: t[n]), ", ")
    attributes = lambda *parts: F.concat(F.lit('{"attributes": {'), *parts, F.lit("}}"))
    top = attributes(F.lit('"modality": '), F.get("t", F.lit(0))["name"], F.lit(', "tissue": "T '), F.col("user_id") % 4, F.lit('"'))
    notes = attributes(F.lit('"standardized_source": {"null": [1], '), joined("list"), F.lit("}"))
    matrix = attributes(F.lit('"markers": ['), joined("name"), F.lit('], "cell_types": ["row"], "positivity_matrix": [['), joined("mark"), F.lit("]]"))
    user = F.col("user_id")
    files = F.array_compact(
        F.array(
            F.struct(F.lit("preprocessed").alias("part"), F.lit('{"attributes": {}}').alias("value")),
            F.struct(F.lit("").alias("part"), F.when(user % 11 == 0, F.lit("{broken")).otherwise(top).alias("value")),
            F.when(user % 7 != 0, F.struct(F.lit("cell_types/annotations").alias("part"), notes.alias("value"))),
            F.when(user % 5 != 0, F.struct(F.lit("marker_positivity").alias("part"), matrix.alias("value"))),
        )
    )
    rows = fields.select("fov_key", F.explode(files).alias("f"))
    rel = F.concat_ws("/", "fov_key", F.when(F.col("f.part") != "", F.col("f.part")), F.lit(archive.META))
    root = fresh_path(spark, "archive")
    archive.write_documents(rows.select(rel.alias("rel"), F.col("f.value").alias("value")), root)
    return root


@query("archive_fields", "SELECT DISTINCT fov_key FROM v_tree")
def archive_fields(spark, sf):
    return archive.discover_fovs(spark, tree(spark, sf))


@query(
    "archive_metadata",
    """SELECT fov_key AS "key", CASE WHEN user_id % 11 = 0 THEN 'UNKNOWN' ELSE upper(min(event_type)) END AS domain,
       CASE WHEN user_id % 11 <> 0 THEN 't' || user_id % 4 END AS tissue,
       CASE WHEN user_id % 11 <> 0 AND user_id % 7 <> 0 THEN array_to_string(list(DISTINCT event_type ORDER BY event_type), ',') END AS ct_names,
       user_id % 11 <> 0 AND user_id % 5 <> 0 AS has_mp FROM v_tree GROUP BY fov_key, user_id""",
)
def archive_metadata(spark, sf):
    return archive.read_metadata(spark, tree(spark, sf)).withColumn("ct_names", F.array_join("ct_names", ","))


@query(
    "archive_annotations",
    """SELECT fov_key, 'standardized_source' AS source, event_type AS ct_name, CASE WHEN k < 50 THEN event_id END AS cell_id,
       CASE WHEN k >= 50 THEN (event_id // 100)::DOUBLE END AS "row", CASE WHEN k >= 50 THEN (event_id % 100)::DOUBLE END AS "col" FROM v_tree WHERE user_id % 7 <> 0""",
)
def archive_annotations(spark, sf):
    return archive.read_annotations(spark, tree(spark, sf)).drop("pos")


@query(
    "archive_positivity",
    """SELECT fov_key AS dataset_name, 'row' AS cell_type, event_type AS marker, CASE WHEN max(value) > 90 THEN '1' ELSE '?' END AS value
       FROM v_tree WHERE user_id % 5 <> 0 GROUP BY fov_key, event_type""",
)
def archive_positivity(spark, sf):
    return archive.read_positivity(spark, tree(spark, sf))


@query(
    "alias_file",
    """, p AS (SELECT DISTINCT p_brand AS target, lower(p_brand) || '-x' AS alias FROM part)
       SELECT alias, target FROM p WHERE target < 'Brand#3'""",
)
def alias_file(spark, sf):
    """Aliases of all brands in a file; only those of registered ones come back."""
    brands = b.table(spark, sf, "part").select(F.col("p_brand").alias("target")).distinct()
    line = F.concat(F.lit("'"), F.lower("target"), F.lit("-x': \""), "target", F.lit('"'))
    path = fresh_path(spark, "aliases")
    brands.select(line).coalesce(1).write.text(path)
    vocab = brands.where("target < 'Brand#3'").select(F.lit("marker").alias("kind"), F.col("target").alias("name"))
    return archive.read_aliases(spark, path, vocab).select("alias", "target")


@query(
    "canonical_names",
    """, d AS (SELECT DISTINCT source AS dataset_key FROM documents), c AS (SELECT dataset_key, CAST(substr(dataset_key, 4) AS INTEGER) AS n FROM d)
       SELECT 'not_listed' AS "check", dataset_key AS "key", '' AS detail FROM c WHERE n % 5 = 0
       UNION ALL SELECT 'substituted', dataset_key, 'paper' || n || ', m' || n % 2 FROM c WHERE n % 5 <> 0 AND n % 3 = 0
       UNION ALL SELECT 'unregistered_tissue', dataset_key, 't' || n % 4 FROM c WHERE n % 5 <> 0 AND n % 4 = 3
       UNION ALL SELECT 'unregistered_modality', dataset_key, 'm' || n % 2 FROM c WHERE n % 5 <> 0 AND n % 2 = 1""",
)
def canonical_names(spark, sf):
    n = F.substring("dataset_key", 4, 9).cast("int")
    datasets = b.table(spark, sf, "documents").select(F.col("source").alias("dataset_key"))
    listed = datasets.distinct().where(n % 5 != 0).select(
        "dataset_key", F.concat(F.lit("paper"), n).alias("tissue_paper"), F.concat(F.lit("m"), n % 2).alias("modality_paper"),
        F.concat(F.lit("t"), n % 4).alias("tissue"), F.concat(F.lit("m"), n % 2).alias("modality"), (n % 3 != 0).alias("is_direct"),
    )
    vocab = spark.createDataFrame([("tissue", "t0"), ("tissue", "t1"), ("tissue", "t2"), ("domain", "m0")], "kind string, name string")
    return annotations.canonical_violations(datasets, listed, vocab, strict=True)


@query(
    "first_fields",
    """SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 7) GROUP BY user_id""",
)
def first_fields(spark, sf):
    e = features.limit_fovs(b.table(spark, sf, "events"), 7, "user_id")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "append_fields",
    """SELECT vec_id AS cell_index, 'f' || label % 3 AS fov_name, 'm' || label % 3 AS marker, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings
       UNION ALL SELECT vec_id, 'f' || label % 3, 'shared', round(embedding[2]::DOUBLE, 6) FROM embeddings""",
)
def append_fields(spark, sf):
    """Wide scores of three fields, each with a marker the others lack, appended and made long."""
    e = b.table(spark, sf, "embeddings")
    score = lambda i: b.r6(F.col("embedding")[i].cast("double"))
    fields = [
        e.where(F.col("label") % 3 == f).select(
            F.col("vec_id").alias("cell_index"), F.lit(f"f{f}").alias("fov_name"), score(0).alias(f"m{f}"), score(1).alias("shared")
        )
        for f in range(3)
    ]
    long = positivity.melt_scores(positivity.append_fields(fields))
    return long.where(F.col("score").isNotNull())
