"""Queries on splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spatialframes.functions.names import parse_patient_id
from spatialframes.operators import splits as ops
from spatialframes.plans import bindings as b
from spatialframes.plans.bindings import r6
from spatialframes.plans.registry import query, view

FOV_STRATA = ["domain", "tissue"]

view(
    "sole",
    """SELECT DISTINCT f.dataset_name, f.fov_name FROM (SELECT ct_label, min({'dataset_name': dataset_name, 'fov_name': fov_name}) AS f
       FROM (SELECT DISTINCT ct_label, dataset_name, fov_name FROM v_labeled) GROUP BY ct_label HAVING count(*) = 1)""",
)
view("fovs", "SELECT dataset_name, fov_name, min(domain) AS domain, min(tissue) AS tissue FROM v_labeled GROUP BY ALL")
view("rest", "SELECT * FROM v_fovs ANTI JOIN v_sole USING (dataset_name, fov_name)")
view(
    "strat",
    """SELECT dataset_name, fov_name, domain, tissue, CASE WHEN n = 1 OR rk <= greatest(1, least(n - 1, CAST(round_even(n * 0.8::DOUBLE, 0) AS BIGINT)))
       THEN 'train' ELSE 'val' END AS split, false AS forced, n AS n_units FROM (SELECT *, count(*) OVER (PARTITION BY domain, tissue) AS n,
       row_number() OVER (PARTITION BY domain, tissue ORDER BY md5('42|fov:' || dataset_name || '/' || fov_name), 'fov:' || dataset_name || '/' || fov_name) AS rk FROM v_rest)
       UNION ALL SELECT dataset_name, fov_name, domain, tissue, 'train', true, 0 FROM v_fovs SEMI JOIN v_sole USING (dataset_name, fov_name)""",
)


@query("sole_source", "SELECT dataset_name, fov_name FROM v_sole")
def sole_source(spark, sf):
    return ops.sole_source(b.labeled(spark, sf))


def strat(spark, sf):
    return ops.stratified_split(b.labeled(spark, sf), FOV_STRATA)


@query("stratified_split", "SELECT dataset_name, fov_name, domain, tissue, split, forced, n_units FROM v_strat")
def stratified_split(spark, sf):
    return strat(spark, sf)


view(
    "punits",
    """SELECT dataset_name, fov_name, domain, coalesce('patient:' || nullif(regexp_extract(dataset_name, '^(.*?Patient\\d+)', 1), ''),
       'patient:' || nullif(regexp_extract(fov_name, '^(.*?Patient\\d+)', 1), ''), 'fov:' || dataset_name || '/' || fov_name) AS unit FROM
       (SELECT dataset_name, CASE WHEN domain = 'BUILDING' THEN 'scan' || c_custkey ELSE fov_name END AS fov_name, domain FROM v_patients)""",
)
view(
    "psplit",
    """SELECT p.dataset_name, p.fov_name, p.domain, unit, CASE WHEN n = 1 OR rk <= greatest(1, least(n - 1, CAST(round_even(n * 0.8::DOUBLE, 0) AS BIGINT)))
       THEN 'train' ELSE 'val' END AS split, n AS n_units FROM v_punits p JOIN (SELECT *, count(*) OVER (PARTITION BY dataset_name) AS n,
       row_number() OVER (PARTITION BY dataset_name ORDER BY md5('42|' || unit), unit) AS rk FROM (SELECT DISTINCT dataset_name, unit FROM v_punits)) USING (dataset_name, unit)""",
)


def patient_split_frame(spark, sf):
    p = b.patients(spark, sf)
    name = F.when(F.col("domain") == "BUILDING", F.concat(F.lit("scan"), "c_custkey")).otherwise(F.col("fov_name"))
    # one class over all fields, so that no field is forced
    cells = p.select("dataset_name", name.alias("fov_name"), "domain", F.col("dataset_name").alias("cohort"), F.lit("any").alias("ct_label"))
    return ops.stratified_split(cells, ["cohort"], by_patient=True)


@query("patient_split", "SELECT dataset_name, fov_name, split, n_units FROM v_psplit")
def patient_split(spark, sf):
    return patient_split_frame(spark, sf).select("dataset_name", "fov_name", "split", "n_units")


@query(
    "patient_leaks",
    """, u AS (SELECT 'scan_Patient' || (c_custkey // 3) AS patient, domain, dataset_name, fov_name FROM v_patients),
       r AS (SELECT *, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY md5('42|patient:' || patient), patient) AS rk FROM (SELECT DISTINCT domain, patient FROM u)),
       s AS (SELECT u.*, CASE WHEN rk <= greatest(1, least(n - 1, CAST(round_even(n * 0.8::DOUBLE, 0) AS BIGINT))) THEN 'train' ELSE 'val' END AS split FROM u JOIN r USING (domain, patient))
       SELECT patient, count(DISTINCT split) AS n_splits, count(*) AS n_fovs FROM s GROUP BY patient HAVING count(DISTINCT split) > 1""",
)
def patient_leaks(spark, sf):
    cells = b.patients(spark, sf).withColumn("ct_label", F.lit("any"))
    return ops.patient_leaks(ops.stratified_split(cells, ["domain"], by_patient=True))


@query(
    "patient_id",
    """SELECT c_custkey, regexp_extract(fov_name, '^(.*?Patient\\d+)', 1) AS patient,
       CAST(nullif(regexp_extract(c_name, '^(.*?Patient\\d+)', 1), '') AS VARCHAR) AS none FROM v_patients JOIN customer USING (c_custkey)""",
)
def patient_id(spark, sf):
    names = b.table(spark, sf, "customer").select("c_custkey", "c_name")
    df = b.patients(spark, sf).select("c_custkey", "dataset_name", "fov_name").join(names, "c_custkey")
    return df.select(
        "c_custkey",
        parse_patient_id(F.col("dataset_name"), F.col("fov_name")).alias("patient"),
        parse_patient_id(F.col("c_name")).alias("none"),
    )


@query(
    "global_split",
    """SELECT dataset_name, fov_name, CASE WHEN rk <= greatest(0, CAST(floor((SELECT count(*) FROM v_fovs) * 0.8::DOUBLE) AS BIGINT) - (SELECT count(*) FROM v_sole)) THEN 'train' ELSE 'val' END AS split
       FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || dataset_name || '|' || fov_name), dataset_name, fov_name) AS rk FROM v_rest)
       UNION ALL SELECT dataset_name, fov_name, 'train' FROM v_sole""",
)
def global_split(spark, sf):
    return ops.global_split(b.labeled(spark, sf))


@query(
    "split_meta",
    """SELECT count(*) FILTER (split = 'train') AS num_train_fovs, count(*) FILTER (split = 'val') AS num_val_fovs, count(DISTINCT dataset_name) AS num_datasets,
       count(DISTINCT CASE WHEN n_units = 1 AND NOT forced THEN domain || tissue END) AS num_single_unit_strata,
       42 AS seed, 0.8::DOUBLE AS train_ratio, 'domain,tissue' AS stratify_by, false AS group_by_patient FROM v_strat""",
)
def split_meta(spark, sf):
    return ops.split_metadata(strat(spark, sf), FOV_STRATA, 42, 0.8)


view("val", "SELECT dataset_name, fov_name FROM v_strat WHERE split = 'val'")
view(
    "valtest",
    """SELECT dataset_name, fov_name, CASE WHEN n >= 2 AND rk <= greatest(1, CAST(round_even(n * 0.3::DOUBLE, 0) AS BIGINT)) THEN 'test' ELSE 'val' END AS split
       FROM (SELECT *, count(*) OVER (PARTITION BY dataset_name) AS n, row_number() OVER (PARTITION BY dataset_name ORDER BY md5('42|' || fov_name), fov_name) AS rk FROM v_val)""",
)


def val_fovs(spark, sf):
    return strat(spark, sf).where("split = 'val'").select("dataset_name", "fov_name")


@query("val_test_split", "SELECT dataset_name, fov_name, split FROM v_valtest")
def val_test_split(spark, sf):
    return ops.val_test_split(val_fovs(spark, sf))


@query(
    "val_test_split_global",
    """SELECT fov_name AS dataset_name, fov_name, CASE WHEN rk <= CAST(round_even(n * 0.3::DOUBLE, 0) AS BIGINT) THEN 'test' ELSE 'val' END AS split
       FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42|' || fov_name || '|' || fov_name), fov_name) AS rk FROM v_val)""",
)
def val_test_split_global(spark, sf):
    return ops.val_test_split(val_fovs(spark, sf).select(F.col("fov_name").alias("dataset_name"), "fov_name"))


RANKED = "(SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY md5('42|' || dataset_name || '|' || fov_name), dataset_name, fov_name) AS rk FROM v_fovs)"


@query(
    "inner_val",
    f"""SELECT dataset_name, fov_name, CASE WHEN rk <= least(greatest(1, CAST(round_even(n * 0.1::DOUBLE, 0) AS BIGINT)), n - 1) THEN 'inner_val' ELSE 'train' END AS split FROM {RANKED}""",
    views=("fovs",),
)
def inner_val(spark, sf):
    return ops.inner_val(ops.fov_frame(b.labeled(spark, sf)), 0.1)


@query(
    "group_shuffle",
    f"""SELECT dataset_name, fov_name, CASE WHEN rk <= ceil(n * 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM {RANKED}""",
    views=("fovs",),
)
def group_shuffle(spark, sf):
    return ops.group_shuffle(ops.fov_frame(b.labeled(spark, sf)), 0.25)


@query(
    "row_split",
    """SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) <= count(*) OVER () - floor(count(*) OVER () * 0.2::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM orders""",
)
def row_split(spark, sf):
    return ops.row_split(b.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


# a manifest with faults: fields of region 0 are also held out, those of region 1 are not listed
view(
    "manifest",
    """SELECT dataset_name, fov_name, split FROM v_strat WHERE tissue <> 1
       UNION ALL SELECT dataset_name, fov_name, 'heldout' FROM v_strat WHERE tissue = 0
       UNION ALL SELECT dataset_name, fov_name, 'val' FROM v_strat WHERE tissue = 2 AND split = 'train'
       UNION ALL SELECT n_name, -n_nationkey - 1, CASE WHEN n_regionkey = 0 THEN 'heldout' ELSE 'train' END FROM nation""",
)


def manifest(spark, sf):
    from spatialframes.session import settle

    s = settle(strat(spark, sf).select("dataset_name", "fov_name", "tissue", "split"))
    cols = ["dataset_name", "fov_name"]
    n = b.table(spark, sf, "nation")
    gone = n.select(F.col("n_name").alias("dataset_name"), (-F.col("n_nationkey") - 1).cast("bigint").alias("fov_name"), F.when(F.col("n_regionkey") == 0, "heldout").otherwise("train").alias("split"))
    return (
        s.where("tissue <> 1").select(*cols, "split")
        .unionByName(s.where("tissue = 0").select(*cols, F.lit("heldout").alias("split")))
        .unionByName(s.where("tissue = 2 AND split = 'train'").select(*cols, F.lit("val").alias("split")))
        .unionByName(gone)
    )


OVERLAP = """SELECT DISTINCT 'train_val_overlap' AS "check", a.dataset_name || '/' || a.fov_name AS "key" FROM v_manifest a JOIN v_manifest c USING (dataset_name, fov_name) WHERE a.split = 'train' AND c.split = 'val'
       UNION ALL SELECT DISTINCT 'heldout_overlap', a.dataset_name || '/' || a.fov_name FROM v_manifest a JOIN v_manifest c USING (dataset_name, fov_name) WHERE a.split = 'heldout' AND c.split IN ('train', 'val')"""


@query("split_overlap", OVERLAP)
def split_overlap(spark, sf):
    return ops.split_overlap(manifest(spark, sf))


@query(
    "split_missing",
    """SELECT DISTINCT 'split_not_live' AS "check", dataset_name || '/' || fov_name AS "key" FROM v_manifest ANTI JOIN v_fovs USING (dataset_name, fov_name) WHERE split <> 'heldout'
       UNION ALL SELECT DISTINCT 'heldout_not_live', dataset_name || '/' || fov_name FROM v_manifest ANTI JOIN v_fovs USING (dataset_name, fov_name) WHERE split = 'heldout'
       UNION ALL SELECT 'live_not_in_split', dataset_name || '/' || fov_name FROM v_fovs ANTI JOIN v_manifest USING (dataset_name, fov_name)""",
)
def split_missing(spark, sf):
    return ops.split_missing(manifest(spark, sf), b.labeled(spark, sf))


@query(
    "split_contract",
    """, m AS (SELECT CASE WHEN dataset_name = 'NATION_3' THEN dataset_name ELSE CAST(fov_name AS VARCHAR) END AS dataset_name, CAST(fov_name AS VARCHAR) AS fov_name, split FROM v_manifest)
       SELECT DISTINCT 'train_val_overlap' AS "check", a.dataset_name || '/' || a.fov_name AS "key" FROM m a JOIN m c USING (dataset_name, fov_name) WHERE a.split = 'train' AND c.split = 'val'
       UNION ALL SELECT DISTINCT 'heldout_overlap', a.dataset_name || '/' || a.fov_name FROM m a JOIN m c USING (dataset_name, fov_name) WHERE a.split = 'heldout' AND c.split IN ('train', 'val')
       UNION ALL SELECT DISTINCT 'unsupported_pair', dataset_name || '/' || fov_name FROM m WHERE dataset_name <> fov_name
       UNION ALL SELECT DISTINCT 'absent_from_archive', dataset_name || '/' || fov_name FROM m WHERE dataset_name = fov_name AND fov_name NOT IN (SELECT CAST(fov_name AS VARCHAR) FROM v_fovs)""",
)
def split_contract(spark, sf):
    m = manifest(spark, sf).withColumn("fov_name", F.col("fov_name").cast("string"))
    m = m.withColumn("dataset_name", F.when(F.col("dataset_name") == "NATION_3", F.col("dataset_name")).otherwise(F.col("fov_name")))
    live = b.labeled(spark, sf).select(F.col("fov_name").cast("string").alias("fov_key"))
    return ops.split_contract(m, live)


@query(
    "feature_split_contract",
    """, kept AS (SELECT * FROM v_fovs WHERE tissue <> 3), feats AS (SELECT * FROM v_fovs WHERE domain <> 'FURNITURE'),
       act AS (SELECT DISTINCT dataset_name, fov_name FROM v_manifest WHERE split <> 'heldout'), held AS (SELECT DISTINCT dataset_name, fov_name FROM v_manifest WHERE split = 'heldout')
       SELECT 'not_in_archive' AS "check", dataset_name || '/' || fov_name AS "key" FROM act ANTI JOIN v_fovs USING (dataset_name, fov_name)
       UNION ALL SELECT 'heldout_not_in_archive', dataset_name || '/' || fov_name FROM held ANTI JOIN v_fovs USING (dataset_name, fov_name)
       UNION ALL SELECT 'excluded_by_keep', dataset_name || '/' || fov_name FROM act SEMI JOIN v_fovs USING (dataset_name, fov_name) ANTI JOIN kept USING (dataset_name, fov_name)
       UNION ALL SELECT 'no_features', dataset_name || '/' || fov_name FROM act SEMI JOIN kept USING (dataset_name, fov_name) ANTI JOIN feats USING (dataset_name, fov_name)
       UNION ALL SELECT 'absent_from_split', dataset_name || '/' || fov_name FROM feats ANTI JOIN v_manifest USING (dataset_name, fov_name)""",
)
def feature_split_contract(spark, sf):
    f = ops.fov_frame(b.labeled(spark, sf), FOV_STRATA)
    return ops.feature_split_contract(manifest(spark, sf), f, f.where("tissue <> 3"), f.where("domain <> 'FURNITURE'"))


@query(
    "assign_split",
    """SELECT cell_id, split FROM v_labeled LEFT JOIN (SELECT dataset_name, fov_name,
       CASE WHEN bool_or(split = 'train') THEN 'train' WHEN bool_or(split = 'val') THEN 'val' ELSE 'heldout' END AS split
       FROM v_manifest GROUP BY ALL) USING (dataset_name, fov_name)""",
)
def assign_split(spark, sf):
    return ops.assign_split(b.labeled(spark, sf), manifest(spark, sf)).select("cell_id", "split")


@query(
    "meta_diff",
    """, s AS (SELECT c_mktsegment AS "key", CAST(count(*) AS VARCHAR) AS value FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY ALL UNION ALL SELECT 'zarr_path', min(c_name) FROM customer),
       c AS (SELECT "key", CASE WHEN "key" = 'HOUSEHOLD' THEN NULL ELSE CAST(n AS VARCHAR) END AS value FROM (SELECT c_mktsegment AS "key", count(*) FILTER (c_mktsegment <> 'BUILDING' OR c_acctbal > 0) AS n FROM customer GROUP BY 1) UNION ALL SELECT 'zarr_path', max(c_name) FROM customer)
       SELECT "key", s.value AS saved, c.value AS current, CASE WHEN s.value IS NULL THEN 'missing' ELSE 'mismatch' END AS problem, "key" = 'zarr_path' AS advisory
       FROM s FULL JOIN c USING ("key") WHERE c.value IS NOT NULL AND s.value IS DISTINCT FROM c.value""",
)
def meta_diff(spark, sf):
    c = b.table(spark, sf, "customer").select("c_mktsegment", "c_acctbal", "c_name")
    key = F.col("c_mktsegment").alias("key")
    text = lambda col: col.cast("string").alias("value")
    saved = c.where("c_mktsegment <> 'FURNITURE'").groupBy(key).agg(text(F.count(F.lit(1))))
    kept = F.count_if((F.col("c_mktsegment") != "BUILDING") | (F.col("c_acctbal") > 0))
    current = c.groupBy(key).agg(kept.cast("string").alias("value"))
    current = current.withColumn("value", F.when(F.col("key") != "HOUSEHOLD", F.col("value")))
    saved = saved.union(c.select(F.lit("zarr_path"), F.min("c_name")))
    current = current.union(c.select(F.lit("zarr_path"), F.max("c_name")))
    return ops.meta_diff(saved, current)


@query(
    "example_list",
    """, n AS (SELECT dataset_name, count(*) AS n, list(fov_name ORDER BY fov_name)[1:5] AS first FROM v_fovs GROUP BY ALL)
       SELECT dataset_name, array_to_string(list_transform(first, lambda f: CAST(f AS VARCHAR)), ', ') || CASE WHEN n > 5 THEN ', ... (+' || (n - 5) || ' more)' ELSE '' END AS examples FROM n""",
)
def example_list(spark, sf):
    from spatialframes.operators.quality import example_list as examples

    return examples(ops.fov_frame(b.labeled(spark, sf)), ["dataset_name"], "fov_name")
