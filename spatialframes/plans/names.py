"""Queries on names and registries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spatialframes.functions import names as fn
from spatialframes.operators import quality as ops
from spatialframes.operators import features
from spatialframes.plans import bindings as b
from spatialframes.plans.registry import query, view
from spatialframes.session import settle

view("markers", "SELECT p_brand AS name, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT p_brand FROM part)")
view(
    "aliases",
    """SELECT p_name AS alias, min(p_brand) AS target, min(p_partkey) AS ord FROM part GROUP BY p_name
       UNION ALL SELECT DISTINCT p_type, 'no ' || p_type, 0 FROM part""",
)
view(
    "channels",
    """SELECT p_partkey, p_size, CASE WHEN p_size < 10 THEN p_brand WHEN p_size < 20 THEN upper(p_brand) WHEN p_size < 30 THEN p_name
       WHEN p_size < 40 THEN upper(p_name) WHEN p_size < 45 THEN p_type WHEN p_size < 48 THEN 'DAPI-' || p_size ELSE '' END AS channel FROM part""",
)


def markers(spark, sf):
    return settle(fn.index_names(b.table(spark, sf, "part"), "p_brand"))


def aliases(spark, sf):
    p = b.table(spark, sf, "part")
    real = p.groupBy(F.col("p_name").alias("alias")).agg(F.min("p_brand").alias("target"), F.min("p_partkey").alias("ord"))
    return real.union(p.select("p_type", F.concat(F.lit("no "), "p_type"), F.lit(0).cast("bigint")).distinct())


def channels(spark, sf):
    size = F.col("p_size")
    name = (
        F.when(size < 10, F.col("p_brand")).when(size < 20, F.upper("p_brand")).when(size < 30, F.col("p_name"))
        .when(size < 40, F.upper("p_name")).when(size < 45, F.col("p_type"))
        .when(size < 48, F.concat(F.lit("DAPI-"), size)).otherwise(F.lit(""))
    )
    return b.table(spark, sf, "part").select("p_partkey", "p_size", name.alias("channel"))


view(
    "resolved",
    """SELECT c.p_partkey, c.p_size, c.channel, coalesce(m.name, a.target, lm.name, la.target) AS marker FROM v_channels c LEFT JOIN v_markers m ON m.name = c.channel
       LEFT JOIN (SELECT * FROM v_aliases WHERE target IN (SELECT name FROM v_markers)) a ON a.alias = c.channel
       LEFT JOIN (SELECT lower(name) AS k, max(name) AS name FROM v_markers GROUP BY ALL) lm ON lm.k = lower(c.channel)
       LEFT JOIN (SELECT lower(alias) AS k, arg_min(target, ord) AS target FROM v_aliases WHERE target IN (SELECT name FROM v_markers) GROUP BY ALL) la ON la.k = lower(c.channel)""",
)


def resolved(spark, sf):
    return fn.resolve_channels(channels(spark, sf), "channel", markers(spark, sf), aliases(spark, sf))


@query("resolve_channel", "SELECT p_partkey, channel, marker FROM v_resolved")
def resolve_channel(spark, sf):
    return resolved(spark, sf).select("p_partkey", "channel", "marker")


@query("resolve_strict", "SELECT p_partkey, channel, coalesce(idx, -1) AS marker_idx FROM v_channels LEFT JOIN v_markers ON name = channel")
def resolve_strict(spark, sf):
    return fn.resolve_strict(channels(spark, sf), "channel", markers(spark, sf)).select("p_partkey", "channel", "marker_idx")


@query(
    "control_channels",
    """SELECT p_partkey, upper(trim(channel)) IN ('H3', 'HISTONEH3', 'HISTONE H3', 'RABBIT IGG', 'GOAT IGG', 'MOUSE IGG')
       OR regexp_matches(upper(trim(channel)), '^(BLANK|CH2|CH3|DAPI|DNA|DRAQ|EMPTY|EMPYT|HOECHST|IR)') AS is_control FROM v_channels""",
)
def control_channels(spark, sf):
    return channels(spark, sf).select("p_partkey", fn.is_control_channel(F.col("channel")).alias("is_control"))


@query(
    "normalize_names",
    """SELECT s_suppkey, replace(trim(lower(' ' || s_name || ' Left Lung ')), ' ', '') AS tissue, upper(trim(' ' || s_name || ' ')) AS modality FROM supplier""",
)
def normalize_names(spark, sf):
    s = b.table(spark, sf, "supplier")
    tissue = F.concat(F.lit(" "), "s_name", F.lit(" Left Lung "))
    modality = F.concat(F.lit(" "), "s_name", F.lit(" "))
    return s.select("s_suppkey", fn.normalize_tissue(tissue).alias("tissue"), fn.normalize_modality(modality).alias("modality"))


@query(
    "stable_hash",
    """SELECT c_custkey, substr(sha256('{"balance":"' || CAST(CAST(round(c_acctbal) AS BIGINT) AS VARCHAR) || '","name":"' || c_name || '","segment":"' || c_mktsegment || '"}'), 1, 16) AS digest FROM customer""",
)
def stable_hash(spark, sf):
    c = b.table(spark, sf, "customer")
    entries = F.create_map(F.lit("segment"), "c_mktsegment", F.lit("name"), "c_name", F.lit("balance"), F.round("c_acctbal").cast("bigint").cast("string"))
    return c.select("c_custkey", fn.stable_hash(entries).alias("digest"))


@query(
    "names_by_index",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
)
def names_by_index(spark, sf):
    n = b.table(spark, sf, "nation")
    maps = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return maps.select("n_regionkey", F.array_join(fn.names_by_index(F.col("m")), ",").alias("names"))


@query(
    "json_map_keys",
    """SELECT event_id, event_id AS cell_id, value AS c_row, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS c_col FROM events""",
)
def json_map_keys(spark, sf):
    e = b.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"'), "event_id", F.lit('": ['), "value", F.lit(", "), k, F.lit('], "none": [0, 0]}'))
    rows = e.select("event_id", F.explode(fn.centroid_map(text)).alias("c"))
    return rows.select("event_id", "c.cell_id", "c.c_row", "c.c_col")


@query(
    "prompt_text",
    """SELECT name, 'The protein biomarker ' || name || ' is used in multiplexed immunofluorescence imaging for cell type identification in tissue samples.' AS marker_prompt,
       'The cell type ' || name || ' as identified in multiplexed immunofluorescence imaging of human tissue samples.' AS cell_type_prompt FROM (SELECT DISTINCT p_name AS name FROM part)""",
)
def prompt_text(spark, sf):
    n = b.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return n.select("name", fn.marker_prompt(F.col("name")).alias("marker_prompt"), fn.cell_type_prompt(F.col("name")).alias("cell_type_prompt"))


@query("list_supported", "SELECT DISTINCT p_brand AS name FROM part")
def list_supported(spark, sf):
    vocab = markers(spark, sf).withColumn("kind", F.lit("marker"))
    other = fn.index_names(b.table(spark, sf, "part"), "p_type").withColumn("kind", F.lit("cell_type"))
    return fn.list_supported(vocab.unionByName(other), "marker")


@query("domain_index", "SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)")
def domain_index(spark, sf):
    return fn.index_names(b.table(spark, sf, "customer"), "c_mktsegment")


# the panel of a supplier: its line items in order, the part name is the channel
view(
    "panel",
    """SELECT l_suppkey AS fov_key, row_number() OVER (PARTITION BY l_suppkey ORDER BY q, channel) AS pos, channel, marker, q > 45 AS all_zero FROM
       (SELECT l_suppkey, channel, marker, min(l_quantity) AS q FROM lineitem JOIN v_resolved ON l_partkey = p_partkey GROUP BY ALL)""",
)


def panel(spark, sf):
    l = b.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")  # noqa: E741
    rows = l.join(resolved(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.groupBy(F.col("l_suppkey").alias("fov_key"), "channel", "marker").agg(F.min("l_quantity").alias("q"))
    pos = F.row_number().over(Window.partitionBy("fov_key").orderBy("q", "channel"))
    return rows.select("fov_key", pos.cast("bigint").alias("pos"), "channel", "marker", (F.col("q") > 45).alias("all_zero"))


@query(
    "channel_mask",
    """, k AS (SELECT *, min(pos) FILTER (NOT all_zero AND marker IS NOT NULL) OVER (PARTITION BY fov_key, marker) AS first FROM v_panel)
       SELECT fov_key, pos, channel, CASE WHEN marker IS NULL THEN 'not_in_registry' WHEN pos > first THEN 'duplicate' WHEN all_zero THEN 'all_zero' END AS reason FROM k""",
)
def channel_mask(spark, sf):
    return ops.channel_mask(panel(spark, sf)).select("fov_key", "pos", "channel", "reason")


@query(
    "panel_cap",
    """, k AS (SELECT *, min(pos) FILTER (NOT all_zero AND marker IS NOT NULL) OVER (PARTITION BY fov_key, marker) AS first FROM v_panel),
       s AS (SELECT fov_key, count(*) FILTER (marker IS NOT NULL AND pos <= first AND NOT all_zero) AS n FROM k GROUP BY fov_key)
       SELECT 'too_many' AS "check", CAST(fov_key AS VARCHAR) AS "key", CAST(n AS VARCHAR) AS detail FROM s WHERE n > 22
       UNION ALL SELECT 'no_channel', CAST(s_suppkey AS VARCHAR), '0' FROM supplier WHERE s_suppkey NOT IN (SELECT fov_key FROM s WHERE n > 0)""",
)
def panel_cap(spark, sf):
    kept = ops.channel_mask(panel(spark, sf)).where("kept")
    return ops.panel_cap(kept, b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fov_key")), 22)


@query(
    "unknown_channels",
    """SELECT channel, count(*) AS n FROM lineitem JOIN v_channels ON l_partkey = p_partkey WHERE channel NOT IN (SELECT name FROM v_markers)
       AND NOT regexp_matches(upper(trim(channel)), '^(BLANK|CH2|CH3|DAPI|DNA|DRAQ|EMPTY|EMPYT|HOECHST|IR)') GROUP BY channel ORDER BY n DESC, channel LIMIT 10""",
)
def unknown_channels(spark, sf):
    l = b.table(spark, sf, "lineitem").select("l_partkey")  # noqa: E741
    rows = l.join(channels(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    return ops.unknown_channels(rows, markers(spark, sf))


@query(
    "vocab_contract",
    """, v AS (SELECT r_name AS kind, n_name AS name, n_nationkey AS idx FROM nation JOIN region ON n_regionkey = r_regionkey
       UNION ALL SELECT 'brand', p_brand, p_size % 3 FROM part UNION ALL SELECT 'good', name, idx FROM v_markers),
       s AS (SELECT kind, count(*) AS n, count(DISTINCT idx) AS ni, count(DISTINCT name) AS nn, min(idx) AS lo, max(idx) AS hi FROM v GROUP BY kind)
       SELECT 'index_not_unique' AS "check", kind AS "key", CAST(ni AS VARCHAR) AS detail FROM s WHERE ni <> n
       UNION ALL SELECT 'index_not_contiguous', kind, lo || '..' || hi FROM s WHERE lo <> 0 OR hi <> n - 1
       UNION ALL SELECT 'name_not_unique', kind, CAST(nn AS VARCHAR) FROM s WHERE nn <> n""",
)
def vocab_contract(spark, sf):
    n, r = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    nations = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("kind"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("idx"))
    brands = b.table(spark, sf, "part").select(F.lit("brand").alias("kind"), F.col("p_brand").alias("name"), (F.col("p_size") % 3).alias("idx"))
    good = markers(spark, sf).select(F.lit("good").alias("kind"), "name", "idx")
    return ops.vocab_contract(nations.unionByName(brands).unionByName(good))


@query(
    "marker_order_diff",
    """, e AS (SELECT p_type AS name, row_number() OVER (ORDER BY p_type) - 1 AS idx FROM (SELECT DISTINCT p_type FROM part)
       UNION ALL SELECT p_name, 1000 + row_number() OVER (ORDER BY p_name) FROM (SELECT DISTINCT p_name FROM part)),
       a AS (SELECT name, CASE WHEN idx > 1004 THEN idx + 1 ELSE idx END AS idx FROM e WHERE idx <> 1010 UNION ALL SELECT DISTINCT 'new ' || p_type, -1 FROM part WHERE p_type < 'F')
       SELECT 'missing' AS problem, name, idx FROM e WHERE name NOT IN (SELECT name FROM a)
       UNION ALL SELECT 'extra', name, idx FROM a WHERE name NOT IN (SELECT name FROM e)
       UNION ALL (SELECT 'first_out_of_order', e.name, e.idx FROM e JOIN a USING (idx) WHERE e.name <> a.name ORDER BY idx LIMIT 1)""",
)
def marker_order_diff(spark, sf):
    """Types and names of all parts as the registry."""
    p = b.table(spark, sf, "part")
    types = fn.index_names(p, "p_type").withColumn("idx", F.col("idx").cast("bigint"))
    named = fn.index_names(p, "p_name").select("name", (F.col("idx") + 1001).cast("bigint").alias("idx"))
    expected = types.unionByName(named)
    actual = expected.where("idx <> 1010").withColumn("idx", F.when(F.col("idx") > 1004, F.col("idx") + 1).otherwise(F.col("idx")))
    extra = p.where("p_type < 'F'").select(F.concat(F.lit("new "), "p_type").alias("name"), F.lit(-1).cast("bigint").alias("idx")).distinct()
    return ops.order_diff(expected, actual.unionByName(extra))


@query(
    "mapping_vs_declared",
    """, m AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size < 49), d AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT LIKE '%bolt%' UNION SELECT r_name FROM region)
       SELECT name, 'missing_from_mapping' AS problem FROM d WHERE name NOT IN (SELECT name FROM m) UNION ALL SELECT name, 'extra_in_mapping' FROM m WHERE name NOT IN (SELECT name FROM d)""",
)
def mapping_vs_declared(spark, sf):
    p = b.table(spark, sf, "part")
    declared = p.where("p_name NOT LIKE '%bolt%'").select(F.col("p_name").alias("name")).union(b.table(spark, sf, "region").select("r_name"))
    return ops.mapping_vs_declared(p.where("p_size < 49").select(F.col("p_name").alias("name")), declared)


@query(
    "fov_report_rollup",
    """, ch AS (SELECT DISTINCT o_orderstatus AS modality, o_orderpriority AS tissue, l_orderkey AS fov_key, channel FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN v_channels ON l_partkey = p_partkey),
       f AS (SELECT modality, tissue, fov_key, count(*) AS n, count(*) FILTER (channel NOT IN (SELECT name FROM v_markers)
       AND NOT regexp_matches(upper(trim(channel)), '^(BLANK|CH2|CH3|DAPI|DNA|DRAQ|EMPTY|EMPYT|HOECHST|IR)')) AS unknown FROM ch GROUP BY ALL)
       SELECT modality, tissue, count(*) AS num_fovs, count(*) FILTER (n <= 2) AS num_two_channel, CAST(sum(unknown) AS BIGINT) AS num_unknown_channels FROM f GROUP BY ROLLUP (modality, tissue)""",
)
def fov_report_rollup(spark, sf):
    """An order is a field, its line items are the channels."""
    o = b.table(spark, sf, "orders")
    fovs = o.select(F.col("o_orderkey").alias("fov_key"), F.col("o_orderstatus").alias("modality"), F.col("o_orderpriority").alias("tissue"))
    l = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fov_key"), "l_partkey")  # noqa: E741
    rows = l.join(channels(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    return ops.fov_report(rows, markers(spark, sf), fovs)


@query(
    "zero_channels",
    "SELECT fov_key, channel FROM (SELECT user_id AS fov_key, event_type AS channel, CASE WHEN value < 60 THEN 0 ELSE value END AS value FROM events) GROUP BY ALL HAVING max(value) = 0",
)
def zero_channels(spark, sf):
    p = b.pixels(spark, sf).withColumn("value", F.when(F.col("value") < 60, 0.0).otherwise(F.col("value")))
    return ops.zero_channels(p)


@query(
    "clear_channels",
    """, z AS (SELECT user_id AS fov_key, event_type AS channel FROM events GROUP BY ALL HAVING max(CASE WHEN value < 60 THEN 0 ELSE value END) = 0)
       SELECT fov_key, channel, "row", "col" FROM v_pixels ANTI JOIN z USING (fov_key, channel)""",
)
def clear_channels(spark, sf):
    return ops.clear_channels(b.pixels(spark, sf), zero_channels(spark, sf)).select("fov_key", "channel", "row", "col")


@query(
    "empty_cells",
    """SELECT DISTINCT user_id AS fov_key, CAST(json_extract_string(props, '$.k') AS BIGINT) // 15 AS cell_id FROM events
       ANTI JOIN (SELECT fov_key AS user_id, cell_id FROM v_mask WHERE cell_id <> 0) m ON events.user_id = m.user_id AND CAST(json_extract_string(props, '$.k') AS BIGINT) // 15 = m.cell_id""",
)
def empty_cells(spark, sf):
    m = b.mask(spark, sf)
    return ops.empty_cells(m.select("fov_key", "cell_id").distinct(), features.foreground(m))
