import pytest
from pyspark.sql import functions as F

from spatialframes.operators import quality as ops

META = "fov_key string, raw_shape array<bigint>, mask_shape array<bigint>, mask_type string"


def checks(df):
    return {(r.check, r.key) for r in df.collect()}


@pytest.mark.parametrize(
    ("row", "failed"),
    [
        (([3, 8, 8], [8, 8], "uint32"), set()),
        (([3, 8, 8], [8, 8], None), set()),
        ((None, [8, 8], "uint32"), {"missing_raw"}),
        (([3, 8, 8], None, None), {"missing_mask"}),
        (([8, 8], [8, 8], "uint32"), {"raw_rank"}),
        (([3, 8, 8], [8], "uint32"), {"mask_rank"}),
        (([3, 8, 9], [8, 8], "uint32"), {"extent"}),
        (([3, 8, 8], [8, 8], "float32"), {"mask_type"}),
    ],
)
def test_shapes(spark, row, failed):
    out = ops.shape_contract(spark.createDataFrame([("f", *row)], META))
    assert checks(out) == {(c, "f") for c in failed}


def test_channels(spark):
    df = spark.createDataFrame([("ok", [3], ["a", "b", "c"]), ("two", [2], ["a", "b"]), ("off", [3], ["a"]), ("none", [3], None)], "fov_key string, raw_shape array<bigint>, channel_names array<string>")
    assert checks(ops.channel_contract(df)) == {("few_channels", "two"), ("name_count", "off"), ("name_count", "none")}
    assert ("few_channels", "two") not in checks(ops.channel_contract(df, allow_two=True))


def test_attributes_and_matrix(spark):
    df = spark.createDataFrame([("ok", "{}", 1.0, True, "{}"), ("bare", None, None, True, None), ("plain", "{}", 1.0, False, None)], "fov_key string, centroids string, scale_factor double, has_annotations boolean, source string")
    assert checks(ops.attr_contract(df)) == {("missing_centroids", "bare"), ("missing_scale_factor", "bare"), ("missing_source", "bare")}
    rows = [
        ("ok", True, ["m"], ["t", "u"], [["1"], ["0"]]),
        ("turned", True, ["m"], ["t", "u"], [["1", "0"]]),
        ("empty", True, ["m"], ["t"], []),
        ("gone", True, None, None, None),
        ("no", False, None, None, None),
    ]
    m = spark.createDataFrame(rows, "fov_key string, has_mp boolean, markers array<string>, cell_types array<string>, matrix array<array<string>>")
    assert checks(ops.matrix_contract(m)) == {("matrix_shape", "turned"), ("matrix_not_2d", "empty"), ("missing_markers", "gone"), ("missing_matrix", "gone")}


@pytest.mark.parametrize(
    ("items", "failed"),
    [
        ([("Bcell", 0), ("Tumor", 1)], set()),
        ([("Bcell", 0), ("Tumor", 2)], {"index_not_contiguous"}),
        ([("Bcell", 0), ("Tumor", 0)], {"index_not_unique", "index_not_contiguous"}),
        ([("Bcell", 0), ("Bcell", 1)], {"name_not_unique"}),
    ],
)
def test_vocabulary(spark, items, failed):
    df = spark.createDataFrame([("cell_type", n, i) for n, i in items], "kind string, name string, idx int")
    assert {c for c, _ in checks(ops.vocab_contract(df))} == failed


def test_first_usable_channel_wins(spark):
    rows = [
        ("f", 0, "CD3-dim", "CD3", True),  # all zero does not claim the marker
        ("f", 1, "CD3", "CD3", False),
        ("f", 2, "CD3e", "CD3", False),
        ("f", 3, "CD3-off", "CD3", True),  # after a kept one it is a duplicate
        ("f", 4, "DAPI", None, False),
        ("g", 0, "CD3", "CD3", True),
    ]
    df = spark.createDataFrame(rows, "fov_key string, pos int, channel string, marker string, all_zero boolean")
    got = {(r.fov_key, r.channel): r.reason for r in ops.channel_mask(df).collect()}
    assert got == {("f", "CD3-dim"): "all_zero", ("f", "CD3"): None, ("f", "CD3e"): "duplicate", ("f", "CD3-off"): "duplicate", ("f", "DAPI"): "not_in_registry", ("g", "CD3"): "all_zero"}
    kept = ops.channel_mask(df).where("kept")
    assert checks(ops.panel_cap(kept, df, cap=0)) == {("too_many", "f"), ("no_channel", "g")}


def test_negative_channels_are_not_empty(spark):
    df = spark.createDataFrame([("f", "neg", -1.0), ("f", "zero", 0.0), ("f", "low", -1.0), ("f", "low", 0.0)], "fov_key string, channel string, value double")
    assert {r.channel for r in ops.zero_channels(df).collect()} == {"zero", "low"}


def test_order_and_names(spark):
    frame = lambda *xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "name string, idx int")
    out = {(r.problem, r.name) for r in ops.order_diff(frame("a", "b", "c"), frame("a", "c", "d")).collect()}
    assert out == {("missing", "b"), ("extra", "d"), ("first_out_of_order", "b")}
    assert ops.order_diff(frame("a", "b"), frame("a", "b")).count() == 0
    diff = ops.mapping_vs_declared(frame("a", "b"), frame("b", "c"))
    assert {(r.name, r.problem) for r in diff.collect()} == {("a", "extra_in_mapping"), ("c", "missing_from_mapping")}


def test_gates(spark):
    df = spark.range(200).withColumn("bad", F.col("id") < 2)
    assert ops.failure_gate(df, F.col("bad")).first().abort is False
    assert ops.failure_gate(df, F.col("id") < 3).first().abort is True
    assert ops.failure_gate(df.limit(0), F.col("bad")).first().abort is False
    tries = spark.createDataFrame([("f", "id", i if i > 0 else None) for i in range(20)] + [("g", "centroid", i or None) for i in range(10)], "fov_key string, kind string, cell_id bigint")
    assert [(r.fov_key, r.drops) for r in ops.annotation_drop_rate(tries).collect()] == [("g", 1)]
    with pytest.raises(ValueError, match="and more"):
        ops.raise_if_any(df, 3)
    ops.raise_if_any(df.limit(0))


def test_examples(spark):
    df = spark.createDataFrame([("d", f"f{i}") for i in range(7)] + [("e", "x")], "d string, f string")
    got = {r.d: r.examples for r in ops.example_list(df, ["d"], "f").collect()}
    assert got == {"d": "f0, f1, f2, f3, f4, ... (+2 more)", "e": "x"}


def test_marker_order_diff_numbers_the_names_of_all_parts(spark, tmp_path):
    from spatialframes.plans.names import marker_order_diff

    parts = spark.range(300).selectExpr("concat('part ', lpad(id, 4, '0')) AS p_name", "'Brand#11' AS p_brand", "concat('G', id % 3) AS p_type")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    out = {(r.problem, r.name, r.idx) for r in marker_order_diff(spark, str(tmp_path)).collect()}
    assert out == {("missing", "part 0009", 1010), ("first_out_of_order", "part 0005", 1006)}


def test_field_report_deals_rows_by_their_number(spark, monkeypatch):
    from spatialframes import session

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    channels = spark.range(600).selectExpr("id % 100 AS fov_key", "CASE WHEN id < 200 THEN 'CD3' WHEN id < 300 THEN 'DAPI-1' ELSE concat('x', id div 300) END AS channel")
    fovs = spark.range(200).selectExpr("id % 100 AS fov_key", "concat('m', id % 2) AS modality", "CAST(null AS string) AS tissue")
    out = ops.fov_report(channels, spark.createDataFrame([("CD3",)], "name string"), fovs)
    # 600 rows in tasks of about ten, whatever adaptive execution would merge
    assert len(out.collect()) == 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "60), REPARTITION_BY_NUM" in plan
    got = {(r.modality, r.num_fovs, r.num_two_channel, r.num_unknown_channels) for r in out.collect()}
    assert got == {(None, 100, 0, 100), ("m0", 50, 0, 50), ("m1", 50, 0, 50)}
    two = ops.fov_report(channels.where("channel <> 'x1'"), spark.createDataFrame([("CD3",)], "name string"), fovs)
    assert {(r.modality, r.num_two_channel) for r in two.collect()} == {(None, 100), ("m0", 50), ("m1", 50)}
