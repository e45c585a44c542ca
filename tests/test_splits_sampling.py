import math

import pytest
from pyspark.sql import functions as F

from spatialframes.functions import ordering
from spatialframes.operators import sampling, splits

CELLS = "dataset_name string, fov_name string, domain string, tissue string, cell_id bigint, ct_label string"


def cells(spark, fovs, labels=("A", "B")):
    rows = [(d, f, m, t, i * 100 + j, c) for i, (d, f, m, t) in enumerate(fovs) for j, c in enumerate(labels)]
    return spark.createDataFrame(rows, CELLS)


def sides(df):
    return {(r.dataset_name, r.fov_name): r.split for r in df.collect()}


def test_both_strata_on_both_sides(spark):
    df = cells(spark, [("d", f"f{i}", "IMC" if i < 2 else "MIBI", "lung") for i in range(4)])
    out = splits.stratified_split(df, ["domain", "tissue"], 0.5)
    got = {(r.domain, r.split) for r in out.collect()}
    assert got == {("IMC", "train"), ("IMC", "val"), ("MIBI", "train"), ("MIBI", "val")}


def test_a_lone_field_and_a_rare_class_go_to_train(spark):
    df = cells(spark, [("d", f"f{i}", "IMC", "lung") for i in range(6)] + [("d", "lone", "CODEX", "liver")])
    rare = df.limit(1).select("dataset_name", F.lit("f3").alias("fov_name"), "domain", "tissue", F.lit(999).cast("bigint").alias("cell_id"), F.lit("Rare").alias("ct_label"))
    out = sides(splits.stratified_split(df.unionByName(rare), ["domain", "tissue"], 0.5))
    assert out["d", "lone"] == "train" and out["d", "f3"] == "train"
    assert set(out.values()) == {"train", "val"} and len(out) == 7


def test_global_split_sizes(spark):
    df = cells(spark, [("d", f"f{i}", "IMC", "lung") for i in range(4)])
    assert sorted(sides(splits.global_split(df, 0.75)).values()) == ["train", "train", "train", "val"]
    only = cells(spark, [("d", f"f{i}", "IMC", "lung") for i in range(4)]).withColumn("ct_label", F.col("fov_name"))
    assert set(sides(splits.global_split(only, 0.25)).values()) == {"train"}  # all forced


def test_patients_stay_whole(spark):
    fovs = [("d", f"x_Patient{p}-{s}", "IMC", "lung") for p in range(6) for s in range(2)]
    out = splits.stratified_split(cells(spark, fovs), ["domain"], 0.5, by_patient=True)
    assert splits.patient_leaks(out).count() == 0
    assert {r.split for r in out.collect()} == {"train", "val"}


def test_split_is_reproducible_and_seeded(spark):
    df = cells(spark, [("d", f"f{i}", "IMC", "lung") for i in range(40)])
    one, two = (sides(splits.stratified_split(df, ["domain"], 0.5, seed=1)) for _ in range(2))
    assert one == two != sides(splits.stratified_split(df, ["domain"], 0.5, seed=2))


def test_inner_validation(spark):
    one = cells(spark, [("d", "f", "IMC", "lung")])
    assert set(sides(splits.inner_val(one, 0.5)).values()) == {"train"}
    many = cells(spark, [("d", f"f{i}", "IMC", "lung") for i in range(5)])
    assert set(sides(splits.inner_val(many, 0.0)).values()) == {"train"}
    assert list(sides(splits.inner_val(many, 0.01)).values()).count("inner_val") == 1
    assert list(sides(splits.group_shuffle(many, 0.25)).values()).count("test") == 2


def test_second_stage(spark):
    val = spark.createDataFrame([("a", f"f{i}") for i in range(5)] + [("b", "g0"), ("b", "g1"), ("c", "h")], "dataset_name string, fov_name string")
    out = splits.val_test_split(val, 0.3).groupBy("dataset_name", "split").count()
    assert {(r.dataset_name, r.split): r["count"] for r in out.collect()} == {("a", "val"): 3, ("a", "test"): 2, ("b", "val"): 1, ("b", "test"): 1, ("c", "val"): 1}
    single = spark.createDataFrame([(f"d{i}", f"d{i}") for i in range(10)], "dataset_name string, fov_name string")
    assert list(sides(splits.val_test_split(single, 0.3)).values()).count("test") == 3


def manifest(spark, rows):
    return spark.createDataFrame(rows, "dataset_name string, fov_name string, split string")


@pytest.mark.parametrize(
    ("rows", "check"),
    [
        ([("d", "f0", "train"), ("d", "f0", "val"), ("d", "f1", "val")], "train_val_overlap"),
        ([("d", "f0", "train"), ("d", "f1", "val"), ("d", "f1", "heldout")], "heldout_overlap"),
        ([("d", "f0", "train"), ("d", "f1", "val"), ("d", "gone", "val")], "split_not_live"),
        ([("d", "f0", "train"), ("d", "f1", "val"), ("d", "gone", "heldout")], "heldout_not_live"),
        ([("d", "f0", "train")], "live_not_in_split"),
    ],
)
def test_strict_load_fails(spark, rows, check):
    live = cells(spark, [("d", "f0", "IMC", "lung"), ("d", "f1", "IMC", "lung")])
    with pytest.raises(ValueError, match=check):
        splits.load_split(live, manifest(spark, rows))
    splits.load_split(live, manifest(spark, rows), strict=False).count()


def test_clean_load(spark):
    live = cells(spark, [("d", f"f{i}", "IMC", "lung") for i in range(3)])
    out = splits.load_split(live, manifest(spark, [("d", "f0", "train"), ("d", "f1", "val"), ("d", "f2", "heldout")]))
    assert {(r.fov_name, r.split) for r in out.collect()} == {("f0", "train"), ("f1", "val"), ("f2", "heldout")}


def test_metadata_comparison(spark):
    kv = lambda **kw: spark.createDataFrame(list(kw.items()), "key string, value string")
    saved = kv(max_channels="80", num_cell_types="51", zarr_path="/a")
    current = kv(max_channels="80", num_cell_types="50", zarr_path="/b", archive_fingerprint="x", num_marker_channels=None)
    got = {r.key: (r.problem, r.advisory) for r in splits.meta_diff(saved, current).collect()}
    assert got == {"num_cell_types": ("mismatch", False), "zarr_path": ("mismatch", True), "archive_fingerprint": ("missing", True)}


def test_feature_split_reasons(spark):
    f = lambda *xs: spark.createDataFrame([(x, x) for x in xs], "dataset_name string, fov_name string")
    m = manifest(spark, [(x, x, "train") for x in ("ok", "gone", "skipped", "bare")] + [("held", "held", "heldout")])
    out = splits.feature_split_contract(m, f("ok", "skipped", "bare", "held", "new"), f("ok", "bare", "held", "new"), f("ok", "new"))
    assert {(r.check, r.key) for r in out.collect()} == {("not_in_archive", "gone/gone"), ("excluded_by_keep", "skipped/skipped"), ("no_features", "bare/bare"), ("absent_from_split", "new/new")}


# --- weights and draws -------------------------------------------------------------------------------------------


def labelled(spark, **counts):
    rows = [(f"{c}{i}", c, f"f{i % 7}") for c, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "cell_id string, ct_label string, fov_name string").withColumn("dataset_name", F.lit("d"))


def test_weights(spark):
    got = {r.ct_label: r.weight for r in sampling.class_weights(labelled(spark, T=5000, B=100), "ct_label").collect()}
    assert got == {"T": pytest.approx(math.sqrt(5100 / 5000)), "B": pytest.approx(math.sqrt(5100 / 1000))}
    small = labelled(spark, T=10, B=1)
    assert len({r.weight for r in sampling.class_weights(small, "ct_label").collect()}) == 1
    inverse = {r.ct_label: r.weight for r in sampling.class_weights(small, "ct_label", "inverse").collect()}
    assert inverse == {"T": pytest.approx(1.1), "B": pytest.approx(11.0)}
    mean = sampling.with_weights(small, "ct_label", floor=1, normalize=True).agg(F.avg("weight")).first()[0]
    assert mean == pytest.approx(1.0)
    with pytest.raises(ValueError, match="scheme"):
        sampling.class_weights(small, "ct_label", "cube")


def test_cap_and_pad(spark):
    df = labelled(spark, T=50, B=3)
    capped = sampling.cap_per_class(df, "ct_label", 10, ["cell_id"])
    assert {r.ct_label: r["count"] for r in capped.groupBy("ct_label").count().collect()} == {"T": 10, "B": 3}
    again = sampling.cap_per_class(df, "ct_label", 10, ["cell_id"])
    assert capped.exceptAll(again).count() == 0
    assert sampling.cap_per_class(df, "ct_label", None, ["cell_id"]) is df
    padded = sampling.class_pad(df.where("ct_label = 'T'"), df, "ct_label", "cell_id")
    assert [r.cell_id for r in padded.where("ct_label = 'B'").collect()] == ["B0"]


@pytest.mark.parametrize("slice_above", [1_000_000, 100])
def test_draws_follow_the_weights_even_with_one_heavy_row(spark, monkeypatch, slice_above):
    monkeypatch.setattr(ordering, "_SLICE_ABOVE", slice_above)
    rows = [("heavy", 1000.0)] + [(f"r{i}", 1.0) for i in range(2000)] + [("zero", 0.0)]
    df = spark.createDataFrame(rows, "cell_id string, weight double")
    out = sampling.weighted_draw(df, "weight", 6000, ["cell_id"])
    assert out.count() == 6000 and out.select("draw").distinct().count() == 6000
    heavy = out.where("cell_id = 'heavy'").count()
    assert abs(heavy / 6000 - 1 / 3) < 0.03
    assert out.where("cell_id = 'zero'").count() == 0
    assert sampling.weighted_draw(df, "weight", 0, ["cell_id"]).count() == 0


def test_field_order(spark):
    df = labelled(spark, T=60, B=10).select("dataset_name", "fov_name", "cell_id")
    key = ["dataset_name", "fov_name"]

    def order(**kw):
        return [r.fov_name for r in sampling.fov_grouped_order(df, key, ["cell_id"], **kw).orderBy("position").collect()]

    one = order()
    runs = [f for i, f in enumerate(one) if i == 0 or one[i - 1] != f]
    assert len(runs) == len(set(runs)) == 7 and len(one) == 70
    assert one == order() and one != order(epoch=1)
    capped = sampling.fov_sequential(df, key, ["cell_id"], cap=15)
    assert sorted(r.position for r in capped.collect()) == list(range(15))
    assert sampling.fov_sequential(df.limit(0), key, ["cell_id"]).count() == 0


@pytest.mark.parametrize("scheme", ["sqrt", "equal", "none"])
def test_epoch(spark, scheme):
    df = labelled(spark, T=200, B=20)
    inner = df.select("dataset_name", "fov_name").distinct().where("fov_name <> 'f0'")
    out = sampling.balanced_epoch(df, inner, "ct_label", ["cell_id"], n=40, scheme=scheme, cap=30)
    assert out.count() == 40 and out.where("fov_name = 'f0'").count() == 0
    assert sorted(r.position for r in out.collect()) == list(range(40))


def test_one_pass_without_a_budget(spark):
    df = labelled(spark, T=20)
    out = sampling.balanced_epoch(df, df, "ct_label", ["cell_id"], scheme="none")
    assert sorted(r.cell_id for r in out.collect()) == sorted(f"T{i}" for i in range(20))


def panel(spark, n):
    return spark.createDataFrame([(1, f"c{i}") for i in range(n)], "cell_id int, channel string")


@pytest.mark.parametrize(("n", "left"), [(3, 3), (4, 3), (7, 5), (30, 27)])
def test_channel_dropout(spark, n, left):
    assert sampling.drop_channels(panel(spark, n), ["cell_id"]).count() == left


@pytest.mark.parametrize(("n", "ratio", "keep", "masked"), [(7, 0.3, 1, 2), (3, 0.5, 2, 1), (1, 0.5, 1, 0), (2, 0.1, 1, 1)])
def test_masking(spark, n, ratio, keep, masked):
    assert sampling.mask_markers(panel(spark, n), ["cell_id"], ratio=ratio, keep=keep).where("masked").count() == masked


def test_mask_targets_divide_by_lit_pixels(spark):
    pixels = [("f", f"c{k}", r, c, 2.0 if k == 0 and r < 2 and c < 2 else 0.0) for k in range(2) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(pixels, "fov_key string, channel string, row int, col int, value double")
    mask = spark.createDataFrame([("f", r, c, 1) for r in range(4) for c in range(4)], "fov_key string, row int, col int, cell_id bigint")
    assert {r.channel: r.target for r in sampling.mask_targets(df, mask).collect()} == {"c0": 2.0, "c1": 0.0}
