import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframes.operators import annotations as ops

CELLS = "fov_key string, cell_id bigint, c_row double, c_col double"
MARKS = "fov_key string, pos bigint, row double, col double"


def cells(spark, *points):
    return spark.createDataFrame([("f", i + 1, float(r), float(c)) for i, (r, c) in enumerate(points)], CELLS)


def marks(spark, *points):
    return spark.createDataFrame([("f", i, float(r), float(c)) for i, (r, c) in enumerate(points)], MARKS)


@pytest.mark.parametrize(
    ("places", "target", "tol", "cell"),
    [
        ([(100, 100)], (101.3, 100), 1.5, 1),
        ([(100, 100)], (101.6, 100), 1.5, None),
        ([(100, 100)], (101.3, 100), 1.0, None),
        ([(50, 50)], (50, 50), 1.5, 1),
        ([(100, 100), (105, 100)], (100.5, 100), 1.5, 1),
        ([(100, 100)], (101.5, 100), 1.5, None),  # at the tolerance
        ([(1.499, 0)], (1.501, 0), 1.5, 1),  # across a grid edge
        ([(-0.7, -0.7)], (0.2, 0.2), 1.5, 1),  # across the origin
        ([(2, 2), (2, 2)], (2, 2), 1.5, 1),  # equal places: the smaller id
    ],
)
def test_nearest(spark, places, target, tol, cell):
    out = ops.nearest_centroid(marks(spark, target), cells(spark, *places), tol)
    assert [r.cell_id for r in out.collect()] == [cell]


@pytest.mark.parametrize("crowd", [64, 3])
def test_crowded_places_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(ops, "_DENSE", crowd)
    rng = np.random.default_rng(4)
    places = np.concatenate([rng.normal(10, 0.2, (900, 2)), rng.uniform(-5, 30, (200, 2)), np.full((80, 2), 10.0)])
    targets = np.concatenate([rng.normal(10, 0.6, (80, 2)), rng.uniform(-5, 30, (120, 2)), np.full((30, 2), 10.0)])
    c, m = cells(spark, *places), marks(spark, *targets)
    apart = np.abs(targets[:, None] - places[None])
    distance = np.sqrt((apart**2).sum(-1))
    got = {r.pos: r.cell_id for r in ops.nearest_centroid(m, c).collect()}
    assert got == {i: int(d.argmin()) + 1 if d.min() < 1.5 else None for i, d in enumerate(distance)}
    near = (apart < 0.5).all(-1)
    got = {r.pos: r.cell_id for r in ops.nearest_box(m, c).collect()}
    assert got == {i: int(n.argmax()) + 1 if n.any() else None for i, n in enumerate(near)}


def test_no_pairwise_join_in_the_plan(spark, capsys):
    ops.nearest_centroid(marks(spark, (1, 1)), cells(spark, (1, 1))).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scaling(spark):
    fovs = spark.createDataFrame([("f", 2.0)], "fov_key string, scale_factor double")
    out = ops.nearest_centroid(ops.scale_marks(marks(spark, (50, 50)), fovs), cells(spark, (100, 100)))
    assert out.first().cell_id == 1


@pytest.mark.parametrize(
    ("entries", "kept", "counts"),
    [
        ([("CD4T", 1), ("CD4T", 1), ("CD8T", 2)], {(1, "CD4T"), (2, "CD8T")}, (2, 1, 0)),
        ([("CD4T", 1), ("Epithelial", 1), ("Epithelial", 1), ("CD8T", 2)], {(2, "CD8T")}, (1, 0, 1)),
    ],
)
def test_collapse(spark, entries, kept, counts):
    df = spark.createDataFrame([("f", i, t, p) for p, (t, i) in enumerate(entries)], "fov_key string, cell_id bigint, ct_name string, pos int")
    assert {(r.cell_id, r.ct_name) for r in ops.annotation_collapse(df).collect()} == kept
    assert tuple(ops.collapse_counters(df).first())[1:] == counts


def test_by_id_keeps_the_misses(spark):
    df = spark.createDataFrame([("f", 1, "T"), ("f", 9, "T")], "fov_key string, cell_id bigint, ct_name string")
    out = ops.ann_by_id(df, cells(spark, (1, 1)))
    assert {r.cell_id: r.matched for r in out.collect()} == {1: True, 9: False}


def test_type_lists(spark):
    rows = spark.createDataFrame([("lung", "T_cell"), ("lung", "Weird"), ("lung", "B_cell"), ("skin", "Weird"), (None, "T_cell")], "tissue string, name string")
    vocab = spark.createDataFrame([("T_cell",), ("B_cell",)], "name string")
    assert {r.tissue: r.ct_names for r in ops.tissue_types(rows, vocab).collect()} == {"lung": ["B_cell", "T_cell"]}
    fovs = spark.createDataFrame([("d1", ["T_cell", "Weird"])], "key string, ct_names array<string>")
    assert ops.dataset_types(fovs).first().ct_names == ["T_cell", "Weird"]


def test_canonical_metadata(spark):
    known = ops.dataset_canonical(spark)
    df = spark.createDataFrame([("codex_colon",), ("mibi_decidua",)], "dataset_key string")
    got = {r.dataset_key: (r.tissue, r.modality) for r in ops.canonical_metadata(df, known).collect()}
    assert got == {"codex_colon": ("colon", "codex"), "mibi_decidua": ("uterus", "mibi")}
    with pytest.raises(ValueError, match="mibi_decidua"):
        ops.canonical_metadata(df, known, strict=True)
    ops.canonical_metadata(df.where("dataset_key = 'codex_colon'"), known, strict=True)


def test_ids_and_positions_resolve_together(spark):
    grid = cells(spark, (10, 10), (20, 20), (30, 30))
    rows = [("f", "CD4T", 0, 1, None, None), ("f", "CD4T", 1, None, 5.2, 5.0), ("f", "CD8T", 0, None, 10.0, 10.0), ("f", "Epi", 0, 2, None, None), ("f", "Bcell", 0, 9, None, None), ("f", "Bcell", 1, None, 40.0, 40.0), ("f", "Odd", 0, 3, None, None)]
    notes = spark.createDataFrame(rows, "fov_key string, ct_name string, pos int, cell_id bigint, row double, col double")
    fovs = spark.createDataFrame([("f", 2.0, "IMC", "lung")], "fov_key string, scale_factor double, domain string, tissue string")
    labels, attempts = ops.resolve_annotations(notes, grid, fovs)
    assert {(r.cell_id, r.ct_name, r.duplicates) for r in labels.collect()} == {(1, "CD4T", 1), (3, "Odd", 0)}
    lost = attempts.where("cell_id IS NULL").groupBy("kind").count()
    assert {r.kind: r["count"] for r in lost.collect()} == {"id": 1, "centroid": 1}
    types = spark.createDataFrame([("CD4T",), ("CD8T",)], "name string")
    index = ops.cell_index(labels, grid, fovs, types).collect()
    assert [(r.dataset_name, r.fov_name, r.domain, r.cell_id, r.ct_label, r.c_row) for r in index] == [("f", "f", "IMC", 1, "CD4T", 10.0)]


def test_canonical_names_must_be_registered(spark):
    listed = spark.createDataFrame([("a", "lung", "imc", "lung", "imc", True), ("b", "gut", "imc", "colon", "imc", False)], "dataset_key string, tissue_paper string, modality_paper string, tissue string, modality string, is_direct boolean")
    data = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset_key string")
    vocab = spark.createDataFrame([("tissue", "lung"), ("domain", "imc"), ("tissue", "imc")], "kind string, name string")
    got = lambda **more: sorted((r["check"], r["key"], r["detail"]) for r in ops.canonical_violations(data, listed, **more).collect())
    assert got() == [("not_listed", "c", "")]
    assert got(vocab=vocab) == [("not_listed", "c", ""), ("unregistered_tissue", "b", "colon")]
    assert got(strict=True) == [("not_listed", "c", ""), ("substituted", "b", "gut, imc")]
    assert ops.canonical_metadata(data.where("dataset_key = 'a'"), listed, True, vocab).first()["tissue"] == "lung"
    with pytest.raises(ValueError, match="b: unregistered_tissue colon"):
        ops.canonical_metadata(data.where("dataset_key = 'b'"), listed, vocab=vocab)
