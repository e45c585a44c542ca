import json

import pytest

from spatialframes.operators import features, quality
from spatialframes.sources import archive, tables

SOURCES = ("standardized_source", "older_source")


def put(root, path, attributes=None, text=None):
    file = root / path / "zarr.json"
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(text if text is not None else json.dumps({"attributes": attributes or {}}))


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "arch.ive"
    put(root, "", {"schema_version": 8})
    put(root, "imc/lung/c/s/f1", {"modality": "imc", "tissue": " Lymph Node "})
    put(root, "imc/lung/c/s/f1/preprocessed", {"scale_factor": 2.0, "centroids": {"1": [10, 10], "2": [20.5, 20], "x": [0, 0]}})
    put(root, "imc/lung/c/s/f1/cell_types/annotations", {"standardized_source": {"CD4T": [1, 1, [5.0, 5.0]], "null": [2], "CD8T": [2.0, [10, 10, 10], "odd"]}, "older_source": {"Old": [9]}})
    put(root, "imc/lung/c/s/f1/marker_positivity", {"markers": ["CD3", "CD20"], "cell_types": ["T", "B"], "positivity_matrix": [[1, "?"], [0.5, 2]]})
    put(root, "flat", {"tissue": "liver"})
    put(root, "flat/preprocessed")
    put(root, "flat/cell_types/annotations", {"older_source": {"Tumor": [3]}})
    put(root, "flat/marker_positivity", {"markers": ["CD3"], "cell_types": ["T"], "positivity_matrix": []})
    put(root, "broken", text="{not json")
    put(root, "broken/preprocessed")
    put(root, "broken/cell_types/annotations", {"standardized_source": {"X": [1]}})
    put(root, "broken/marker_positivity", {"markers": ["CD3"], "cell_types": ["T"], "positivity_matrix": [[1, 0]]})
    put(root, "bare/preprocessed")
    return root


def test_discovery(spark, tree):
    keys = [r.fov_key for r in archive.discover_fovs(spark, str(tree)).collect()]
    assert sorted(keys) == ["bare", "broken", "flat", "imc/lung/c/s/f1"]


def test_metadata_tolerates_gaps_and_bad_json(spark, tree):
    got = {r.key: (r.domain, r.tissue, r.ct_names, r.has_mp) for r in archive.read_metadata(spark, str(tree), SOURCES).collect()}
    assert got == {
        "imc/lung/c/s/f1": ("IMC", "lymphnode", ["CD4T", "CD8T", "Old"], True),
        "flat": ("UNKNOWN", "liver", ["Tumor"], True),
        "broken": ("UNKNOWN", None, None, False),
        "bare": ("UNKNOWN", None, None, False),
    }


def test_annotations(spark, tree):
    rows = archive.read_annotations(spark, str(tree), SOURCES).collect()
    got = sorted((r.fov_key, r.source, r.ct_name, r.cell_id, r.row, r.col) for r in rows if r.fov_key == "imc/lung/c/s/f1" and r.cell_id is not None)
    assert got == [("imc/lung/c/s/f1", "standardized_source", t, i, None, None) for t, i in (("CD4T", 1), ("CD4T", 1), ("CD8T", 2))]
    assert [(r.ct_name, r.row, r.col) for r in rows if r.row is not None] == [("CD4T", 5.0, 5.0)]
    assert [(r.ct_name, r.source) for r in rows if r.fov_key == "flat"] == [("Tumor", "older_source")]


def test_fallback_only_where_nothing_was_found(spark, tree):
    resolved = archive.read_annotations(spark, str(tree), SOURCES)
    arrays = spark.createDataFrame([("flat", "Z", 1), ("bare", "Z", 1)], "fov_key string, ct_name string, cell_id bigint")
    out = archive.with_fallback(resolved, arrays)
    assert {(r.fov_key, r.ct_name) for r in out.where("source = 'cell_type_info'").collect()} == {("bare", "Z")}


def test_centroids_and_positivity(spark, tree):
    got = {(r.cell_id, r.c_row, r.scale_factor) for r in archive.read_centroids(spark, str(tree)).collect()}
    assert got == {(1, 10.0, 2.0), (2, 20.5, 2.0)}
    mp = archive.read_positivity(spark, str(tree))
    assert {(r.dataset_name, r.cell_type, r.marker, r.value) for r in mp.collect()} == {
        ("imc/lung/c/s/f1", "T", "CD3", "1"),
        ("imc/lung/c/s/f1", "T", "CD20", "?"),
        ("imc/lung/c/s/f1", "B", "CD3", "0.5"),
        ("imc/lung/c/s/f1", "B", "CD20", "2"),
    }
    vocab = spark.createDataFrame([("cell_type", "T", 0)], "kind string, name string, idx int")
    assert [(r.cell_type, r.n_datasets) for r in archive.unknown_rows(mp, vocab).collect()] == [("B", 1)]


def test_registry_and_aliases(spark, tmp_path):
    (tmp_path / "vocab.json").write_text(json.dumps({"cell_type_mapping": {"Tumor": 1, "Bcell": 0}, "all_standardized_channels": ["CD3", "PanCK"], "domains": []}, indent=1))
    vocab = archive.read_registry(spark, str(tmp_path / "vocab.json"))
    assert sorted(tuple(r) for r in vocab.collect()) == [("cell_type", "Bcell", 0), ("cell_type", "Tumor", 1), ("marker", "CD3", 0), ("marker", "PanCK", 1)]
    (tmp_path / "alias.yaml").write_text("# names\nKeratin: PanCK\n'CD3: e': CD3\n\nGhost: nothing\n\"pan-CK\": \"PanCK\"\n")
    rows = archive.read_aliases(spark, str(tmp_path / "alias.yaml"), vocab).orderBy("ord").collect()
    assert [(r.alias, r.target) for r in rows][0] == ("Keratin", "PanCK")
    assert ("pan-CK", "PanCK") in [(r.alias, r.target) for r in rows]
    assert "Ghost" not in [r.alias for r in rows]
    assert archive.inline_aliases(spark).where("alias = 'CgA'").first().target == "CHGA"


def test_fingerprint(spark, tree):
    one = archive.source_fingerprint(spark, str(tree))
    assert one == archive.source_fingerprint(spark, str(tree)) and len(one) == 16
    chunk = tree / "flat/preprocessed/raw/c/0"
    chunk.parent.mkdir(parents=True)
    chunk.write_bytes(b"abc")
    assert archive.source_fingerprint(spark, str(tree)) == one  # image chunks are not metadata
    full = archive.source_fingerprint(spark, str(tree), arrays=True)
    other = spark.createDataFrame([("bare",)], "fov_key string")
    assert archive.source_fingerprint(spark, str(tree), arrays=True, keys=other) != full
    label = tree / "flat/preprocessed/cell_type_info/cell_type/c/0"
    label.parent.mkdir(parents=True)
    label.write_bytes(b"abc")
    two = archive.source_fingerprint(spark, str(tree))
    label.write_bytes(b"abd")
    assert len({one, two, archive.source_fingerprint(spark, str(tree))}) == 3


def test_manifest_and_split_files(spark, tmp_path):
    doc = {"metadata": {"seed": 42, "stratify_by": ["modality"]}, "train": {"d": ["f0", "f1"]}, "val": {"d": ["f2"], "e": ["g"]}, "heldout": {"e": ["h"]}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    splits, meta = tables.read_manifest(spark, str(tmp_path / "m.json"))
    want = {("d", "f0", "train"), ("d", "f1", "train"), ("d", "f2", "val"), ("e", "g", "val"), ("e", "h", "heldout")}
    assert {(r.dataset_name, r.fov_name, r.split) for r in splits.collect()} == want
    assert {r.key: r.value for r in meta.collect()}["seed"] == "42"
    tables.write_splits(splits, str(tmp_path / "s"), {"seed": 42})
    again, meta = tables.read_splits(spark, str(tmp_path / "s"))
    assert {(r.dataset_name, r.fov_name, r.split) for r in again.collect()} == want
    assert {"seed", "created"} == {r.key for r in meta.collect()}
    del doc["heldout"]
    (tmp_path / "n.json").write_text(json.dumps(doc))
    assert tables.read_manifest(spark, str(tmp_path / "n.json"))[0].count() == 4


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_prediction_files(spark, tmp_path, fmt):
    df = spark.createDataFrame([("d", "f", 1, "A", [0.25, 0.75])], "dataset_name string, fov_name string, cell_index bigint, cell_type_actual string, probs array<double>")
    tables.write_predictions(df, ["A", "B"], str(tmp_path / "p"), fmt)
    back = spark.read.option("header", "true").format(fmt).load(str(tmp_path / "p"))
    assert back.columns == ["A", "B", "cell_type_actual", "cell_index", "dataset_name", "fov_name"]
    assert float(back.first().B) == 0.75


def test_contract_of_a_tree(spark, tmp_path):
    root = tmp_path / "arch"

    def good(key):
        put(root, key, {"modality": "imc"})
        put(root, f"{key}/preprocessed", {"channel_names": ["CD3", "CD20", "CD8"], "centroids": {"1": [1, 1]}, "scale_factor": 1.0})
        put(root, f"{key}/preprocessed/raw", text=json.dumps({"shape": [3, 8, 8], "data_type": "float32"}))
        put(root, f"{key}/preprocessed/mask", text=json.dumps({"shape": [8, 8], "data_type": "uint32"}))
        put(root, f"{key}/cell_types/annotations", {"standardized_source": {"T": [1]}})
        put(root, f"{key}/marker_positivity", {"markers": ["CD3"], "cell_types": ["T"], "positivity_matrix": [[1]]})

    for key in ("ok", "mask", "names", "attrs", "notes", "matrix"):
        good(key)
    put(root, "mask/preprocessed/mask", text=json.dumps({"shape": [8, 9], "data_type": "float32"}))
    put(root, "names/preprocessed", {"channel_names": ["CD3"], "centroids": {}, "scale_factor": 1.0})
    put(root, "attrs/preprocessed", {"channel_names": ["CD3", "CD20", "CD8"]})
    put(root, "notes/cell_types/annotations", {"older_source": {}})
    put(root, "matrix/marker_positivity", {"markers": ["CD3", "CD20"], "cell_types": ["T"], "positivity_matrix": [[1]]})
    meta = archive.read_contract(spark, str(root))
    vocab = spark.createDataFrame([("cell_type", "T", 0), ("marker", "CD3", 0), ("marker", "CD20", 1)], "kind string, name string, idx int")
    frame = lambda *xs: spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "name string, idx int")
    required = spark.createDataFrame([("ok", "CD3"), ("names", "CD20"), ("absent", "CD3")], "fov_key string, marker string")
    splits = spark.createDataFrame([("ok", "ok", "train"), ("gone", "gone", "val")], "dataset_name string, fov_name string, split string")
    out = quality.validate(meta, vocab, frame("T", "B"), frame("CD20", "CD3"), required, splits)
    assert {(r.check, r.key) for r in out.collect()} == {
        ("mask_type", "mask"),
        ("extent", "mask"),
        ("name_count", "names"),
        ("missing_centroids", "attrs"),
        ("missing_scale_factor", "attrs"),
        ("missing_source", "notes"),
        ("matrix_shape", "matrix"),
        ("missing_from_mapping", "B"),
        ("marker_first_out_of_order", "CD20"),
        ("marker_missing", "names"),
        ("sentinel_absent", "absent"),
        ("absent_from_archive", "gone/gone"),
    }


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path, capsys):
    n = spark.range(4096)
    pixels = n.selectExpr("'f' AS fov_key", "'c' AS channel", "CAST(id DIV 64 AS int) AS row", "CAST(id % 64 AS int) AS col", "CAST(id AS double) AS value")
    mask = n.selectExpr("'f' AS fov_key", "CAST(id DIV 64 AS int) AS row", "CAST(id % 64 AS int) AS col", "id % 9 AS cell_id")
    tables.write_bucketed(pixels, "b_pixels", str(tmp_path / "p"), 4, ["fov_key", "row", "col"])
    tables.write_bucketed(mask, "b_mask", str(tmp_path / "m"), 4, ["fov_key", "row", "col"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = features.cell_means(spark.table("b_pixels"), spark.table("b_mask"))
        assert out.count() == 8
        out.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # only the final aggregate
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_pixels")
        spark.sql("DROP TABLE b_mask")


def test_each_file_is_read_once(spark, tree):
    for read in (archive.read_metadata, archive.read_contract):
        plan = read(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and "Join" not in plan


def test_documents_are_written_where_they_say(spark, tmp_path):
    rows = [(f"deep/f{i}/preprocessed/zarr.json", json.dumps({"attributes": {"scale_factor": float(i)}})) for i in range(20)]
    root = (tmp_path / "made").as_uri()
    assert archive.write_documents(spark.createDataFrame(rows, "rel string, value string").repartition(4), root) == 20
    assert {r.fov_key: r.scale_factor for r in archive.read_contract(spark, root).collect()} == {f"deep/f{i}": float(i) for i in range(20)}


def test_a_wide_tree_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    from spatialframes.sources import archive

    monkeypatch.setattr(archive, "_WIDE", 4)
    keys = [f"set {n % 2}/deep é/f{n}" for n in range(6)] + ["flat"]
    for key in keys:
        for part in ("", "preprocessed", "marker_positivity", "_hidden", ".tmp/preprocessed"):
            folder = tmp_path / key / part
            folder.mkdir(parents=True, exist_ok=True)
            (folder / "zarr.json").write_text('{"attributes": {"modality": "codex", "markers": ["m"], "cell_types": ["t"], "positivity_matrix": [["1"]]}}')
    assert sorted(r.fov_key for r in archive.discover_fovs(spark, str(tmp_path)).collect()) == sorted(keys)
    out = archive.read_metadata(spark, str(tmp_path))
    # no file index of the tree: the driver has seen none of its paths
    assert not [f for f in out.inputFiles() if f.endswith("zarr.json")]
    assert {(r.key, r.domain, r.has_mp) for r in out.collect()} == {(k, "CODEX", True) for k in keys}
    assert sorted(r.dataset_name for r in archive.read_positivity(spark, str(tmp_path)).collect()) == sorted(keys)
    assert archive.discover_fovs(spark, str(tmp_path / "flat" / "preprocessed")).count() == 0
