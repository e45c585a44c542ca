import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframes.operators import composition as ops
from spatialframes.operators import features


def test_composition_and_gates(spark):
    cells = spark.createDataFrame([("f", t) for t, n in (("Mast", 3), ("Bcell", 5), ("Epi", 2)) for _ in range(n)], "fov_key string, name string")
    shares = {r.name: r.share for r in ops.composition(cells).collect()}
    assert shares == {"Mast": 0.3, "Bcell": 0.5, "Epi": 0.2}
    coarse = spark.createDataFrame([("Mast", "Myeloid"), ("Bcell", "Lymphocyte")], "fine string, coarse string")
    lineages = ops.lineage_composition(cells, coarse)
    assert {r.lineage: r.n for r in lineages.collect()} == {"Myeloid": 3, "Lymphocyte": 5, "Other": 2}
    expected = spark.createDataFrame(
        [("f", "Epithelial", "present"), ("f", "Epithelial", "dominant"), ("f", "Lymphocyte", "implausible"), ("f", "Myeloid", "absent"), ("f", "Nerve", "absent")],
        "fov_key string, lineage string, role string",
    )
    got = {(r.check, r.detail) for r in ops.plausibility(expected, lineages).collect()}
    assert got == {("expected_missing", "Epithelial"), ("no_dominant", ""), ("implausible_majority", "Lymphocyte"), ("must_be_absent", "Myeloid")}
    markers = spark.createDataFrame([("Mast", "Tryptase"), ("Mast", "CD117"), ("Bcell", "CD20"), ("Epi", "PanCK")], "name string, marker string")
    panel = spark.createDataFrame([("f", "CD20")], "fov_key string, marker string")
    caveats = spark.createDataFrame([("f", "Epi")], "fov_key string, name string")
    flags = {r.name: r.kind for r in ops.unsupported_types(ops.composition(cells), markers, panel, caveats).collect()}
    assert flags == {"Mast": "candidate", "Epi": "caveat"}


def test_expectations_read_inputs_only(spark):
    fovs = spark.createDataFrame([("f", "gut")], "fov_key string, tissue string")
    biology = spark.createDataFrame([("gut", "Epithelial", "present"), ("gut", "Lymphocyte", "present"), ("gut", "Nerve", "absent"), ("gut", "Ghost", "absent")], "tissue string, lineage string, role string")
    panel = spark.createDataFrame([("f", "PanCK")], "fov_key string, marker string")
    marks = spark.createDataFrame([("Epithelial", "PanCK"), ("Lymphocyte", "CD3")], "lineage string, marker string")
    classes = spark.createDataFrame([("a", "Epithelial"), ("b", "Lymphocyte"), ("c", "Nerve")], "name string, lineage string")
    out = ops.expectations(fovs, biology, panel, marks, classes)
    assert {(r.lineage, r.role) for r in out.collect()} == {("Epithelial", "present"), ("Nerve", "absent")}


def test_delta(spark):
    frame = lambda *xs: spark.createDataFrame([("f", n, s) for n, s in xs], "fov_key string, lineage string, share double")
    wanted = spark.createDataFrame([("A", -1), ("B", 1), ("C", -1)], "lineage string, direction int")
    out = ops.config_delta(frame(("A", 0.6), ("B", 0.4)), frame(("A", 0.5), ("B", 0.3), ("C", 0.2)), wanted)
    assert tuple(ops.delta_verdict(out).first()) == ("f", 1, 2)


def test_channel_scan(spark):
    values = np.array([0.0, 0, 1, 2, 10])
    df = spark.createDataFrame([("f", "c", float(v)) for v in values], "fov_key string, channel string, value double")
    r = ops.channel_scan(df).first()
    assert (r.positive_share, r.median, r.p99) == (0.6, 1.0, pytest.approx(np.percentile(values, 99)))
    assert r.dynamic_range == pytest.approx(r.p99)


def test_absent_is_not_zero(spark):
    panel = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a")], "fov_key string, marker string")
    values = spark.createDataFrame([("f", 1, "a", 2.0), ("g", 2, "a", 0.0)], "fov_key string, cell_id bigint, marker string, mean_value double")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "name string, idx int")
    cells = values.select("fov_key", "cell_id")
    long = {(r.cell_id, r.marker): r.mean_value for r in features.fill_absent(values, cells, panel, vocab, None).collect()}
    assert long == {(1, "a"): 2.0, (1, "b"): 0.0, (1, "c"): None, (2, "a"): 0.0, (2, "b"): None, (2, "c"): None}
    wide = {r.cell_id: r.features for r in features.feature_matrix(values, vocab, 3, panel, missing=-1.0).collect()}
    assert wide == {1: [2.0, 0.0, -1.0], 2: [0.0, -1.0, -1.0]}


def test_normalisers(spark):
    r = spark.createDataFrame([("d", "m", 1.0), ("d", "m", 3.0), ("d", "k", 5.0), ("e", "m", 2.0)], "domain string, marker string, value double")
    got = {(x.domain, x.marker): (x.n, x.mean, x.std) for x in features.domain_moments(r).collect()}
    assert got == {("d", "m"): (2, 2.0, 1.0), ("d", "k"): (1, 5.0, 1e-6), ("e", "m"): (1, 2.0, 1e-6), ("e", "k"): (0, 0.0, 1.0)}
    f = r.withColumnRenamed("value", "mean_value")
    scaled = {(x.domain, x.marker, x.mean_value): x.scaled for x in features.zscore_features(f, f).collect()}
    assert scaled["d", "k", 5.0] == 0.0 and scaled["d", "m", 3.0] == pytest.approx((3 - 2) / np.std([1, 3, 2]) / 255)


def test_keep_and_skip_exclude_each_other(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(ValueError, match="not both"):
        features.keep_skip(df, "k", keep=df, skip=df)
    assert features.keep_skip(df, "k") is df
    assert [x.k for x in features.limit_fovs(df.union(df), 1, "k").collect()] == [1, 1]


def test_fields_without_a_factor_scale_by_themselves(spark):
    df = spark.createDataFrame([("f", "a", 4.0), ("f", "b", 2.0), ("f", "b", 4.0), ("f", "z", 0.0)], "fov_key string, channel string, value double").withColumn("row", F.lit(0)).withColumn("col", F.lit(0))
    factors = spark.createDataFrame([("a", 8.0)], "channel string, factor double")
    got = sorted((r.channel, r.value) for r in features.apply_fov_norm(df, factors).collect())
    assert got == [("a", 0.5), ("b", pytest.approx(2 / np.quantile([2, 4], 0.999))), ("b", 1.0), ("z", 0.0)]
