import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframes.functions import names, ordering, quantiles, vectors
from spatialframes.functions.arrays import scatter


@pytest.mark.parametrize("skip", [200_000, 5])
def test_exact_quantiles_match_numpy(spark, monkeypatch, skip):
    # the second round forces the refinement that only large buckets need
    monkeypatch.setattr(quantiles, "_SKIP_LINEAR_BELOW", skip)
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(0, 100, 2000),
        "narrow": rng.uniform(1.0, 1.0001, 2000),
        "heavy": rng.lognormal(0, 5, 2000),
        "ties": np.repeat([0.0, 1.0, -2.5], [500, 1000, 300]),
        "one": np.array([7.25]),
        "tiny": rng.uniform(-1e-300, 1e-300, 50),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    rows += [("normal", math.nan), ("normal", math.inf), ("normal", None), ("none", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "q1": 0.25, "med": 0.5, "p999": 0.999, "top": 1.0}
    got = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g].n_values == len(vs)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-310)


def test_exact_quantiles_without_group_and_with_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    assert quantiles.exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 2.0
    got = {r.g: r.m for r in quantiles.exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {None: 1.5, "a": 5.0}


def _digest(seed, *keys):
    return hashlib.md5("|".join(str(k) for k in (seed, *keys)).encode()).hexdigest()


@pytest.mark.parametrize("slice_above", [1_000_000, 100])
def test_seeded_rank_is_one_sorted_order_per_group(spark, monkeypatch, slice_above):
    monkeypatch.setattr(ordering, "_SLICE_ABOVE", slice_above)
    rows = [("big", i) for i in range(5000)] + [("small", i) for i in range(3)] + [(None, 1)]
    df = spark.createDataFrame(rows, "g string, k int")
    got = ordering.seeded_rank(df, ["g"], ["k"], 7).collect()
    assert len(got) == len(rows)
    for g in ("big", "small", None):
        mine = [r for r in got if r.g == g]
        want = sorted((_digest(7, r.k), r.k) for r in mine)
        assert [k for _, k in want] == [r.k for r in sorted(mine, key=lambda r: r["rank"])]
        assert sorted(r["rank"] for r in mine) == list(range(1, len(mine) + 1))
        assert {r.n for r in mine} == {len(mine)}


@pytest.mark.parametrize("slice_above", [1_000_000, 100])
def test_seeded_rank_limit_returns_the_first_ranks(spark, monkeypatch, slice_above):
    monkeypatch.setattr(ordering, "_SLICE_ABOVE", slice_above)
    df = spark.range(3000).withColumnRenamed("id", "k")
    full = {r.k: r["rank"] for r in ordering.seeded_rank(df, [], ["k"], 1).collect()}
    part = {r.k: r["rank"] for r in ordering.seeded_rank(df, [], ["k"], 1, limit=100).collect()}
    assert part == {k: v for k, v in full.items() if v <= 100}


@pytest.mark.parametrize("slice_above", [1_000_000, 100])
def test_running_sum(spark, monkeypatch, slice_above):
    monkeypatch.setattr(ordering, "_SLICE_ABOVE", slice_above)
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = ordering.seeded_running_sum(df, [], ["k"], 1, F.col("k")).collect()
    order = sorted(range(1000), key=lambda k: _digest(1, k))
    want, total = {}, 0
    for k in order:
        total += k
        want[k] = total
    assert {r.k: r.running for r in got} == want
    assert {r.total for r in got} == {sum(range(1000))}


def test_scatter(spark):
    df = spark.createDataFrame([([(1, 2.0), (0, 1.0), (1, 5.0)],), ([],)], "e array<struct<at:int,value:double>>")
    assert [r.a for r in df.select(scatter(F.col("e"), 3, -1.0).alias("a")).collect()] == [[1.0, 5.0, -1.0], [-1.0, -1.0, -1.0]]


def test_scatter_is_no_python_and_keeps_gaps_and_order(spark):
    rows = [([(2, 3.0), (2, -1.0)],), (None,), ([(3, None), (1, 0.5)],)]
    df = spark.createDataFrame(rows, "e array<struct<at:int,value:double>>").select(scatter(F.col("e"), 4).alias("a"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = [r.a for r in df.collect()]
    assert got[:2] == [[0.0, 0.0, -1.0, 0.0], [0.0] * 4]
    assert got[2][:3] == [0.0, 0.5, 0.0] and np.isnan(got[2][3])


def test_vectors(spark):
    df = spark.createDataFrame([([0.7, 0.2, 0.1],), ([0.4, 0.4, 0.2],)], "p array<double>")
    assert [r.a for r in df.select(vectors.argmax(F.col("p")).alias("a")).collect()] == [0, 0]
    s = df.select(vectors.softmax(F.col("p")).alias("s")).first().s
    want = np.exp([0.7, 0.2, 0.1]) / np.exp([0.7, 0.2, 0.1]).sum()
    assert s == pytest.approx(want)
    assert vectors.threshold_grid() == list(np.linspace(0.01, 0.99, 50))


def test_resolution_order(spark):
    markers = spark.createDataFrame([("CD3", 0), ("PanCK", 1), ("Ki67", 2), ("cd209", 3)], "name string, idx int")
    aliases = spark.createDataFrame(
        [("Keratin", "PanCK", 0), ("KERATIN", "CD3", 1), ("CD3e", "CD3", 2), ("Ghost", "nothing", 3), ("Keratin", "Ki67", 4)],
        "alias string, target string, ord bigint",
    )
    wanted = {
        "CD3": "CD3",
        "cd3": "CD3",
        "Keratin": "Ki67",  # a later entry replaces an earlier one of the same spelling
        "KERATIN": "CD3",
        "keratin": "Ki67",  # ignoring case the first spelling wins, with its last target
        "KI67": "Ki67",
        "CD209": "cd209",
        "Ghost": None,
        "": None,
        "DAPI": None,
    }
    df = spark.createDataFrame([(k,) for k in wanted], "c string")
    got = {r.c: r.marker for r in names.resolve_channels(df, "c", markers, aliases).collect()}
    assert got == wanted
    strict = {r.c: r.marker_idx for r in names.resolve_strict(df, "c", markers).collect()}
    assert strict["CD3"] == 0 and strict["cd3"] == -1


def test_patient_id(spark):
    rows = [
        ("x", "tb_mibi_lung_Patient3-2"),
        ("datasetA_Patient3-1", "f"),
        ("datasetB_Patient3-1", "f"),
        ("none", "scan1"),
        ("a_Patient12_Patient3", "z"),
    ]
    df = spark.createDataFrame(rows, "d string, f string")
    got = [r.p for r in df.select(names.parse_patient_id(F.col("d"), F.col("f")).alias("p")).collect()]
    assert got == ["tb_mibi_lung_Patient3", "datasetA_Patient3", "datasetB_Patient3", None, "a_Patient12"]


def test_control_channels_and_normalisation(spark):
    df = spark.createDataFrame([(" dapi-2",), ("HistoneH3",), ("CD3",), ("h3k9",), ("Ir191",)], "c string")
    assert [r.x for r in df.select(names.is_control_channel(F.col("c")).alias("x")).collect()] == [True, True, False, False, True]
    one = spark.createDataFrame([(" Lymph Node ", " mibi ")], "t string, m string")
    assert tuple(one.select(names.normalize_tissue(F.col("t")), names.normalize_modality(F.col("m"))).first()) == ("lymphnode", "MIBI")


def test_json_keys_and_hash(spark):
    df = spark.createDataFrame([('{"12": [1.5, 2], "x": [0, 0]}',)], "t string")
    assert [tuple(c) for c in df.select(names.centroid_map(F.col("t")).alias("c")).first().c] == [(12, 1.5, 2.0)]
    maps = spark.createDataFrame([({"b": "1", "a": "2"},), ({"a": "2", "b": "1"},)], "m map<string,string>")
    hashes = [r.h for r in maps.select(names.stable_hash(F.col("m")).alias("h")).collect()]
    assert hashes[0] == hashes[1] == hashlib.sha256(b'{"a":"2","b":"1"}').hexdigest()[:16]


def test_index_names_numbers_across_ranges(spark):
    rows = spark.range(5000).selectExpr("concat('n', id % 2500) AS n").unionByName(spark.createDataFrame([(None,)], "n string"))
    got = names.index_names(rows, "n")
    assert [r.name for r in got.orderBy("idx").collect()] == sorted(f"n{i}" for i in range(2500))
    assert sorted(r.idx for r in got.collect()) == list(range(2500)) and got.schema["idx"].dataType.simpleString() == "int"
    # no task ranks all names: the only window that does sees one row a range
    written = got.select("name")._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(name" not in written
    assert names.index_names(rows.where("n IS NULL"), "n").collect() == []
