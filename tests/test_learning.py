import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframes.operators import learning as ops


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(300):
        c = i % 3
        x = rng.normal(0, 0.3, 3)
        x[c] += 2.0
        data.append((i, "ABC"[c], [float(v) for v in x]))
    return spark.createDataFrame(data, "cell_id bigint, label string, features array<double>").cache()


@pytest.mark.parametrize("learner", ["logistic", "forest", "perceptron"])
def test_learners_align_to_the_full_class_list(rows, learner):
    params = {"logistic": {"maxIter": 20}, "forest": {"numTrees": 5, "seed": 1}, "perceptron": {"maxIter": 60}}[learner]
    out = ops.classify(rows.where("cell_id < 200"), rows.where("cell_id >= 200"), "label", ["A", "unseen", "B", "C"], learner, **params)
    got = out.collect()
    assert len(got) == 100
    assert np.mean([r.label == r.predicted_ct for r in got]) > 0.9
    assert all(r.probs[1] == 0.0 and sum(r.probs) == pytest.approx(1.0) for r in got)


def test_presence_columns(spark):
    df = spark.createDataFrame([([1.0, None, float("nan"), 0.0],)], "features array<double>")
    assert ops.with_presence(df, sentinel=-1.0).first().features == [1.0, -1.0, -1.0, 0.0, 1.0, 0.0, 0.0, 1.0]


def test_tuning_orders_by_score(spark, rows):
    classes = rows.select(F.col("label").alias("name")).distinct()
    none = spark.createDataFrame([("X", "Y")], "parent string, child string")
    grid = [{"learner": "forest", "numTrees": 1, "maxDepth": 1, "seed": 1}, {"learner": "logistic", "maxIter": 20}]
    out = ops.tune(rows.where("cell_id < 200"), rows.where("cell_id >= 200"), "label", grid, classes, none, ["cell_id"], sample=60).collect()
    assert [r.setting for r in out] == [1, 0] and out[0].macro_f1 > 0.9 >= out[1].macro_f1


def test_decomposition_matches_numpy(spark):
    x = np.random.default_rng(1).normal(1.0, 1.0, (200, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>").repartition(4)
    table, directions = ops.svd_energy(df, "v", 5, 3)
    got = table.orderBy("component").collect()
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    reduced = x @ vt[:3].T
    assert [r.singular_value for r in got] == pytest.approx(s[:3])
    assert [r.explained for r in got] == pytest.approx(reduced.var(0) / x.var(0).sum())
    out = np.array([r.reduced for r in ops.project(df, "v", directions).orderBy("id").collect()])
    assert np.abs(out) == pytest.approx(np.abs(reduced))
    assert ops.svd_energy(df, "v", 5, 50)[0].count() == 4
