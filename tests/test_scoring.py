import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframes.operators import scoring as ops

SCHEMA = "dataset_name string, fov_name string, predicted_ct string, max_softmax double"


def scored(spark, values, group=("d", "f")):
    return spark.createDataFrame([(*group, "T", v) for v in values], SCHEMA)


@pytest.mark.parametrize(
    ("values", "k", "fence"),
    [
        ([0.4, 0.6, 0.9], 1.5, None),
        ([0.1, 0.2, 0.3, 0.4], 1.5, -0.05),
        ([0.1, 0.3, 0.5, 0.7, 0.9], 0.2, 0.22),
        ([0.1, 0.2, 0.8, 0.9], 0, 0.175),
        ([0.5] * 4, 1.5, 0.5),
        ([0.1, 0.3, math.nan, 0.5, 0.7, math.inf, 0.9], 0.2, 0.22),
        ([math.nan, math.inf, -math.inf, math.nan], 0.2, None),
    ],
)
def test_fence(spark, values, k, fence):
    got = ops.iqr_fences(scored(spark, values), k).collect()
    assert [r.fence for r in got] == ([] if fence is None else [pytest.approx(fence)])


def test_abstention_per_group(spark):
    high = [0.90 + i * 0.09 / 49 for i in range(50)]
    low = [0.10 + i * 0.20 / 49 for i in range(50)]
    df = scored(spark, high, ("d", "high")).unionByName(scored(spark, low, (None, "low")))
    out = ops.iqr_abstain(df, 1.5).groupBy("fov_name").agg(F.avg(F.col("abstained").cast("double")).alias("a")).collect()
    assert all(r.a <= 0.05 for r in out) and len(out) == 2
    strict = ops.iqr_abstain(df, 0.0).where("abstained")
    assert strict.where("predicted_ct <> 'Unknown' OR predicted_ct_raw <> 'T'").count() == 0
    assert strict.where("dataset_name IS NULL").count() > 0


def test_flat_scores_and_nan_never_abstain(spark):
    assert ops.iqr_abstain(scored(spark, [0.5] * 4), 1.5).where("abstained").count() == 0
    out = ops.iqr_abstain(scored(spark, [0.1, 0.3, 0.5, 0.7, 0.9, math.nan, None]), 0.2)
    assert sorted(r.max_softmax for r in out.where("abstained").collect()) == [0.1]


def test_second_application_is_refused(spark):
    once = ops.iqr_abstain(scored(spark, [0.1] * 5), 1.5)
    with pytest.raises(ValueError, match="abstained"):
        ops.iqr_abstain(once, 1.5)


def test_wide_columns_and_reinstatement(spark):
    rows = [("d", "f", 10, "CD4T", [0.7, 0.2, 0.1]), ("d", "f", 11, "CD8T", [0.1, 0.8, 0.1])]
    df = spark.createDataFrame(rows, "dataset_name string, fov_name string, cell_index bigint, cell_type_actual string, probs array<double>")
    names = ["CD4T", "CD8T", "Bcell"]
    wide = ops.predictions_wide(df, names)
    assert wide.columns == [*names, "cell_type_actual", "cell_index", "dataset_name", "fov_name"]
    labelled = ops.argmax_label(df, names).withColumn("abstained", F.lit(True))
    ids = spark.createDataFrame([(10,), (12,)], "cell_index bigint")
    out = {r.cell_index: r for r in ops.reinstate_cells(ids, labelled, ["cell_index"], 3).collect()}
    assert set(out) == {10, 12}
    assert out[10].predicted_ct == "CD4T" and out[10].abstained
    assert (out[12].predicted_ct, out[12].probs, out[12].abstained) == ("Unknown", [0.0] * 3, False)


def test_tissue_restriction(spark):
    df = spark.createDataFrame([(1, "lung", [0.7, 0.2, 0.1]), (2, "liver", [0.7, 0.2, 0.1])], "id int, tissue string, probs array<double>")
    allowed = spark.createDataFrame([("lung", "B"), ("lung", "C")], "tissue string, name string")
    got = {r.id: r.predicted_ct for r in ops.tissue_argmax(df, ["A", "B", "C"], allowed).collect()}
    assert got == {1: "B", 2: "A"}


def test_batch_scoring_matches_the_model(spark):
    x = np.arange(40, dtype=float).reshape(10, 4)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, features array<double>")

    def load():
        w = np.ones((4, 2)) * [1.0, -2.0]
        return lambda m: m @ w

    got = {r.id: r.logits for r in ops.batch_score(df.repartition(3), load).collect()}
    assert got == {i: [r.sum(), -2 * r.sum()] for i, r in enumerate(x)}
