import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframes.operators import metrics as ops
from spatialframes.operators import positivity as pos


def pairs(spark, items):
    return spark.createDataFrame([p for p, n in items for _ in range(n)], "actual string, pred string")


def names(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "name string")


def edges(spark, **kw):
    return spark.createDataFrame([(p, c) for p, cs in kw.items() for c in cs], "parent string, child string")


def table(df):
    return {(r.actual, r.pred): r.n for r in df.collect()}


def test_hierarchy_moves_children_onto_the_parent(spark):
    df = pairs(spark, [(("Tcell", "CD4T"), 6), (("Tcell", "CD8T"), 3), (("Tcell", "Tumor"), 1), (("CD4T", "CD4T"), 5)])
    counts = ops.confusion(df, names(spark, "Tcell", "CD4T", "CD8T", "Tumor"))
    got = table(ops.hierarchy_credit(counts, edges(spark, Tcell=["CD4T", "CD8T"])))
    assert got == {("Tcell", "Tcell"): 9, ("Tcell", "Tumor"): 1, ("CD4T", "CD4T"): 5}


def test_credit_is_one_way_and_ignores_unknown_names(spark):
    df = pairs(spark, [(("CD4T", "Tcell"), 4), (("CD4T", "CD4T"), 1), (("Tcell", "Ghost"), 2)])
    counts = ops.confusion(df, names(spark, "Tcell", "CD4T"))
    got = table(ops.hierarchy_credit(counts, edges(spark, Tcell=["CD4T", "Ghost"], Nobody=["CD4T"])))
    assert got == {("CD4T", "Tcell"): 4, ("CD4T", "CD4T"): 1}


def test_macro_f1(spark):
    df = pairs(spark, [(("A", "A"), 1), (("A", "B"), 1), (("B", "B"), 1), (("C", "C"), 1), (("C", "A"), 1)])
    empty = edges(spark, X=["Y"])
    classes = names(spark, "A", "B", "C", "D")
    assert ops.hierarchical_macro_f1(df, classes, empty).first().macro_f1 == pytest.approx(0.611111, abs=1e-6)
    t = pairs(spark, [(("Tcell", "CD4T"), 1), (("Tcell", "CD8T"), 1), (("Tumor", "Tumor"), 1), (("CD4T", "CD4T"), 1)])
    h = edges(spark, Tcell=["CD4T", "CD8T"])
    assert ops.hierarchical_macro_f1(t, names(spark, "Tcell", "CD4T", "CD8T", "Tumor"), h).first().macro_f1 == 1.0
    assert ops.hierarchical_macro_f1(t.limit(0), classes, h).first().macro_f1 == 0.0


def test_summary_against_plain_arithmetic(spark):
    rng = np.random.default_rng(0)
    labels = list("ABCDE")
    actual, pred = rng.choice(labels[:4], 400), rng.choice(labels, 400)
    df = spark.createDataFrame(list(zip(actual.tolist(), pred.tolist())), "actual string, pred string")
    got = ops.class_summary(ops.confusion(df, names(spark, *labels))).first()
    f1, acc, weights = [], [], []
    for c in labels[:4]:
        hit = ((actual == c) & (pred == c)).sum()
        p, r = hit / (pred == c).sum(), hit / (actual == c).sum()
        f1.append(2 * p * r / (p + r))
        acc.append(hit / ((actual == c).sum() + 1e-8))
        weights.append((actual == c).sum())
    assert got.macro_f1 == pytest.approx(np.mean(f1))
    assert got.weighted_f1 == pytest.approx(np.average(f1, weights=weights))
    assert got.macro_accuracy == pytest.approx(np.mean(acc))
    assert got.weighted_accuracy == pytest.approx((actual == pred).mean())


def test_losses(spark):
    df = spark.createDataFrame([(0.5, "a"), (0.25, "b"), (0.9, "skip")], "pt double, c string")
    out = ops.reduce_loss(df, ops.focal_loss(F.col("pt")), F.col("c") == "skip").first()
    want = [0.25 * -np.log(0.5), 0.5625 * -np.log(0.25)]
    assert (out.mean_loss, out.n_rows) == (pytest.approx(np.mean(want)), 2)
    none = ops.reduce_loss(df, ops.focal_loss(F.col("pt")), F.lit(True)).first()
    assert (none.mean_loss, none.n_rows) == (0.0, 0)
    probs = spark.createDataFrame([([0.2, 0.3, 0.5], 0), ([0.0, 0.0, 1.0], 0)], "p array<double>, y int")
    loss = ops.coarse_log_loss(F.col("p"), F.col("y"), ["x", "y", "z"], {"x": "L", "y": "L"})
    assert [r.l for r in probs.select(loss.alias("l")).collect()] == [pytest.approx(-np.log(0.5)), pytest.approx(-np.log(1e-7))]
    logit = spark.createDataFrame([(2.0, 1.0), (-800.0, 1.0)], "x double, y double")
    got = [r.b for r in logit.select(ops.binary_cross_entropy(F.col("x"), F.col("y")).alias("b")).collect()]
    assert got == [pytest.approx(np.log1p(np.exp(-2.0))), pytest.approx(800.0)]


def test_weight_ratio(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (0.0,), (float("nan"),), (float("inf"),)], "weight double")
    assert ops.weight_ratio(df).first().ratio == 4.0
    assert ops.weight_ratio(df.where("weight = 1.0")).first().ratio == 1.0


# --- positivity ---------------------------------------------------------------------------------------------


def scores(spark):
    cells = [("Tcell", 0.9, 0.1), ("Tcell", 0.4, 0.2), ("Bcell", 0.1, 0.8), ("Bcell", 0.2, 0.3)]
    rows = [("ds1", i, t, m, s) for i, (t, a, b) in enumerate(cells) for m, s in (("CD3", a), ("CD20", b))]
    return spark.createDataFrame(rows, "dataset_name string, cell_index int, cell_type string, marker string, score double")


def truth(spark, extra=()):
    rows = [("ds1", "Tcell", "CD3", "1"), ("ds1", "Bcell", "CD3", "0"), ("ds1", "Tcell", "CD20", "0"), ("ds1", "Bcell", "CD20", "1"), *extra]
    return spark.createDataFrame(rows, "dataset_name string, cell_type string, marker string, value string")


def test_positivity_eval(spark):
    joined = pos.positivity_join(scores(spark), truth(spark))
    for r in pos.marker_metrics(pos.marker_counts(joined)).collect():
        assert (r.tp, r.fp, r.fn, r.tn) == (1, 0, 1, 2)
        assert (r.accuracy, r.precision, r.recall, r.n_samples) == (0.75, 1.0, 0.5, 4)
        assert r.f1 == pytest.approx(2 / 3)
    out = pos.positivity_eval(scores(spark), truth(spark)).first()
    assert (out.n_samples, out.mp_num_markers, out.accuracy) == (8, 2, 0.75)
    assert out.mp_macro_f1 == out.mp_micro_f1 == pytest.approx(2 / 3)
    nothing = truth(spark).withColumn("value", F.lit("?"))
    assert pos.positivity_eval(scores(spark), nothing).count() == 0


@pytest.mark.parametrize(
    ("value", "lenient", "strict"),
    [("0", (0, True), 0), ("1", (1, True), 1), ("?", (0, False), None), ("0.5", (0, False), None), ("2", (1, True), None), ("NaN", (0, True), None), ("text", (0, False), None), (None, (0, False), None)],
)
def test_the_two_readings_of_an_entry(spark, value, lenient, strict):
    df = spark.createDataFrame([("d", "t", "m", value)], "dataset_name string, cell_type string, marker string, value string")
    positive, valid = pos.lenient_entry(F.col("value"))
    assert tuple(df.select(positive, valid).first()) == lenient
    rows = pos.strict_truth(df).collect()
    assert [r.target for r in rows] == ([] if strict is None else [strict])


def test_lookup_ignores_case_only_as_a_fallback(spark):
    extra = [("ds1", "Tcell", "Ki67", "1"), ("ds1", "Tcell", "cd3", "0")]
    wanted = spark.createDataFrame(
        [("ds1", "TCELL", "KI67"), ("ds1", "Tcell", "CD3"), ("ds1", "Tcell", "cd3"), ("ds2", "Tcell", "CD3"), ("ds1", "Tcell", "nope")],
        "dataset_name string, cell_type string, marker string",
    )
    got = {(r.dataset_name, r.cell_type, r.marker): (r.positive, r.valid) for r in pos.positivity_lookup(wanted, truth(spark, extra)).collect()}
    assert got == {
        ("ds1", "TCELL", "KI67"): (1, True),
        ("ds1", "Tcell", "CD3"): (1, True),
        ("ds1", "Tcell", "cd3"): (0, True),
        ("ds2", "Tcell", "CD3"): (0, False),
        ("ds1", "Tcell", "nope"): (0, False),
    }


def marked(spark, rows):
    return spark.createDataFrame(rows, "marker string, score double, target int")


def test_macro_is_not_micro_and_vacuous_markers_leave(spark):
    rows = [("m0", 0.9, 1)] * 100 + [("m1", 0.9, 0)] * 2 + [("m1", 0.1, 1)] * 2 + [("quiet", 0.1, 0)] * 5
    out = pos.marker_summary(pos.marker_counts(marked(spark, rows))).first()
    assert out.mp_macro_f1 == 0.5 and out.mp_micro_f1 > 0.9
    assert (out.mp_num_markers, out.mp_num_markers_excluded) == (3, 1)
    empty = pos.marker_summary(pos.marker_counts(marked(spark, rows).limit(0))).first()
    assert all(v == 0 for v in empty)


def test_threshold_is_the_lowest_of_the_best(spark):
    rows = [("m", s, 1) for s in (0.35, 0.38, 0.32, 0.40)] + [("m", s, 0) for s in (0.05, 0.08, 0.03, 0.06)]
    df = marked(spark, rows + [("never", 0.9, 0), ("never", 0.2, 0)])
    got = {r.marker: r for r in pos.best_threshold(df).collect()}
    assert got["m"].threshold == pytest.approx(0.09) and got["m"].best_f1 == 1.0
    assert (got["never"].threshold, got["never"].best_f1) == (0.5, 0.0)
    assert [r.marker for r in pos.uncalibrated(df).collect()] == ["never"]
    arms = {(r.arm, r.marker): r.f1 for r in pos.learned_vs_fixed(df, pos.best_threshold(df)).collect()}
    assert (arms["fixed", "m"], arms["learned", "m"]) == (0.0, 1.0)


def test_threshold_search_equals_the_sweep(spark):
    rng = np.random.default_rng(5)
    grid = np.linspace(0.01, 0.99, 50)
    score = np.concatenate([rng.uniform(-0.1, 1.1, 300), grid, np.nextafter(grid, 0), [np.nan]])
    target = rng.integers(0, 2, len(score))
    df = marked(spark, [("m", float(s), int(t)) for s, t in zip(score, target)])
    best, at = 0.0, 0.5
    for t in grid:
        hit = score >= t
        tp = (hit & (target == 1)).sum()
        f1 = 2 * tp / (2 * tp + (hit & (target == 0)).sum() + (~hit & (target == 1)).sum())
        if f1 > best:
            best, at = f1, t
    got = pos.best_threshold(df).first()
    assert (got.best_f1, got.threshold) == (pytest.approx(best), at)


def test_auroc_equals_pair_counting(spark):
    rng = np.random.default_rng(6)
    score, target = np.round(rng.uniform(0, 1, 400), 2), rng.integers(0, 2, 400)
    df = marked(spark, [("m", float(s), int(t)) for s, t in zip(score, target)] + [("one", 0.3, 1)])
    p, n = score[target == 1], score[target == 0]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    got = pos.marker_auroc(df).collect()
    assert [r.marker for r in got] == ["m"] and got[0].auroc == pytest.approx(want)
