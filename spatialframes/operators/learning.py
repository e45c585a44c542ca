"""Tabular classifiers on feature vectors, their tuning, and vector compression."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialframes.functions.joins import is_finite
from spatialframes.operators.metrics import hierarchical_macro_f1
from spatialframes.operators.sampling import cap_rows, class_pad, with_weights
from spatialframes.session import settle

LEARNERS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "perceptron": MultilayerPerceptronClassifier}


def with_presence(df: DataFrame, features: str = "features", sentinel: float = 0.0) -> DataFrame:
    """Features followed by 0/1 presence flags; an absent (NaN or NULL) value becomes the sentinel.

    Linear and tree learners here have no route for missing values of their own.
    """
    present = lambda x: is_finite(x)
    values = F.transform(features, lambda x: F.when(present(x), x).otherwise(F.lit(sentinel)))
    flags = F.transform(features, lambda x: present(x).cast("double"))
    return df.withColumn(features, F.concat(values, flags))


def fit(train: DataFrame, label: str, learner: str = "logistic", weighted: bool = True, floor: int = 1000, **params):
    """Model and its class list; rows are weighted by class (mean one) where the learner can."""
    names = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]  # a class vocabulary
    lookup = F.array(*[F.lit(n) for n in names])
    rows = train.withColumn("_y", (F.array_position(lookup, F.col(label)) - 1).cast("double"))
    rows = rows.withColumn("_x", array_to_vector("features"))
    settings = {"featuresCol": "_x", "labelCol": "_y", **params}
    if learner == "perceptron":
        width = len(train.select("features").first()[0])
        settings.setdefault("layers", [width, 16, len(names)])
        settings.setdefault("seed", 42)
    elif weighted:
        rows = with_weights(rows, label, "sqrt", floor, normalize=True)
        settings["weightCol"] = "weight"
    return LEARNERS[learner](**settings).fit(rows), names


def predict(model, names: Sequence[str], rows: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Probabilities over the full class list, a class unseen in training at zero, and the best one."""
    scored = model.transform(rows.withColumn("_x", array_to_vector("features")))
    position = {n: i for i, n in enumerate(names)}
    scored = scored.withColumn("_p", vector_to_array("probability"))
    probs = F.array(*[F.get("_p", F.lit(position[c])) if c in position else F.lit(0.0) for c in classes])
    best = F.get(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int"))
    out = scored.withColumn("probs", probs).withColumn("predicted_ct", best)
    return out.drop("_x", "_p", "rawPrediction", "probability", "prediction")


def classify(
    train: DataFrame, score: DataFrame, label: str, classes: Sequence[str], learner: str = "logistic", **params
) -> DataFrame:
    model, names = fit(train, label, learner, **params)
    return predict(model, names, score, classes)


def tune(
    train: DataFrame,
    val: DataFrame,
    label: str,
    grid: Sequence[Mapping],
    classes: DataFrame,
    hierarchy: DataFrame,
    keys: Sequence[str],
    sample: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Hierarchical macro-F1 on the validation rows of every setting, the best first.

    Each setting is ``{"learner": name, ...parameters}``. A sampled train set keeps one row of
    every class, so that all settings see the same classes. ``keys`` is one orderable row key.
    """
    pool = train
    if sample is not None:
        pool = class_pad(cap_rows(train, sample, keys, seed), train, label, keys[0])
    pool = settle(pool)
    names = [r[0] for r in classes.select("name").orderBy("name").collect()]
    spark = train.sparkSession
    results = []
    for i, setting in enumerate(grid):
        params = {k: v for k, v in setting.items() if k != "learner"}
        scored = classify(pool, val, label, names, setting.get("learner", "logistic"), **params)
        pairs = scored.select(F.col(label).alias("actual"), F.col("predicted_ct").alias("pred"))
        found = hierarchical_macro_f1(pairs, classes, hierarchy).first()
        results.append((i, str(dict(setting)), float(found[0]) if found else 0.0))
    return spark.createDataFrame(results, "setting int, parameters string, macro_f1 double").orderBy(F.desc("macro_f1"), "setting")


# --- truncated decomposition ----------------------------------------------------------------------------------


def gram(df: DataFrame, vec: str, dims: int) -> DataFrame:
    """``(i, j, value, n)`` of X'X with a column of ones appended: partial sums per task, then one sum."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())])

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                x = np.hstack([x.astype("float64"), np.ones((batch.num_rows, 1))])
                total += x.T @ x
        i, j = np.indices(total.shape).astype("int32")
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "value"])

    parts = df.select(F.col(vec).cast("array<double>").alias("x")).mapInArrow(partial, schema)
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def svd_energy(df: DataFrame, vec: str, dims: int, components: int) -> tuple[DataFrame, list[list[float]]]:
    """``(component, singular_value, explained)`` and the right singular vectors.

    The decomposition is not centred. Only the dims x dims product reaches the driver; ``explained``
    is the variance along a component over the total variance.
    """
    import numpy as np

    if dims > 4096:
        raise ValueError("the product of that many dimensions does not belong on the driver")
    full = np.zeros((dims + 1, dims + 1))
    for i, j, value in gram(df, vec, dims).collect():
        full[i, j] = value
    product, sums, n = full[:dims, :dims], full[:dims, dims], full[dims, dims]
    values, vectors = np.linalg.eigh(product)
    top = np.argsort(values)[::-1][: min(components, min(int(n), dims) - 1)]
    mean = sums / n
    total = np.trace(product) / n - mean @ mean
    rows = []
    for rank, k in enumerate(top):
        v = vectors[:, k]
        variance = values[k] / n - (mean @ v) ** 2
        rows.append((rank, float(np.sqrt(max(values[k], 0.0))), float(variance / total)))
    table = df.sparkSession.createDataFrame(rows, "component int, singular_value double, explained double")
    return table, [vectors[:, k].tolist() for k in top]


def project(df: DataFrame, vec: str, directions: Sequence[Sequence[float]], out: str = "reduced") -> DataFrame:
    """Coordinates of each vector along the given directions."""
    values = F.col(vec).cast("array<double>")
    dot = lambda d: F.aggregate(F.zip_with(values, F.array(*[F.lit(float(x)) for x in d]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(out, F.array(*[dot(d) for d in directions]))
