"""From class scores to reported cell types: argmax, abstention, reinstatement."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialframes.functions.joins import null_safe_join
from spatialframes.functions.quantiles import exact_quantiles
from spatialframes.functions.vectors import argmax, softmax
from spatialframes.session import settle

# Fixed value: what a cell without a trusted type is called.
ABSTENTION_LABEL = "Unknown"

FOV = ("dataset_name", "fov_name")


def class_names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def score_logits(df: DataFrame, names: Sequence[str], logits: str = "logits") -> DataFrame:
    """Probabilities, best class and its probability from logits."""
    return argmax_label(df.withColumn("probs", softmax(F.col(logits))), names)


def argmax_label(df: DataFrame, names: Sequence[str], probs: str = "probs") -> DataFrame:
    best = F.get(class_names(names), argmax(F.col(probs)))
    return df.withColumn("predicted_ct", best).withColumn("max_softmax", F.array_max(probs))


def iqr_fences(df: DataFrame, k: float, group: Sequence[str] = FOV, score: str = "max_softmax") -> DataFrame:
    """Lower fence Q1 - k * IQR per group; groups with fewer than four finite scores have none."""
    quartiles = exact_quantiles(df, group, score, {"q1": 0.25, "q3": 0.75}).where(F.col("n_values") >= 4)
    return quartiles.select(*group, (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("fence"))


def iqr_abstain(
    df: DataFrame,
    k: float,
    group: Sequence[str] = FOV,
    score: str = "max_softmax",
    pred: str = "predicted_ct",
    sentinel: str = ABSTENTION_LABEL,
) -> DataFrame:
    """Relabel the cells below their group's fence; the label before stays in ``<pred>_raw``.

    A NULL group key is a group of its own. A frame that was abstained before is refused.
    """
    if "abstained" in df.columns:
        raise ValueError("`abstained` exists already; give a frame without abstention applied")
    fences = settle(iqr_fences(df, k, group, score))
    joined = null_safe_join(df, fences, group, "left")
    below = F.coalesce(~F.isnan(score) & (F.col(score) < F.col("fence")), F.lit(False))
    return (
        joined.withColumn("abstained", below)
        .withColumn(f"{pred}_raw", F.col(pred))
        .withColumn(pred, F.when(F.col("abstained"), F.lit(sentinel)).otherwise(F.col(pred)))
        .drop("fence")
    )


def tissue_argmax(df: DataFrame, names: Sequence[str], allowed: DataFrame, probs: str = "probs") -> DataFrame:
    """Best class among those listed for the tissue; a tissue without a list is unrestricted.

    A list without any known class gives NULL.

    ``allowed(tissue, name)`` is reduced to one array per tissue, as long as the vocabulary.
    """
    lists = settle(allowed.groupBy("tissue").agg(F.collect_set("name").alias("_allowed")))
    joined = df.join(lists, "tissue", "left")
    usable = F.zip_with(
        class_names(names),
        F.col(probs),
        lambda n, p: F.when(F.col("_allowed").isNull() | F.array_contains("_allowed", n), p).otherwise(F.lit(-1.0)),
    )
    joined = joined.withColumn("_usable", usable)
    return joined.withColumn("predicted_ct", F.when(F.exists("_usable", lambda p: p > -1.0), F.get(class_names(names), argmax(F.col("_usable"))))).drop("_usable", "_allowed")


def reinstate_cells(ids: DataFrame, scored: DataFrame, key: Sequence[str], n_classes: int) -> DataFrame:
    """Every input cell appears; one without a result is Unknown with a zero row, not abstained."""
    joined = ids.select(*key).join(scored, list(key), "left")
    for label in ("predicted_ct", "predicted_ct_raw"):
        if label in scored.columns:
            joined = joined.withColumn(label, F.coalesce(label, F.lit(ABSTENTION_LABEL)))
    return (
        joined.withColumn("probs", F.coalesce("probs", F.array_repeat(F.lit(0.0), n_classes)))
        .withColumn("abstained", F.coalesce("abstained", F.lit(False)))
    )


def predictions_wide(df: DataFrame, names: Sequence[str], probs: str = "probs") -> DataFrame:
    """One probability column per class in index order, then label and keys."""
    return df.select(
        *[F.get(probs, F.lit(i)).alias(n) for i, n in enumerate(names)],
        "cell_type_actual",
        "cell_index",
        "dataset_name",
        "fov_name",
    )


def shard(df: DataFrame, keys: Sequence[str], n: int, out: str = "shard") -> DataFrame:
    """Export shard 0..n-1 of each row, a function of its key alone."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.withColumn(out, F.pmod(number, F.lit(n)).cast("int"))


def batch_score(df: DataFrame, load, inputs: str = "features", out: str = "logits") -> DataFrame:
    """Score with a user model: ``load()`` runs once per task and returns f(matrix) -> matrix.

    Rows travel as Arrow batches; the model sees one dense batch at a time.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([f for f in df.schema.fields] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = load()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(inputs))
            if batch.num_rows == 0:
                continue
            flat = column.flatten().to_numpy(zero_copy_only=False)
            scores = np.asarray(model(flat.reshape(batch.num_rows, -1)), dtype="float64")
            offsets = np.arange(0, scores.size + 1, scores.shape[1], dtype="int32")
            added = pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, added], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
