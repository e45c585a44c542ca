"""Cell types for whole cohorts: every field of view in one job, the model supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialframes.functions.joins import is_finite
from spatialframes.functions.names import resolve_channels
from spatialframes.functions.vectors import softmax
from spatialframes.operators import quality, scoring, signal, tile_signal
from spatialframes.operators.features import cell_means, feature_matrix, foreground
from spatialframes.operators.patches import CROP, to_resolution
from spatialframes.operators.tile_patches import cell_windows, score_windows
from spatialframes.session import settle, settle_and_tell

CELL = ["fov_key", "cell_id"]
TARGET_MPP = 0.5  # fixed value: microns per pixel


def usable_panel(channels: DataFrame, markers: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """Panel ``(fov_key, pos, channel, marker, all_zero, reason, kept)``; a field without a usable
    channel, or with more than a model takes, is refused. ``known`` is the profile of the pixels."""
    zero = signal.channel_range(known).select("fov_key", "channel", (F.col("_max") == 0).alias("all_zero"))
    named = resolve_channels(channels, "channel", markers, aliases).join(zero, ["fov_key", "channel"], "left")
    panel = settle(quality.channel_mask(named.withColumn("all_zero", F.coalesce("all_zero", F.lit(False)))))
    quality.raise_if_any(quality.panel_cap(panel.where("kept"), panel))
    return panel


def _reported(logits: DataFrame, classes: Sequence[str], abstention_k: float, ids: DataFrame) -> DataFrame:
    """Cell types of scored cells, and of the cells that were lost on the way.

    Scores are written once. What the contracts of hook and model forbid raises while they are computed.
    """
    whole = F.forall("probs", is_finite)
    told = F.raise_error(F.lit("the model returned probabilities that are not finite")).cast("array<double>")
    scored = logits.withColumn("probs", softmax(F.col("logits"))).withColumn("probs", F.when(whole, F.col("probs")).otherwise(told))
    try:
        scored = settle(scored.select(*CELL, "probs"))
    except PySparkException as error:
        for reason in (signal.CONTRACT, "probabilities that are not finite"):
            if reason in str(error):
                raise ValueError(next(line for line in str(error).splitlines() if reason in line).strip()) from error
        raise
    labelled = scoring.argmax_label(scored, classes)
    if abstention_k > 0:
        labelled = scoring.iqr_abstain(labelled, abstention_k, ["fov_key"])
    else:
        labelled = labelled.withColumn("abstained", F.lit(False)).withColumn("predicted_ct_raw", F.col("predicted_ct"))
    out = scoring.reinstate_cells(ids, labelled, CELL, len(classes))
    return out.select(*CELL, "predicted_ct", "predicted_ct_raw", "probs", "abstained")


def predict(
    pixels: DataFrame,
    mask: DataFrame,
    channels: DataFrame,
    fovs: DataFrame,
    markers: DataFrame,
    aliases: DataFrame,
    load: Callable[[], Callable],
    classes: Sequence[str],
    abstention_k: float = 0.0,
    preprocess: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(fov_key, cell_id, predicted_ct, predicted_ct_raw, probs, abstained)`` of every input cell.

    ``channels(fov_key, pos, channel)`` is the panel, ``fovs(fov_key, native_mpp)`` the resolution.
    ``load()`` returns a model from the matrix of mean marker signals, in registry order and zero
    where a marker is absent, to logits in the order of ``classes``. ``preprocess`` replaces the
    default conditioning and is held to the same contract. Abstention is off unless k > 0. A cell
    lost on the way comes back as Unknown with a zero row.
    """
    (markers, told), aliases = settle_and_tell(markers.select("name", "idx"), last=F.col("idx")), settle(aliases.select("alias", "target", "ord"))
    known = signal.profile(pixels, finite=True)
    panel = usable_panel(channels, markers, aliases, known)
    kept = panel.where("kept").select("fov_key", "channel", "marker")
    renamed = lambda df: df.join(kept, ["fov_key", "channel"]).withColumn("channel", F.col("marker")).drop("marker")
    named = renamed(pixels)
    scaled, labels = to_resolution(named, mask, fovs, TARGET_MPP, slack=0.0)
    if preprocess is None:
        # pixels that were not resampled are those that were profiled
        conditioned = signal.clip_and_normalize(scaled, signal.DEFAULT_CONFIG[0]["p"], renamed(known) if scaled is named else None)
    else:
        conditioned = preprocess(scaled)
        if set(conditioned.columns) != set(scaled.columns):
            raise ValueError(f"hook changed the columns: {conditioned.columns}")
    means = cell_means(signal.checked(conditioned), labels).withColumnRenamed("channel", "marker")
    vectors = feature_matrix(means, markers, 0 if told["last"] is None else told["last"] + 1)
    return _reported(scoring.batch_score(vectors, load), classes, abstention_k, foreground(mask).select(*CELL).distinct())


def predict_windows(
    tiles: DataFrame,
    mask_tiles: DataFrame,
    channels: DataFrame,
    fovs: DataFrame,
    markers: DataFrame,
    aliases: DataFrame,
    load: Callable[[], Callable],
    classes: Sequence[str],
    abstention_k: float = 0.0,
    preprocess: Callable[[DataFrame], DataFrame] | None = None,
    crop: int = CROP,
) -> DataFrame:
    """The same from image tiles, for a model that looks at the window of each cell.

    ``load()`` returns a model of masked crops, context planes and channel positions, see
    :func:`~spatialframes.operators.tile_patches.score_windows`. Tiles are conditioned, resampled and cut as arrays;
    ``preprocess`` takes and returns tiles.
    """
    markers, aliases = settle(markers.select("name", "idx")), settle(aliases.select("alias", "target", "ord"))
    known = tile_signal.profile(tiles, finite=True)
    panel = usable_panel(channels, markers, aliases, known)
    kept = panel.where("kept").select("fov_key", "channel", "marker")
    renamed = lambda df: df.join(kept, ["fov_key", "channel"]).withColumn("channel", F.col("marker")).drop("marker")
    named = renamed(tiles).select(tiles.columns)
    scaled, labels = tile_signal.to_resolution(named, mask_tiles, fovs, TARGET_MPP, slack=0.0)
    if preprocess is None:
        conditioned = tile_signal.clip_and_normalize(scaled, signal.DEFAULT_CONFIG[0]["p"], renamed(known) if scaled is named else None)
    else:
        conditioned = preprocess(scaled)
        if set(conditioned.columns) != set(scaled.columns):
            raise ValueError(f"hook changed the columns: {conditioned.columns}")
    order = panel.where("kept").join(markers.withColumnRenamed("name", "marker"), "marker")
    order = order.groupBy("fov_key").agg(F.array_sort(F.collect_list(F.struct("pos", "marker", F.col("idx").cast("int").alias("idx")))).alias("_p"))
    order = settle(order.select("fov_key", F.col("_p.marker").alias("panel"), F.col("_p.idx").alias("positions")))
    cells = tile_signal.centroids(labels)
    stacks = cell_windows(cells, tile_signal.checked(conditioned), labels, crop, panel=order)
    logits = score_windows(stacks.join(order.select("fov_key", "positions"), "fov_key"), load, crop)
    return _reported(logits, classes, abstention_k, tile_signal.cell_ids(mask_tiles))
