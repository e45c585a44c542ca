"""Per-channel signal conditioning of pixel tables, driven by a list of operations.

Every operation maps ``pixels(fov_key, channel, row, col, value)`` to the same shape. Statistics
are taken per (field, channel), written as a small side table and joined back, so a channel of any
size is never held by one task. The two filters that need neighbouring pixels work on image
lines, whose length is the width or height of the image.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialframes.functions.joins import is_finite
from spatialframes.functions.quantiles import exact_quantiles, octave_histogram
from spatialframes.session import settle, settle_and_tell

CHANNEL = ["fov_key", "channel"]

# The built-in conditioning.
DEFAULT_CONFIG = [{"op": "clip_percentile", "p": 99.9}, {"op": "min_max_normalize"}]
MAD_SCALE = 1.4826


def _with_stats(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    return pixels.join(settle(stats), CHANNEL, "left")


def profile(pixels: DataFrame, finite: bool = False) -> DataFrame:
    """Octave histogram of every channel, written once: what is finite, the range, and where percentiles lie.

    The statistics of a channel in one scan. Zeros are alone in octave 0, what is not finite in octave NULL;
    with ``finite`` such pixels raise.
    """
    odd = F.when(F.col("_octave").isNull(), F.col("fov_key").cast("string"))
    known, told = settle_and_tell(octave_histogram(pixels, CHANNEL, "value"), odd=odd)
    if finite and told["odd"] is not None:
        raise ValueError(f"pixels of field {told['odd']!r} are not finite")
    return known


def nonzero_percentile(pixels: DataFrame, p: float, known: DataFrame | None = None) -> DataFrame:
    """Per channel percentile of the pixels that are not zero; negatives count.

    ``known`` is the :func:`profile` of the pixels.
    """
    known = None if known is None else known.where(F.col("_octave") != 0)
    return exact_quantiles(pixels.where(F.col("value") != 0), CHANNEL, "value", {"q": p / 100.0}, known)


def channel_range(known: DataFrame) -> DataFrame:
    """``fov_key, channel, _min, _max`` of the finite pixels, from a :func:`profile`."""
    finite = known.where(F.col("_octave").isNotNull())
    return finite.groupBy(*CHANNEL).agg(F.min("_low").alias("_min"), F.max("_high").alias("_max"))


def clip_percentile(pixels: DataFrame, p: float) -> DataFrame:
    joined = _with_stats(pixels, nonzero_percentile(pixels, p).drop("n_values"))
    return joined.withColumn("value", F.least("value", "q")).drop("q")


def min_max_normalize(pixels: DataFrame) -> DataFrame:
    stats = pixels.groupBy(*CHANNEL).agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
    width = F.col("_max") - F.col("_min")
    scaled = (F.col("value") - F.col("_min")) / F.when(width == 0, F.lit(1.0)).otherwise(width)
    return _with_stats(pixels, stats).withColumn("value", scaled).drop("_min", "_max")


def clip_and_normalize(pixels: DataFrame, p: float, known: DataFrame | None = None) -> DataFrame:
    """:func:`clip_percentile` and then :func:`min_max_normalize`, with one statistics table.

    Two scans give the statistics, the :func:`profile` and its refinement, one without it (``known``). The range
    of the clipped values follows from the range before and the clip.
    """
    known = profile(pixels) if known is None else known
    stats = channel_range(known).join(nonzero_percentile(pixels, p, known).drop("n_values"), CHANNEL, "left")
    low, high = F.least("_min", "q"), F.least("_max", "q")
    stats = stats.select(*CHANNEL, "q", low.alias("_low"), F.when(high == low, F.lit(1.0)).otherwise(high - low).alias("_width"))
    scaled = (F.least("value", "q") - F.col("_low")) / F.col("_width")
    return _with_stats(pixels, stats).withColumn("value", scaled).drop("q", "_low", "_width")


def log1p(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("value", F.log1p(F.greatest(F.col("value"), F.lit(0.0))))


def background_subtract(pixels: DataFrame, value: float) -> DataFrame:
    return pixels.withColumn("value", F.greatest(F.col("value") - F.lit(float(value)), F.lit(0.0)))


def _require_known(pixels: DataFrame, names: Sequence[str]) -> None:
    found = pixels.where(F.col("channel").isin(list(names))).select("channel").distinct()
    unknown = sorted(set(names) - {r[0] for r in found.collect()})  # at most len(names) rows
    if unknown:
        raise ValueError(f"unknown channel name(s) in configuration: {unknown}")


def background_subtract_per_channel(
    pixels: DataFrame, p: float = 25.0, names: Sequence[str] | None = None
) -> DataFrame:
    """Remove each channel's own floor, a percentile of its nonzero pixels; no names means all."""
    if names:
        _require_known(pixels, names)
    chosen = F.col("channel").isin(list(names)) if names else F.lit(True)
    floors = nonzero_percentile(pixels.where(chosen), p).drop("n_values")
    lowered = F.greatest(F.col("value") - F.col("q"), F.lit(0.0))
    joined = _with_stats(pixels, floors)
    return joined.withColumn("value", F.when(F.col("q").isNull(), F.col("value")).otherwise(lowered)).drop("q")


def gamma(pixels: DataFrame, g: float) -> DataFrame:
    stats = pixels.groupBy(*CHANNEL).agg(F.max("value").alias("_max"))
    stats = stats.withColumn("_max", F.when(F.col("_max") == 0, F.lit(1.0)).otherwise(F.col("_max")))
    unit = F.least(F.greatest(F.col("value") / F.col("_max"), F.lit(0.0)), F.lit(1.0))
    joined = _with_stats(pixels, stats)
    return joined.withColumn("value", F.pow(unit, F.lit(float(g))) * F.col("_max")).drop("_max")


def hot_pixel_removal(pixels: DataFrame, z: float = 5.0) -> DataFrame:
    """Clip at median + z robust deviations."""
    median = settle(exact_quantiles(pixels, CHANNEL, "value", {"_median": 0.5}).drop("n_values"))
    away = pixels.join(median, CHANNEL).withColumn("_away", F.abs(F.col("value") - F.col("_median")))
    mad = exact_quantiles(away, CHANNEL, "_away", {"_mad": 0.5}).drop("n_values")
    mad = mad.withColumn("_mad", F.when(F.col("_mad") == 0, F.lit(1.0)).otherwise(F.col("_mad")))
    top = F.col("_median") + z * MAD_SCALE * F.col("_mad")
    joined = pixels.join(median, CHANNEL, "left").join(settle(mad), CHANNEL, "left")
    return joined.withColumn("value", F.least(F.col("value"), top)).drop("_median", "_mad")


def channel_drop(pixels: DataFrame, names: Sequence[str]) -> DataFrame:
    _require_known(pixels, names)
    dropped = F.col("channel").isin(list(names))
    return pixels.withColumn("value", F.when(dropped, F.lit(0.0)).otherwise(F.col("value")))


def channel_weight(pixels: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    _require_known(pixels, list(weights))
    factor = F.lit(1.0)
    for name, weight in weights.items():
        factor = F.when(F.col("channel") == name, F.lit(float(weight))).otherwise(factor)
    return pixels.withColumn("value", F.col("value") * factor)


# --- neighbourhood filters -------------------------------------------------------------------------


def reflect(index: Column, size: Column) -> Column:
    """Half-sample symmetric extension: d c b a | a b c d | d c b a."""
    folded = F.pmod(index, 2 * size)
    return F.when(folded < size, folded).otherwise(2 * size - 1 - folded).cast("int")


def on_lines(pixels: DataFrame, axis: str, compute: Callable[..., Column], extra: Sequence[str] = (), length=None) -> DataFrame:
    """Apply ``compute(line, size, i, *extra)`` at every position of every image line along ``axis``.

    ``extra`` columns are constant per field. ``length(size, *extra)`` gives the length of the new
    line, the old one by default. Every pixel of the image has to be present; a gap raises instead
    of shifting the line.
    """
    across = "row" if axis == "col" else "col"
    lines = pixels.groupBy(*CHANNEL, *extra, across).agg(
        F.array_sort(F.collect_list(F.struct(F.col(axis).alias("at"), F.col("value").alias("v")))).alias("_line")
    )
    size = F.size("_line")
    whole = ~F.exists(F.transform("_line", lambda p, i: p["at"] != i), lambda odd: odd)
    lines = lines.withColumn(
        "_line", F.when(whole, F.col("_line")).otherwise(F.raise_error(F.lit("image line with missing pixels")))
    )
    lines = lines.withColumn("_line", F.transform("_line", lambda p: p["v"]))
    columns = [F.col(e) for e in extra]
    last = (size if length is None else length(size, *columns)) - 1
    out = F.transform(F.sequence(F.lit(0), last), lambda i: compute(F.col("_line"), size, i, *columns))
    # a line shrunk to nothing has no pixel
    out = F.when(last >= 0, out)
    return lines.select(*CHANNEL, *extra, across, F.posexplode(out).alias(axis, "value"))


def denoise_median(pixels: DataFrame, size: int = 3) -> DataFrame:
    """Median of a size x size window, the upper middle element for an even count."""
    offsets = [d - size // 2 for d in range(size)]

    def window(line, n, i):
        return F.array(*[F.get(line, reflect(i + d, n)) for d in offsets])

    def median(line, n, i):
        values = F.flatten(F.array(*[F.get(line, reflect(i + d, n)) for d in offsets]))
        return F.get(F.array_sort(values), F.lit(size * size // 2))

    return on_lines(on_lines(pixels, "col", window), "row", median).select("fov_key", "channel", "row", "col", "value")


def denoise_gaussian(pixels: DataFrame, size: int = 3) -> DataFrame:
    """Gaussian of sigma size / 2, cut at four sigma, one pass per axis."""
    sigma = size / 2.0
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    weights = [w / sum(raw) for w in raw]
    kernel = F.array(
        *[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in zip(range(-radius, radius + 1), weights)]
    )

    def smooth(line, n, i):
        return F.aggregate(kernel, F.lit(0.0), lambda acc, k: acc + k["w"] * F.get(line, reflect(i + k["d"], n)))

    return on_lines(on_lines(pixels, "row", smooth), "col", smooth).select("fov_key", "channel", "row", "col", "value")


def denoise(pixels: DataFrame, kind: str = "median", size: int = 3) -> DataFrame:
    if kind == "median":
        return denoise_median(pixels, int(size))
    if kind == "gaussian":
        return denoise_gaussian(pixels, int(size))
    raise ValueError(f"unknown denoise kind {kind!r}")


# --- the declarative list ------------------------------------------------------------------------------

OPERATIONS: dict[str, Callable[..., DataFrame]] = {
    "clip_percentile": clip_percentile,
    "min_max_normalize": min_max_normalize,
    "log1p": log1p,
    "background_subtract": background_subtract,
    "background_subtract_per_channel": background_subtract_per_channel,
    "gamma": gamma,
    "denoise": denoise,
    "hot_pixel_removal": hot_pixel_removal,
    "channel_drop": channel_drop,
    "channel_weight": channel_weight,
}


def apply_config(pixels: DataFrame, config: Sequence[Mapping]) -> DataFrame:
    """Apply ``[{"op": name, ...}, ...]`` in order; an unknown operation raises.

    A clip followed by min-max shares its statistics. What a denoise step leaves is written once
    when other steps follow, as their statistics read it again.
    """
    unknown = [step["op"] for step in config if step["op"] not in OPERATIONS]
    if unknown:
        raise ValueError(f"unknown operation {unknown[0]!r}; known: {sorted(OPERATIONS)}")
    names = [step["op"] for step in config]
    fused = False
    for i, step in enumerate(config):
        if fused:
            fused = False
            continue
        arguments = {k: v for k, v in step.items() if k != "op"}
        following = names[i + 1] if i + 1 < len(names) else None
        if step["op"] == "clip_percentile" and following == "min_max_normalize":
            pixels = clip_and_normalize(pixels, **arguments)
            fused = True
            continue
        pixels = pixels.transform(OPERATIONS[step["op"]], **arguments)
        if step["op"] == "denoise" and following is not None:
            pixels = settle(pixels)
    return pixels


def make_preprocessor(config: Sequence[Mapping]) -> Callable[[DataFrame], DataFrame]:
    """A hook that applies the list, for use wherever a ``DataFrame -> DataFrame`` hook is taken."""
    return lambda pixels: apply_config(pixels, config)


def value_contract(pixels: DataFrame, low: float = 0.0, high: float = 1.0, slack: float = 1e-6) -> DataFrame:
    """Violations ``(check, key, detail)``: values that are not finite or leave [low, high]."""
    finite = is_finite(F.col("value"))
    stats = pixels.groupBy("fov_key").agg(
        F.count_if(~finite).alias("bad"),
        F.min(F.when(finite, F.col("value"))).alias("lo"),
        F.max(F.when(finite, F.col("value"))).alias("hi"),
    )
    outside = (F.col("lo") < low - slack) | (F.col("hi") > high + slack)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("bad") > 0, F.struct(F.lit("not_finite").alias("check"), F.col("bad").cast("string").alias("detail"))),
            F.when(outside, F.struct(F.lit("out_of_range").alias("check"), F.format_string("%.3f..%.3f", "lo", "hi").alias("detail"))),
        )
    )
    rows = stats.select(F.col("fov_key").cast("string").alias("key"), F.explode(kinds).alias("v"))
    return rows.select("v.check", "key", "v.detail")


CONTRACT = "breaks the contract"


def checked(pixels: DataFrame, low: float = 0.0, high: float = 1.0, slack: float = 1e-6) -> DataFrame:
    """The pixels; reading one that is not finite or leaves [low, high] raises. No pass of its own."""
    value = F.col("value")
    good = is_finite(value) & (value >= low - slack) & (value <= high + slack)
    told = F.concat_ws(" ", F.lit("value"), value.cast("string"), F.lit("of field"), F.col("fov_key").cast("string"), F.lit(CONTRACT))
    return pixels.withColumn("value", F.when(good, value).otherwise(F.raise_error(told).cast("double")))


def run_hook(pixels: DataFrame, hook: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a user hook and refuse a result that changes the panel or breaks the value contract."""
    out = hook(pixels)
    if set(out.columns) != set(pixels.columns):
        raise ValueError(f"hook changed the columns: {out.columns}")
    violations = value_contract(out).limit(5).collect()
    if violations:
        raise ValueError("hook result breaks the contract: " + "; ".join(f"{v.key}: {v.check} {v.detail}" for v in violations))
    return out.select(pixels.columns)
