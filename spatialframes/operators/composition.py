"""Cohort quality control: composition of fields, channel scans, plausibility against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.functions.quantiles import exact_quantiles
from spatialframes.session import settle

# Fixed value: share above which a type without its marker in the panel is suspicious.
UNSUPPORTED_SHARE = 0.10


def composition(cells: DataFrame, name: str = "name", fov: str = "fov_key") -> DataFrame:
    """Count and share of each type per field; the window runs over the types of one field."""
    counts = cells.groupBy(fov, name).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(fov))
    return counts.withColumn("share", F.col("n") / total)


def lineage_composition(cells: DataFrame, coarse: DataFrame, other: str = "Other") -> DataFrame:
    """The same for broad lineages; ``coarse(fine, coarse)`` maps types, the rest is ``other``.

    Types are counted first, so the map meets a few rows per field.
    """
    fine = cells.groupBy("fov_key", "name").agg(F.count(F.lit(1)).alias("n"))
    fine = fine.join(coarse.select(F.col("fine").alias("name"), "coarse"), "name", "left")
    grouped = fine.groupBy("fov_key", F.coalesce("coarse", F.lit(other)).alias("lineage")).agg(F.sum("n").alias("n"))
    return grouped.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("fov_key")))


def fov_confidence(cells: DataFrame) -> DataFrame:
    """Abstention rate and mean confidence per field."""
    return cells.groupBy("fov_key").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.avg(F.col("abstained").cast("double")).alias("abstention_rate"),
        F.avg("confidence").alias("mean_confidence"),
    )


def channel_scan(pixels: DataFrame) -> DataFrame:
    """How widespread a channel is and its dynamic range: positive share, median, p99 and their ratio."""
    positive = pixels.groupBy("fov_key", "channel").agg(F.avg((F.col("value") > 0).cast("double")).alias("positive_share"))
    tails = exact_quantiles(pixels, ["fov_key", "channel"], "value", {"median": 0.5, "p99": 0.99}).drop("n_values")
    joined = positive.join(tails, ["fov_key", "channel"])
    return joined.withColumn("dynamic_range", F.when(F.col("median") != 0, F.col("p99") / F.col("median")))


def expectations(fovs: DataFrame, biology: DataFrame, panel: DataFrame, lineage_markers: DataFrame, classes: DataFrame) -> DataFrame:
    """What each field should show, from inputs only: tissue, panel and the classes of the model.

    ``biology(tissue, lineage, role)`` with roles present, dominant, implausible, absent;
    ``classes(name, lineage)``. A lineage the model has no class for is never expected, and one
    without a marker in the panel is not expected to be present.
    """
    known = classes.select("lineage").distinct()
    wanted = fovs.select("fov_key", "tissue").join(biology, "tissue").join(known, "lineage", "left_semi")
    seen = panel.join(lineage_markers, "marker").select("fov_key", "lineage").distinct().withColumn("detectable", F.lit(True))
    joined = wanted.join(seen, ["fov_key", "lineage"], "left").withColumn("detectable", F.coalesce("detectable", F.lit(False)))
    kept = joined.where(F.col("detectable") | F.col("role").isin("implausible", "absent"))
    return kept.select("fov_key", "lineage", "role")


def plausibility(expected: DataFrame, lineages: DataFrame, noise: float = 0.02) -> DataFrame:
    """Violations ``(check, key, detail)`` of the frozen expectations by the composition found.

    A dominant lineage need not win, but one of those listed has to exceed the noise.
    """
    expected, lineages = settle(expected), settle(lineages)  # a few rows per field, read twice
    joined = expected.join(lineages.select("fov_key", "lineage", "share"), ["fov_key", "lineage"], "left")
    joined = joined.withColumn("share", F.coalesce("share", F.lit(0.0)))
    top = lineages.groupBy("fov_key").agg(F.max_by("lineage", F.struct("n", "lineage")).alias("_top"))
    joined = joined.join(top, "fov_key", "left")
    role, share = F.col("role"), F.col("share")
    check = (
        F.when((role == "present") & (share <= 0), F.lit("expected_missing"))
        .when((role == "implausible") & (F.col("_top") == F.col("lineage")), F.lit("implausible_majority"))
        .when((role == "absent") & (share > noise), F.lit("must_be_absent"))
    )
    rows = joined.select(check.alias("check"), F.col("fov_key").cast("string").alias("key"), F.col("lineage").alias("detail"))
    rows = rows.where(F.col("check").isNotNull())
    dominant = joined.where(role == "dominant").groupBy("fov_key").agg(F.max("share").alias("best"))
    none = dominant.where(F.col("best") <= noise)
    return rows.unionByName(
        none.select(F.lit("no_dominant").alias("check"), F.col("fov_key").cast("string").alias("key"), F.lit("").alias("detail"))
    )


def unsupported_types(
    types: DataFrame, type_markers: DataFrame, panel: DataFrame, caveats: DataFrame, limit: float = UNSUPPORTED_SHARE
) -> DataFrame:
    """Types above ``limit`` none of whose defining markers the panel has.

    ``caveats(fov_key, name)`` lists those expected all the same: they are coverage notes, the
    others candidates for a fix.
    """
    frequent = types.where(F.col("share") > limit).select("fov_key", "name", "share")
    defined = frequent.join(type_markers.select("name").distinct(), "name", "left_semi")
    held = frequent.join(type_markers, "name").join(panel.select("fov_key", "marker"), ["fov_key", "marker"], "left_semi")
    flagged = defined.join(held.select("fov_key", "name").distinct(), ["fov_key", "name"], "left_anti")
    noted = caveats.select("fov_key", "name").distinct().withColumn("_c", F.lit(True))
    flagged = flagged.join(noted, ["fov_key", "name"], "left")
    return flagged.select("fov_key", "name", "share", F.when(F.col("_c"), F.lit("caveat")).otherwise(F.lit("candidate")).alias("kind"))


def config_delta(before: DataFrame, after: DataFrame, wanted: DataFrame) -> DataFrame:
    """Change of each lineage between two configurations and whether it went the wanted way.

    ``wanted(lineage, direction)`` with +1 or -1; a lineage it lacks has no wanted way.
    """
    b = before.select("fov_key", "lineage", F.col("share").alias("before"))
    a = after.select("fov_key", "lineage", F.col("share").alias("after"))
    joined = b.join(a, ["fov_key", "lineage"], "full").join(wanted, "lineage", "left")
    joined = joined.withColumn("before", F.coalesce("before", F.lit(0.0))).withColumn("after", F.coalesce("after", F.lit(0.0)))
    change = F.col("after") - F.col("before")
    return joined.select("fov_key", "lineage", "before", "after", change.alias("change"), (F.signum(change) == F.col("direction")).alias("as_wanted"))


def delta_verdict(delta: DataFrame) -> DataFrame:
    """Per field, how many lineages moved the wanted way; an edit is trusted when several do."""
    return delta.groupBy("fov_key").agg(
        F.count_if("as_wanted").alias("n_wanted"), F.count_if(~F.col("as_wanted")).alias("n_against")
    )
