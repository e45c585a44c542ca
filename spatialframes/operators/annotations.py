"""Joining annotations to cells, by id or by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.operators.quality import violations

# Fixed value: how far, in pixels, a placed annotation may lie from the centroid it means.
CENTROID_TOLERANCE = 1.5


def ann_by_id(annotations: DataFrame, cells: DataFrame) -> DataFrame:
    """Every annotation with its cell; ``matched`` is false when the cell does not exist."""
    known = cells.select("fov_key", "cell_id", "c_row", "c_col", F.lit(True).alias("matched"))
    joined = annotations.join(known, ["fov_key", "cell_id"], "left")
    return joined.withColumn("matched", F.coalesce("matched", F.lit(False)))


def scale_marks(marks: DataFrame, fovs: DataFrame) -> DataFrame:
    """Bring annotation coordinates to the resolution of the centroids; no factor means 1."""
    factor = fovs.select("fov_key", "scale_factor")
    joined = marks.join(factor, "fov_key", "left")
    scale = F.coalesce("scale_factor", F.lit(1.0))
    return joined.withColumn("row", F.col("row") * scale).withColumn("col", F.col("col") * scale).drop("scale_factor")


_DENSE = 64  # places per grid cell above which the cell is refined instead of joined whole
_FACTOR = 4  # refinement per axis and level
_MAX_LEVELS = 12


def _gap(low: Column, high: Column, at: Column) -> tuple[Column, Column]:
    """Smallest and largest distance on one axis from a point to an interval."""
    return F.greatest(low - at, at - high, F.lit(0.0)), F.greatest(F.abs(at - low), F.abs(at - high))


def _search(marks: DataFrame, cells: DataFrame, tol: float, bounds) -> DataFrame:
    """Best cell of each annotated position over a grid as wide as the tolerance.

    Equal positions are joined once, whatever the number of annotations or cells that share them,
    and a position looks into the nine grid cells round its own, so the join is an equi join.
    Where a grid cell holds many places it is refined: a level of boxes replaces the places, and
    only the boxes that can still hold the best one are opened. ``bounds(box)`` gives (possible,
    lower, upper) bounds of the score of the places in a box; the lowest score wins.
    """
    keys = ["fov_key", "row", "col"]
    spots = marks.select(*keys).distinct()
    places = cells.groupBy("fov_key", "c_row", "c_col").agg(F.min("cell_id").alias("cell_id"))
    width = tol * (1 + 1e-9)  # rounding must not push a neighbour out of the nine grid cells

    def grid(level: int, row: Column, col: Column) -> tuple[Column, Column]:
        # keys of all levels come from the finest one, so boxes nest exactly
        fine = width / _FACTOR**_MAX_LEVELS
        up = F.lit(float(_FACTOR ** (_MAX_LEVELS - level)))
        return F.floor(F.floor(row / fine) / up), F.floor(F.floor(col / fine) / up)

    def boxes(level: int) -> DataFrame:
        r, c = grid(level, F.col("c_row"), F.col("c_col"))
        pr, pc = grid(max(level - 1, 0), F.col("c_row"), F.col("c_col"))
        keyed = places.select("*", r.alias("_r"), c.alias("_c"), pr.alias("_pr"), pc.alias("_pc"))
        return keyed.groupBy("fov_key", "_r", "_c", "_pr", "_pc").agg(
            F.min("c_row").alias("_r0"), F.max("c_row").alias("_r1"), F.min("c_col").alias("_c0"), F.max("c_col").alias("_c1"),
            F.min("cell_id").alias("_id"), F.count(F.lit(1)).alias("_n"),
        )

    depth = -1  # -1: join the places themselves
    while depth < _MAX_LEVELS - 1:
        crowded = boxes(depth + 1).agg(F.max("_n")).first()[0] or 0
        if crowded <= _DENSE:
            break
        depth += 1

    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    r, c = grid(0, F.col("row"), F.col("col"))
    near = spots.select("*", r.alias("_pr"), c.alias("_pc"))
    near = near.withColumn("_dr", F.explode(around)).withColumn("_dc", F.explode(around))
    near = near.select(*keys, (F.col("_pr") + F.col("_dr")).alias("_pr"), (F.col("_pc") + F.col("_dc")).alias("_pc"))

    for level in range(depth + 1):
        opened = boxes(level).select("fov_key", "_pr", "_pc", "_r", "_c", "_r0", "_r1", "_c0", "_c1", "_id")
        possible, lower, upper = bounds(*(F.col(x) for x in ("_r0", "_r1", "_c0", "_c1", "_id")))
        met = near.join(opened, ["fov_key", "_pr", "_pc"]).where(possible)
        met = met.withColumn("_lower", lower).withColumn("_best", F.min(upper).over(Window.partitionBy(*keys)))
        kept = met.where(F.col("_best").isNull() | (F.col("_lower") <= F.col("_best")))
        near = kept.select(*keys, F.col("_r").alias("_pr"), F.col("_c").alias("_pc"))

    r, c = grid(max(depth, 0), F.col("c_row"), F.col("c_col"))
    leaves = places.select("*", r.alias("_pr"), c.alias("_pc"))
    possible, lower, _ = bounds(F.col("c_row"), F.col("c_row"), F.col("c_col"), F.col("c_col"), F.col("cell_id"))
    pairs = near.join(leaves, ["fov_key", "_pr", "_pc"]).where(possible)
    return pairs.groupBy(*keys).agg(F.min_by("cell_id", F.struct(lower, F.col("cell_id"))).alias("cell_id"))


def nearest_centroid(marks: DataFrame, cells: DataFrame, tol: float = CENTROID_TOLERANCE) -> DataFrame:
    """Nearest cell strictly closer than ``tol``, the smaller id on ties; NULL when there is none."""

    def bounds(r0, r1, c0, c1, _):
        (r_min, r_max), (c_min, c_max) = _gap(r0, r1, F.col("row")), _gap(c0, c1, F.col("col"))
        low, high = F.sqrt(r_min * r_min + c_min * c_min), F.sqrt(r_max * r_max + c_max * c_max)
        return low < tol, low, F.when(high < tol, high)

    return marks.join(_search(marks, cells, tol, bounds), ["fov_key", "row", "col"], "left")


def nearest_box(marks: DataFrame, cells: DataFrame, tol: float = 0.5) -> DataFrame:
    """First cell in id order closer than ``tol`` on both axes."""

    def bounds(r0, r1, c0, c1, first_id):
        (r_min, r_max), (c_min, c_max) = _gap(r0, r1, F.col("row")), _gap(c0, c1, F.col("col"))
        whole = (r_max < tol) & (c_max < tol)
        return (r_min < tol) & (c_min < tol), first_id, F.when(whole, first_id)

    return marks.join(_search(marks, cells, tol, bounds), ["fov_key", "row", "col"], "left")


def annotation_collapse(resolved: DataFrame) -> DataFrame:
    """One label per cell: agreeing duplicates collapse, a cell with two labels is dropped.

    ``resolved(fov_key, cell_id, ct_name, pos)``; ``duplicates`` counts the collapsed entries.
    """
    grouped = resolved.groupBy("fov_key", "cell_id").agg(
        F.min("ct_name").alias("ct_name"), F.max("ct_name").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    agreed = grouped.where(F.col("ct_name") == F.col("_last"))
    return agreed.select("fov_key", "cell_id", "ct_name", (F.col("_n") - 1).alias("duplicates"))


def collapse_counters(resolved: DataFrame) -> DataFrame:
    """Per field: cells labelled, duplicates collapsed, conflicting cells dropped."""
    grouped = resolved.groupBy("fov_key", "cell_id").agg(
        F.min("ct_name").alias("_first"), F.max("ct_name").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    same = F.col("_first") == F.col("_last")
    return grouped.groupBy("fov_key").agg(
        F.count_if(same).alias("n_labeled"),
        F.sum(F.when(same, F.col("_n") - 1).otherwise(F.lit(0))).alias("n_duplicates"),
        F.count_if(~same).alias("n_conflicts"),
    )


def resolve_annotations(
    annotations: DataFrame, cells: DataFrame, fovs: DataFrame, tol: float = CENTROID_TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """Labels of the annotated cells, and every attempt to match an entry.

    Entries that carry a ``cell_id`` are matched by it, the others by position, scaled by the field's
    factor. Returns the collapsed labels and ``attempts(fov_key, kind, cell_id)``, the input of the
    drop-rate check; an entry without a match has a NULL cell there.
    """
    cols = ["fov_key", "cell_id", "ct_name", "pos", "kind"]
    ids = ann_by_id(annotations.where(F.col("cell_id").isNotNull()).select("fov_key", "cell_id", "ct_name", "pos"), cells)
    ids = ids.withColumn("cell_id", F.when(F.col("matched"), F.col("cell_id"))).withColumn("kind", F.lit("id"))
    marks = annotations.where(F.col("cell_id").isNull()).select("fov_key", "ct_name", "pos", "row", "col")
    near = nearest_centroid(scale_marks(marks, fovs), cells, tol).withColumn("kind", F.lit("centroid"))
    attempts = ids.select(cols).unionByName(near.select(cols))
    return annotation_collapse(attempts.where(F.col("cell_id").isNotNull())), attempts.select("fov_key", "kind", "cell_id")


def cell_index(labels: DataFrame, cells: DataFrame, fovs: DataFrame, types: DataFrame) -> DataFrame:
    """``labeled_cells``: cells with a registered label and a field with a domain, one row each.

    ``fovs(fov_key, domain, tissue)``, ``types(name)``; the field key is dataset and field name.
    """
    known = labels.join(types.select(F.col("name").alias("ct_name")).distinct(), "ct_name", "left_semi")
    placed = known.join(cells.select("fov_key", "cell_id", "c_row", "c_col"), ["fov_key", "cell_id"])
    named = placed.join(fovs.select("fov_key", "domain", "tissue"), "fov_key")
    return named.select(
        F.col("fov_key").alias("dataset_name"), F.col("fov_key").alias("fov_name"), "domain", "tissue", "cell_id",
        F.col("ct_name").alias("ct_label"), "c_row", "c_col",
    )


# --- per-field name lists -----------------------------------------------------------------------------------


def dataset_types(fovs: DataFrame) -> DataFrame:
    """Sorted distinct type names of each dataset, known or not."""
    names = fovs.select("key", F.explode("ct_names").alias("name")).where(F.col("name").isNotNull()).distinct()
    return names.groupBy("key").agg(F.array_sort(F.collect_set("name")).alias("ct_names"))


def tissue_types(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sorted known types of each tissue from ``rows(tissue, name)``; a tissue left empty disappears."""
    pairs = rows.where(F.col("tissue").isNotNull()).select("tissue", "name").distinct()
    known = pairs.join(vocab.select("name").distinct(), "name", "left_semi")
    return known.groupBy("tissue").agg(F.array_sort(F.collect_set("name")).alias("ct_names"))


def tissue_types_train(rows: DataFrame, splits: DataFrame, vocab: DataFrame) -> DataFrame:
    """The same from the fields of the train split only."""
    train = splits.where(F.col("split") == "train").select("dataset_name", "fov_name")
    return tissue_types(rows.join(train, ["dataset_name", "fov_name"], "left_semi"), vocab)


def domain_fallback(fovs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Domain of each field: from the mapping, else from its own attribute; without either it drops.

    ``fovs(fov_key, modality)``, ``mapping(fov_key, domain)``.
    """
    joined = fovs.join(mapping.select("fov_key", "domain"), "fov_key", "left")
    domain = F.nullif(F.coalesce("domain", F.upper(F.trim("modality"))), F.lit(""))
    return joined.withColumn("domain", domain).where(F.col("domain").isNotNull())


# Published datasets with the names their papers use and the registered ones;
# the last entry tells whether the two name the same thing.
DATASET_CANONICAL = [
    ("codex_colon", "colon", "CODEX", "colon", "codex", True),
    ("mibi_breast", "breast", "MIBI-TOF", "breast", "mibi", True),
    ("mibi_decidua", "decidua (maternal-fetal interface)", "MIBI-TOF", "uterus", "mibi", False),
    ("vectra_colon", "colon", "Vectra (Akoya, Opal multispectral IF)", "colon", "cycif", False),
    ("vectra_pancreas", "pancreas", "Vectra (Akoya, Opal multispectral IF)", "pancreas", "cycif", False),
]


def dataset_canonical(spark) -> DataFrame:
    schema = "dataset_key string, tissue_paper string, modality_paper string, tissue string, modality string, is_direct boolean"
    return spark.createDataFrame(DATASET_CANONICAL, schema)


def canonical_violations(datasets: DataFrame, canonical: DataFrame, vocab: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Violations ``(check, key, detail)`` of :func:`canonical_metadata`: a dataset that is not listed, with ``strict`` one
    whose names were substituted, and with ``vocab(kind, name)`` a tissue or modality that is not registered."""
    joined = datasets.select("dataset_key").distinct().join(canonical, "dataset_key", "left")
    kinds = {"not_listed": (F.col("tissue").isNull(), F.lit(""))}
    if strict:
        kinds["substituted"] = (~F.col("is_direct"), F.concat_ws(", ", "tissue_paper", "modality_paper"))
    for kind, column in (("tissue", "tissue"), ("domain", "modality")) if vocab is not None else ():
        known = vocab.where(F.col("kind") == kind).select(F.col("name").alias(column), F.lit(True).alias(f"_{kind}"))
        joined = joined.join(known, column, "left")
        kinds[f"unregistered_{column}"] = (F.col(column).isNotNull() & F.col(f"_{kind}").isNull(), F.col(column))
    return violations(joined, F.col("dataset_key"), kinds)


def canonical_metadata(datasets: DataFrame, canonical: DataFrame, strict: bool = False, vocab: DataFrame | None = None) -> DataFrame:
    """Registered tissue and modality per dataset. An unknown dataset is refused, with ``strict`` also a substituted
    name, and with a vocabulary a resolved name that is not part of it."""
    bad = canonical_violations(datasets, canonical, vocab, strict).orderBy("check", "key").limit(5).collect()
    if bad:
        raise ValueError(f"no {'direct ' if strict else ''}registered name for " + "; ".join(f"{r['key']}: {r['check']} {r['detail']}".strip() for r in bad))
    return datasets.join(canonical, "dataset_key", "left")
