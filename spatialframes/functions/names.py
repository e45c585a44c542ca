"""Name resolution and naming conventions, as joins and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.session import settle

# Aliases known without an alias file.
INLINE_ALIASES = {
    "CgA": "CHGA",
    "DC-SIGN": "CD209",
    "DCSIGN": "CD209",
    "Galectin-9": "Galectin9",
    "HO-1": "HO1",
    "Pan-Cytokeratin": "PanCK",
    "PANCK": "PanCK",
}

# Channels that carry no marker.
CONTROL_CHANNELS = ["H3", "HISTONEH3", "HISTONE H3", "RABBIT IGG", "GOAT IGG", "MOUSE IGG"]
CONTROL_PREFIXES = [
    "BLANK",
    "CH2",
    "CH3",
    "DAPI",
    "DNA",
    "DRAQ",
    "EMPTY",
    "EMPYT",
    "HOECHST",
    "IR",
]


def alias_lookup(markers: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact and lower-case lookup tables ``(key, target)``, one row per key.

    ``markers(name, idx)`` is the registry, ``aliases(alias, target, ord)`` the alias list; an
    alias whose target is not registered is ignored. A spelling listed twice keeps its first place
    and takes its last target; ignoring case, the spelling with the first place wins.
    """
    known = aliases.join(markers.select(F.col("name").alias("target")), "target", "left_semi")
    known = known.groupBy("alias").agg(F.max_by("target", "ord").alias("target"), F.min("ord").alias("ord"))
    exact = markers.select(F.col("name").alias("key"), F.lit(0).alias("prio"), F.lit(0).alias("ord"), F.col("name").alias("target"))
    exact = exact.unionByName(
        known.select(F.col("alias").alias("key"), F.lit(1).alias("prio"), "ord", "target")
    )
    lower = markers.select(
        F.lower("name").alias("key"), F.lit(2).alias("prio"), (-F.col("idx")).alias("ord"), F.col("name").alias("target")
    ).unionByName(
        known.select(F.lower("alias").alias("key"), F.lit(3).alias("prio"), "ord", "target")
    )

    def pick(table: DataFrame) -> DataFrame:
        return table.groupBy("key").agg(F.min_by("target", F.struct("prio", "ord", "target")).alias("target"))

    return pick(exact), pick(lower)


def resolve_channels(df: DataFrame, column: str, markers: DataFrame, aliases: DataFrame, out: str = "marker") -> DataFrame:
    """Registered marker for each channel name: exact, alias, then the same ignoring case."""
    exact, lower = alias_lookup(markers, aliases)
    exact = exact.select(F.col("key").alias("_k_exact"), F.col("target").alias("_t_exact"))
    lower = lower.select(F.col("key").alias("_k_lower"), F.col("target").alias("_t_lower"))
    named = df.join(exact, F.col(column) == F.col("_k_exact"), "left")
    named = named.join(lower, (F.lower(column) == F.col("_k_lower")) & (F.col(column) != ""), "left")
    return named.withColumn(out, F.coalesce("_t_exact", "_t_lower")).drop("_k_exact", "_t_exact", "_k_lower", "_t_lower")


def resolve_strict(df: DataFrame, column: str, markers: DataFrame, out: str = "marker_idx") -> DataFrame:
    """Registry index by exact name, -1 when the name is not registered."""
    index = markers.select(F.col("name").alias("_k"), F.col("idx").alias("_i"))
    joined = df.join(index, F.col(column) == F.col("_k"), "left")
    return joined.withColumn(out, F.coalesce(F.col("_i"), F.lit(-1)).cast("int")).drop("_k", "_i")


def is_control_channel(channel: Column) -> Column:
    name = F.upper(F.trim(channel))
    return name.isin(CONTROL_CHANNELS) | name.rlike("^(" + "|".join(CONTROL_PREFIXES) + ")")


def normalize_tissue(tissue: Column) -> Column:
    """Lower case without any blank; the one spelling used for tissues throughout."""
    return F.replace(F.trim(F.lower(tissue)), F.lit(" "), F.lit(""))


def normalize_modality(modality: Column) -> Column:
    return F.upper(F.trim(modality))


def parse_patient_id(*names: Column) -> Column:
    """Shortest prefix that ends in ``Patient<number>``, from the first name that has one."""
    found = [F.nullif(F.regexp_extract(n, r"^(.*?Patient\d+)", 1), F.lit("")) for n in names]
    return F.coalesce(*found)


def stable_hash(entries: Column, length: int = 16) -> Column:
    """Leading hex digits of the SHA-256 of a string map written as JSON with sorted keys."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(entries)))
    return F.substring(F.sha2(F.to_json(ordered), 256), 1, length)


def names_by_index(mapping: Column) -> Column:
    """Names of a name -> index map, in the order of the index."""
    pairs = F.transform(F.map_entries(mapping), lambda e: F.struct(e["value"].alias("i"), e["key"].alias("n")))
    return F.transform(F.array_sort(pairs), lambda p: p["n"])


def centroid_map(text: Column) -> Column:
    """``{"12": [row, col]}`` as an array of (cell_id, row, col); keys that are no integer drop."""
    parsed = F.map_entries(F.from_json(text, "map<string,array<double>>"))
    rows = F.transform(
        parsed,
        lambda e: F.struct(
            e["key"].try_cast("bigint").alias("cell_id"),
            e["value"][0].alias("c_row"),
            e["value"][1].alias("c_col"),
        ),
    )
    return F.filter(rows, lambda r: r["cell_id"].isNotNull())


def list_supported(vocab: DataFrame, kind: str) -> DataFrame:
    """Registered names of one kind, sorted."""
    return vocab.where(F.col("kind") == kind).select("name").distinct().orderBy("name")


def index_names(df: DataFrame, column: str, out: str = "idx") -> DataFrame:
    """Distinct names with their zero-based position in sorted order.

    The names are dealt by ranges and written once; each range is numbered by itself, after the names of those before it.
    """
    names = df.select(F.col(column).alias("name")).where(F.col(column).isNotNull()).distinct()
    dealt = settle(names.repartitionByRange("name").withColumn("_range", F.spark_partition_id()))
    # one row a range
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("_low"))
    earlier = Window.orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy("name")) - 1
    placed = dealt.withColumn("_at", number).join(F.broadcast(before), "_range")
    return placed.select("name", (F.col("_before") + F.col("_at")).cast("int").alias(out))


# The texts an embedding service is asked to encode.
MARKER_PROMPT = (
    "The protein biomarker %s is used in multiplexed immunofluorescence "
    "imaging for cell type identification in tissue samples."
)
CELL_TYPE_PROMPT = (
    "The cell type %s as identified in multiplexed immunofluorescence "
    "imaging of human tissue samples."
)


def marker_prompt(marker: Column) -> Column:
    return F.format_string(MARKER_PROMPT, marker)


def cell_type_prompt(cell_type: Column) -> Column:
    return F.format_string(CELL_TYPE_PROMPT, cell_type)
