"""Reading an image archive's metadata: a tree of ``zarr.json`` files, one set per field.

A field is any directory that holds ``preprocessed/zarr.json``; its path below the root is its
key, whether the tree is flat or nested. Listing and parsing are distributed over the files.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialframes.functions.names import normalize_modality, normalize_tissue
from spatialframes.session import fresh_path

# Names the archive format uses.
META = "zarr.json"
LABEL_SOURCE = "standardized_source"


def _relative(path: Column, root: str) -> Column:
    plain = re.sub(r"^[a-z0-9]+:(//)?", "", root).rstrip("/")
    return F.regexp_extract(path, re.escape(plain) + "/(.*)$", 1)


def _files(spark: SparkSession, root: str, name: str = META) -> DataFrame:
    """Path, length and time of the files; contents are read only where selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    return files.withColumn("rel", _relative(F.col("path"), root))


_WIDE = 512  # directories from which on a task walks all that lies below its own
_FILES = 500  # directories or files of a task
_BYTES = 8 << 20  # text of an Arrow batch


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    n = rows.count()
    return rows.repartition(max(-(-n // _FILES), min(n, 64), 1), "rel"), n


def _listed(spark: SparkSession, root: str, name: str = META) -> DataFrame:
    """``(rel)`` of the files of a name below the root, listed by tasks: no path goes through the driver.

    The tree is opened level by level until it is wide; from there each task walks the directories it has.
    """

    def run(deep: bool):
        def walk(batches):
            import pyarrow as pa
            from pyarrow import fs

            files, base = fs.FileSystem.from_uri(root)
            base = base.rstrip("/")
            schema = pa.schema([("rel", pa.string()), ("folder", pa.bool_())])
            for batch in batches:
                todo = batch.column("rel").to_pylist()
                while todo:
                    above = todo.pop()
                    found = []
                    for info in files.get_file_info(fs.FileSelector(f"{base}/{above}" if above else base)):
                        if _hidden(info.base_name):
                            continue
                        rel = f"{above}/{info.base_name}" if above else info.base_name
                        if info.type == fs.FileType.Directory:
                            todo.append(rel) if deep else found.append((rel, True))
                        elif info.base_name == name:
                            found.append((rel, False))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], schema=schema)

        return walk

    level, n, paths, kind = spark.createDataFrame([("",)], "rel string"), 1, [], "rel string, folder boolean"
    while n:
        deep = n >= _WIDE
        paths.append(fresh_path(spark, "listed"))
        level.mapInArrow(run(deep), kind).write.parquet(paths[-1])
        if deep:
            break
        level, n = _dealt(spark.read.schema(kind).parquet(paths[-1]).where("folder").select("rel"))
    return spark.read.schema(kind).parquet(*paths).where("NOT folder").select("rel")


def _known(root: str) -> bool:
    """Whether tasks can open the root by themselves; else only Spark's readers can."""
    import pyarrow as pa
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    return True


def _documents(spark: SparkSession, root: str, parts: Sequence[str]) -> DataFrame:
    """``(rel, value)`` of the files of some parts of a field, each opened by the task that has its path."""
    wanted = reduce(lambda a, b: a | b, [F.col("rel").endswith(f"/{p}/{META}" if p else f"/{META}") for p in parts])
    if not _known(root):
        text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", META).text(root, wholetext=True)
        return text.select(_relative(F.col("_metadata.file_path"), root).alias("rel"), "value").where(wanted)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        schema = pa.schema([("rel", pa.string()), ("value", pa.binary())])
        for batch in batches:
            rows, size = [], 0
            for rel in batch.column("rel").to_pylist():
                with files.open_input_stream(f"{base}/{rel}") as text:
                    rows.append((rel, text.read()))
                size += len(rows[-1][1])
                if size >= _BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    dealt, _ = _dealt(_listed(spark, root).where(wanted))
    return dealt.mapInArrow(run, "rel string, value binary").withColumn("value", F.col("value").cast("string"))


def write_documents(documents: DataFrame, root: str) -> int:
    """Write ``(rel, value)`` as text files below the root, each by the task that holds it; how many there are.

    A task that runs again writes the same files again.
    """

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for rel, value in zip(batch.column("rel").to_pylist(), batch.column("value").to_pylist(), strict=True):
                files.create_dir(f"{base}/{rel}".rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(f"{base}/{rel}") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return documents.select("rel", "value").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def discover_fovs(spark: SparkSession, root: str) -> DataFrame:
    """``(fov_key)`` of every field below the root."""
    key = F.regexp_extract("rel", "^(.*)/preprocessed/zarr\\.json$", 1)
    files = _listed(spark, root) if _known(root) else _files(spark, root)
    return files.select(key.alias("fov_key")).where(F.col("fov_key") != "")


def _part(documents: DataFrame, part: str) -> DataFrame:
    """``(fov_key, value)`` of one kind of file, by its path below the field."""
    suffix = f"/{part}/{META}" if part else f"/{META}"
    return documents.where(F.col("rel").endswith(suffix)).select(
        F.expr(f"substr(rel, 1, length(rel) - {len(suffix)})").alias("fov_key"), "value"
    )


def _fields(spark: SparkSession, root: str, columns: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per field with what is wanted of its files: ``columns[part][name]`` is taken from the text of that part.

    The tree is read once: a file that belongs to no wanted part is left out by its path, the others are parsed where
    they are read, and the parts of a field meet in one aggregate. The field's own group tells that it is one.
    """
    wanted = {**columns, "preprocessed": {"_field": F.lit(True), **columns.get("preprocessed", {})}}
    documents = _documents(spark, root, list(wanted))
    part = F.lit(None)
    # a longer path wins: the last of the tests below comes first
    for p in sorted(wanted, key=len):
        part = F.when(F.col("rel").endswith(f"/{p}/{META}" if p else f"/{META}"), F.lit(p)).otherwise(part)
    rows = documents.withColumn("part", part).where(F.col("part").isNotNull())
    above = F.length("rel") - F.length("part") - F.when(F.col("part") == "", F.lit(len(META) + 1)).otherwise(F.lit(len(META) + 2))
    rows = rows.withColumn("fov_key", F.substr("rel", F.lit(1), above))
    parsed = [F.when(F.col("part") == p, c).alias(n) for p, named in wanted.items() for n, c in named.items()]
    names = [n for named in wanted.values() for n in named]
    found = rows.select("fov_key", *parsed).groupBy("fov_key").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    return found.where("_field").drop("_field")


def read_metadata(spark: SparkSession, root: str, label_sources: Sequence[str] = (LABEL_SOURCE,)) -> DataFrame:
    """Domain, tissue, annotated type names and presence of a positivity matrix per field.

    Type names are those of any of ``label_sources``.

    A missing file leaves its part empty. Malformed JSON is tolerated as well: it ends the reading
    of that field, so what would have come after it stays at its default.
    """
    attrs = "attributes struct<modality: string, tissue: string>"
    sources = "attributes struct<" + ", ".join(f"{s}: map<string,string>" for s in label_sources) + ">"
    fine = F.try_parse_json("value").isNotNull()
    joined = _fields(
        spark,
        root,
        {
            "": {"_top_ok": fine, "_a": F.when(fine, F.from_json("value", attrs)["attributes"])},
            "cell_types/annotations": {"_notes_ok": fine, "_s": F.when(fine, F.from_json("value", sources)["attributes"])},
            "marker_positivity": {"_mp": F.lit(True)},
        },
    )
    present, good = F.col("_top_ok").isNotNull(), F.coalesce("_top_ok", F.lit(True))
    empty = F.array().cast("array<string>")
    names = F.concat(*[F.coalesce(F.map_keys(F.col("_s")[s]), empty) for s in label_sources])
    names = F.array_sort(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "null"))))
    read = present & good
    domain = F.when(read, normalize_modality(F.coalesce("_a.modality", F.lit("unknown")))).otherwise(F.lit("UNKNOWN"))
    tissue = F.when(read, normalize_tissue(F.coalesce("_a.tissue", F.lit("unknown"))))
    return joined.select(
        F.col("fov_key").alias("key"),
        domain.alias("domain"),
        tissue.alias("tissue"),
        F.when(good & (F.size(names) > 0), names).alias("ct_names"),
        (F.coalesce("_mp", F.lit(False)) & good & F.coalesce("_notes_ok", F.lit(True))).alias("has_mp"),
    )


def read_annotations(spark: SparkSession, root: str, label_sources: Sequence[str] = (LABEL_SOURCE,)) -> DataFrame:
    """``(fov_key, source, ct_name, pos, cell_id, row, col)`` of every annotation entry.

    An entry is a cell id or a [row, col] pair. The first of ``label_sources`` that a field has is
    read, types named "null" are skipped, and so is any entry of another shape.
    """
    notes = _part(_documents(spark, root, ["cell_types/annotations"]), "cell_types/annotations")
    parsed = notes.select("fov_key", F.try_parse_json("value").alias("v"))
    found = [F.try_variant_get("v", f"$.attributes.{s}", "variant") for s in label_sources]
    usable = lambda s: s.isNotNull() & ~F.is_variant_null(s)
    name = F.coalesce(*[F.when(usable(v), F.lit(s)) for s, v in zip(label_sources, found)])
    chosen = parsed.select("fov_key", name.alias("source"), F.coalesce(*[F.when(usable(v), v) for v in found]).alias("s"))
    chosen = chosen.where(F.col("source").isNotNull())

    def spread(df: DataFrame, column: str) -> DataFrame:
        return df.lateralJoin(spark.tvf.variant_explode(F.col(column).outer()))

    types = spread(chosen, "s").select("fov_key", "source", F.col("key").alias("ct_name"), F.col("value").alias("list"))
    types = types.where(F.col("ct_name").isNotNull() & (F.col("ct_name") != "null"))
    entries = spread(types, "list").select("fov_key", "source", "ct_name", "pos", F.col("value").alias("e"))
    kind = F.schema_of_variant("e")
    pair = F.try_variant_get("e", "$", "array<double>")
    is_pair = kind.startswith("ARRAY") & (F.size(pair) == 2)
    is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    rows = entries.select(
        "fov_key",
        "source",
        "ct_name",
        "pos",
        F.when(is_number, F.try_variant_get("e", "$", "double").cast("bigint")).alias("cell_id"),
        F.when(is_pair, pair[0]).alias("row"),
        F.when(is_pair, pair[1]).alias("col"),
    )
    return rows.where(F.col("cell_id").isNotNull() | (F.col("row").isNotNull() & F.col("col").isNotNull()))


def with_fallback(resolved: DataFrame, arrays: DataFrame) -> DataFrame:
    """Rows of the label arrays for the fields the annotations gave nothing for."""
    rest = arrays.join(resolved.select("fov_key").distinct(), "fov_key", "left_anti")
    rest = rest.withColumn("source", F.lit("cell_type_info"))
    return resolved.unionByName(rest, allowMissingColumns=True)


def read_positivity(spark: SparkSession, root: str) -> DataFrame:
    """``(dataset_name, cell_type, marker, value)``; an empty or ragged matrix gives no rows."""
    schema = "attributes struct<markers: array<string>, cell_types: array<string>, positivity_matrix: array<array<string>>>"
    files = _part(_documents(spark, root, ["marker_positivity"]), "marker_positivity")
    a = files.select(F.col("fov_key").alias("dataset_name"), F.from_json("value", schema)["attributes"].alias("a"))
    a = a.select("dataset_name", "a.*")
    width, height = F.size("markers"), F.size("cell_types")
    whole = (width > 0) & (F.size("positivity_matrix") == height) & F.forall("positivity_matrix", lambda r: F.size(r) == width)
    rows = a.where(whole).select("dataset_name", "markers", F.explode(F.arrays_zip("cell_types", "positivity_matrix")).alias("r"))
    cells = rows.select("dataset_name", F.col("r.cell_types").alias("cell_type"), F.explode(F.arrays_zip("markers", "r.positivity_matrix")).alias("c"))
    return cells.select("dataset_name", "cell_type", F.col("c.markers").alias("marker"), F.col("c.positivity_matrix").alias("value"))


def unknown_rows(positivity: DataFrame, vocab: DataFrame) -> DataFrame:
    """Matrix rows whose type no cell can carry, with the datasets that have them."""
    names = positivity.select("cell_type", "dataset_name").distinct()
    unknown = names.join(vocab.where("kind = 'cell_type'").select(F.col("name").alias("cell_type")), "cell_type", "left_anti")
    return unknown.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_datasets"), F.min("dataset_name").alias("example"))


def read_contract(spark: SparkSession, root: str) -> DataFrame:
    """One row per field with what the contract checks look at: shapes, names, attributes, matrix.

    Only metadata files are read, never an image chunk.
    """
    names = "attributes struct<channel_names: array<string>, centroids: string, scale_factor: double>"
    lists = "attributes struct<markers: array<string>, cell_types: array<string>, positivity_matrix: array<array<string>>>"
    image, matrix = F.from_json("value", names)["attributes"], F.from_json("value", lists)["attributes"]
    mask = F.from_json("value", "shape array<bigint>, data_type string")
    out = _fields(
        spark,
        root,
        {
            "preprocessed": {"channel_names": image["channel_names"], "centroids": image["centroids"], "scale_factor": image["scale_factor"]},
            "preprocessed/raw": {"raw_shape": F.from_json("value", "shape array<bigint>")["shape"]},
            "preprocessed/mask": {"mask_shape": mask["shape"], "mask_type": mask["data_type"]},
            "cell_types/annotations": {"has_annotations": F.lit(True), "source": F.from_json("value", f"attributes struct<{LABEL_SOURCE}: string>")["attributes"][LABEL_SOURCE]},
            "marker_positivity": {"has_mp": F.lit(True), "markers": matrix["markers"], "cell_types": matrix["cell_types"], "matrix": matrix["positivity_matrix"]},
        },
    )
    false = F.lit(False)
    return out.withColumn("has_annotations", F.coalesce("has_annotations", false)).withColumn("has_mp", F.coalesce("has_mp", false))


def read_centroids(spark: SparkSession, root: str) -> DataFrame:
    """``(fov_key, scale_factor, cell_id, c_row, c_col)``; the id is the key of the JSON map."""
    schema = "attributes struct<scale_factor: double, centroids: map<string,array<double>>>"
    files = _part(_documents(spark, root, ["preprocessed"]), "preprocessed")
    a = files.select("fov_key", F.from_json("value", schema)["attributes"].alias("a"))
    rows = a.select("fov_key", F.coalesce("a.scale_factor", F.lit(1.0)).alias("scale_factor"), F.explode("a.centroids").alias("k", "p"))
    return rows.select(
        "fov_key", "scale_factor", F.col("k").try_cast("bigint").alias("cell_id"), F.col("p")[0].alias("c_row"), F.col("p")[1].alias("c_col")
    ).where(F.col("cell_id").isNotNull())


# --- registry -------------------------------------------------------------------------------------------------


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``vocab(kind, name, idx)`` from a registry snapshot: types by index, markers and domains in order."""
    schema = "cell_type_mapping map<string,int>, all_standardized_channels array<string>, domains array<string>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    types = doc.select(F.lit("cell_type").alias("kind"), F.explode("cell_type_mapping").alias("name", "idx"))
    markers = doc.select(F.lit("marker").alias("kind"), F.posexplode("all_standardized_channels").alias("idx", "name"))
    domains = doc.select(F.lit("domain").alias("kind"), F.posexplode("domains").alias("idx", "name"))
    return types.unionByName(markers).unionByName(domains)


def read_pairs(spark: SparkSession, path: str, left: str, right: str) -> DataFrame:
    """A flat ``name: value`` file as ``(left, right, ord)``; quotes round either side are dropped."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\\r?\\n")).alias("ord", "line"))
    pattern = "^\\s*['\"]?(.*?)['\"]?\\s*:\\s+['\"]?(.*?)['\"]?\\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = lines.where(~F.col("line").rlike("^\\s*(#.*)?$")).select(part(1).alias(left), part(2).alias(right), F.col("ord").cast("bigint"))
    return rows.where(F.col(left) != "")


def read_aliases(spark: SparkSession, path: str, vocab: DataFrame) -> DataFrame:
    """Aliases of registered markers as ``(alias, target, ord)``."""
    markers = vocab.where("kind = 'marker'").select(F.col("name").alias("target"))
    return read_pairs(spark, path, "alias", "target").join(markers, "target", "left_semi").select("alias", "target", "ord")


def inline_aliases(spark: SparkSession) -> DataFrame:
    """The aliases known without a file; they come before those of a file."""
    from spatialframes.functions.names import INLINE_ALIASES

    rows = [(a, t, i - len(INLINE_ALIASES)) for i, (a, t) in enumerate(INLINE_ALIASES.items())]
    return spark.createDataFrame(rows, "alias string, target string, ord bigint")


# --- fingerprint ----------------------------------------------------------------------------------------------


def combine_digests(digest: Column) -> Column:
    """One digest of a set of hex digests whatever their order, from sums that merge map-side."""
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
    sums = [part(i).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)


def source_fingerprint(spark: SparkSession, root: str, arrays: bool = False, keys: DataFrame | None = None) -> str:
    """Sixteen hex digits that change with any metadata file, and with the content of label arrays.

    ``arrays`` adds size and time of the image and mask chunks, of the fields in ``keys`` only.
    """
    files = _files(spark, root, "*")
    is_meta = F.col("rel").endswith("/" + META) | (F.col("rel") == META)
    stat = F.concat_ws("|", "rel", "length", F.unix_micros("modificationTime"))
    parts = [files.where(is_meta).select(F.sha2(stat, 256).alias("d"))]
    label = F.col("rel").rlike("(^|/)preprocessed/cell_type_info/(cell_type|cell_index)/")
    parts.append(files.where(label).select(F.sha2(F.concat(F.encode("rel", "utf-8"), F.sha2("content", 256).cast("binary")), 256).alias("d")))
    if arrays:
        chunk = files.withColumn("fov_key", F.regexp_extract("rel", "^(.*)/preprocessed/(raw|mask)/", 1)).where(F.col("fov_key") != "")
        if keys is not None:
            chunk = chunk.join(keys.select("fov_key"), "fov_key", "left_semi")
        parts.append(chunk.select(F.sha2(F.concat(F.lit("chunk|"), stat), 256).alias("d")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(combine_digests(F.col("d")).alias("d")).first()[0][:16]
