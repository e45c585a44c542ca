"""Exact copies by recipes of content-defined chunks.

1. A text is cut where its own characters say so: after at least ``LEAST`` characters, at the first place
   whose last nine characters have a given pattern of low bits, after ``MOST`` characters at the latest.
   Copies are cut alike, and texts that share a passage share most of its chunks.
2. Every distinct chunk moves once, after repeats are merged where they are read. Chunks with one hash are
   compared as text; those that differ are numbered. Hash and number are an identifier that is verified.
3. A document is its ordered list of identifiers, about 8 bytes for a thousand characters. Lists are
   grouped, slice by slice of the rows first, so that a list that a third of all rows share is no
   hot key. Texts do not move again.

Only DataFrame functions. Defined results: a null text counts as empty, and empty texts are equal; of rows
with equal texts the smallest id stays, a null id last, and of rows that repeat an id one; every row has its
own result; an empty table gives no rows; long texts have longer lists, of at most one identifier for ``LEAST``
characters but the last; other columns of the input do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.session import settle

LEAST, MOST = 512, 4096  # characters of a chunk
SLICES = 4096  # parts of the rows that share a list

#: A run of white space that is not one single space already.
_UNEVEN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

_ODD = "".join(f"\\x{c:02X}" for c in range(0x21, 0x7F, 2))
_CUT = "".join(f"[{_ODD}]" if bit == "1" else f"[^{_ODD}]" for bit in "101100101")
_CHUNK = f"(?s).{{{LEAST},{MOST}}}?(?<={_CUT})|.{{1,{MOST}}}"

Identify = Callable[[Column], Column]


def normal(text: Column) -> Column:
    """The text with every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " ")


def chunks(text: Column) -> Column:
    """The chunks of a text in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(_CHUNK), F.lit(0))


def _distinct_chunks(docs: DataFrame, text: str, identify: Identify) -> DataFrame:
    pieces = docs.select(F.explode(chunks(normal(F.col(text)))).alias("chunk")).distinct()
    return pieces.select(identify(F.col("chunk")).alias("id"), "chunk")


def ambiguous(docs: DataFrame, text: str = "text", identify: Identify = F.xxhash64) -> DataFrame:
    """``id, chunk, number``: the different chunks that share a hash, numbered from 0 in text order."""
    pieces = _distinct_chunks(docs, text, identify)
    shared = settle(pieces.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("id"))
    if shared.isEmpty():
        return shared.select("id", F.lit("").alias("chunk"), F.lit(0).alias("number"))
    order = Window.partitionBy("id").orderBy("chunk")
    return settle(pieces.join(shared, "id").select("id", "chunk", (F.row_number().over(order) - 1).alias("number")))


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", identify: Identify = F.xxhash64) -> DataFrame:
    """``key, row, recipe, numbers, text_sha256, raw`` of every row, written once.

    ``recipe`` holds the hashes of the chunks in order, ``numbers`` tells apart the chunks of one hash and is empty
    where no hash is shared by different chunks. ``raw`` is the digest of the text as it came.
    """
    unclear = ambiguous(docs, text, identify)
    rows = docs.select(
        F.col(key).alias("key"),
        F.monotonically_increasing_id().alias("row"),
        normal(F.col(text)).alias("text"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("raw"),
    )
    rows = rows.select("key", "row", chunks(F.col("text")).alias("chunks"), F.sha2("text", 256).alias("text_sha256"), "raw")
    known = rows.withColumn("recipe", F.transform("chunks", lambda c: identify(c))).drop("chunks")
    if unclear.isEmpty():
        return settle(known.withColumn("numbers", F.array().cast("array<int>")))
    spread = rows.select("key", "row", "text_sha256", "raw", F.posexplode_outer("chunks").alias("pos", "chunk"))
    spread = spread.withColumn("id", identify(F.col("chunk"))).join(unclear, ["id", "chunk"], "left")
    entry = F.struct("pos", "id", F.coalesce("number", F.lit(0)).alias("number"))
    packed = spread.groupBy("key", "row", "text_sha256", "raw").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), entry))).alias("e"))
    recipe = F.transform("e", lambda e: e["id"]), F.transform("e", lambda e: e["number"])
    return settle(packed.select("key", "row", "text_sha256", "raw", recipe[0].alias("recipe"), recipe[1].alias("numbers")))


def classes(made: DataFrame, slices: int = SLICES) -> DataFrame:
    """The rows of :func:`recipes` with ``keep_id``, ``group_size`` and ``kept``."""
    same = ["recipe", "numbers"]
    sliced = made.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
    first = F.min(F.struct(F.col("key").isNull().alias("missing"), "key", "row"))
    parts = sliced.groupBy(*same, "slice").agg(first.alias("first"), F.count("*").alias("n"))
    whole = parts.groupBy(*same).agg(F.min("first").alias("first"), F.sum("n").alias("group_size"))
    verdicts = parts.select(*same, "slice").join(whole, same)
    judged = sliced.join(verdicts, [*same, "slice"])
    return judged.select(
        *made.columns, F.col("first.key").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept")
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns.

    The documents are joined once with the verdicts of their ids and texts. Only where an id repeats with the
    very same text, one of these rows is taken.
    """
    name = lambda k, digest: F.concat_ws(":", F.coalesce(k.cast("string"), F.lit("~")), digest)
    judged = classes(recipes(docs, key, text))
    verdicts = judged.groupBy(name(F.col("key"), F.col("raw")).alias("__name")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
    verdicts = settle(verdicts.where("__kept").drop("__kept"))
    named = docs.withColumn("__name", name(F.col(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    once = named.join(verdicts.where(F.col("__rows") == 1), "__name")
    repeated = named.join(verdicts.where(F.col("__rows") > 1), "__name").dropDuplicates(["__name"])
    return once.unionByName(repeated).select(docs.columns)


def op11(spark, sf_dir: str) -> DataFrame:
    from spatialframes.llm.common import read

    judged = classes(recipes(read(spark, sf_dir, "documents", "doc_id", "text")))
    return judged.select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t
"""
