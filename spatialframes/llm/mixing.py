"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source_size`` times. The expected copies are summed
up over the documents of the source, one offset per source is added, and a document is emitted once
for every integer that the sum crosses at it. A document so gets the expected number of copies
rounded down or up, and documents that lie next to each other in the order share the rounding. The
order goes by size class, so the words taken follow the target closely, not only the copies.

The running sum never sees a whole source in one task: a size class of a source is cut into slices by
the digest of the id, as many as its row count asks for; slice totals give what lies before a slice.

Only DataFrame functions. Defined results: a null source is a source of its own, after all others; a
null text has size 0 and takes 0 words; an empty table gives no rows; rows that repeat an id are
documents of their own; a source without words has target 0. Columns of the input that are not asked
for pass through unless they have one of the names of the result, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.session import settle

ROWS_PER_SLICE = 20_000


def _digest(*parts: Column) -> Column:
    """48 bits of the digest of the parts, as a long."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """Classes that are at most a sixteenth of their size wide."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 5, F.lit(0))
    return bits * 32 + F.floor(size / F.pow(F.lit(2.0), shift)).cast("int")


def source_targets(totals: DataFrame, weights: Sequence[float] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``.

    Sources in code point order (null last) take the weights in turn and share the size of all by
    weight. No target exceeds ``most_copies`` times its source; what is above goes to the others by
    weight until none is above. That is the level at which ``min(limit, level * weight)`` adds up to
    the whole: sorted by limit per weight, it is the highest level that a source would see if all
    before it stood at their limits.

    The table has one row per source, as the configuration of a mix has.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    table = totals.withColumn("__turn", turn)
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("__turn") + 1))
    table = table.withColumn("__limit", F.col("source_size") * most_copies)
    order = Window.orderBy(F.col("__limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("__limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.withColumn("__level", (F.sum("source_size").over(whole) - before) / rest)
    level = F.max("__level").over(whole)
    target = F.least(F.col("__limit").cast("double"), level * F.col("weight"))
    return table.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    weights: Sequence[float] = (1, 2, 3),
    most_copies: int = 3,
    seed: int = 17,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The documents with ``size, source_size, target, copies, taken``."""
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")]
    rows = docs.select(*kept, size.cast("long").alias("size"))
    rows = rows.withColumn("__class", size_class(F.col("size"))).withColumn("__order", _digest(F.lit(seed), F.col("doc_id")))
    classes = settle(rows.groupBy("source", "__class").agg(F.count("*").alias("__n"), F.sum("size").alias("__size")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("__size").alias("source_size")), weights, most_copies)
    targets = settle(targets)

    cut = F.ceil(F.col("__n") / rows_per_slice).cast("long")
    counts = classes.select(F.col("source").alias("__s"), F.col("__class").alias("__c"), cut.alias("__slices"))
    rows = rows.join(counts, rows["source"].eqNullSafe(counts["__s"]) & (rows["__class"] == counts["__c"])).drop("__s", "__c")
    rows = rows.withColumn("__slice", F.col("__order") % F.col("__slices")).drop("__slices")

    per_slice = rows.groupBy("source", "__class", "__slice").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("source").orderBy("__class", "__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slice.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    before = before.join(targets.withColumnRenamed("source", "__t"), F.col("source").eqNullSafe(F.col("__t")))
    offset = (_digest(F.lit(seed), F.lit("offset"), F.col("source")) % (1 << 20)) / float(1 << 20)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    before = before.select(
        F.col("source").alias("__s"), F.col("__class").alias("__c"), F.col("__slice").alias("__l"),
        "__before", "source_size", "target", offset.alias("__offset"), rate.alias("__rate"),
    )
    before = settle(before)

    inside = Window.partitionBy("source", "__class", "__slice").orderBy("size", "__order", "doc_id")
    rows = rows.withColumn("__place", F.row_number().over(inside))
    same = rows["source"].eqNullSafe(before["__s"]) & (rows["__class"] == before["__c"]) & (rows["__slice"] == before["__l"])
    rows = rows.join(before, same)
    place = F.col("__before") + F.col("__place")
    crossed = F.floor(F.col("__offset") + place * F.col("__rate")) - F.floor(F.col("__offset") + (place - 1) * F.col("__rate"))
    copies = F.least(crossed.cast("long"), F.lit(most_copies).cast("long"))
    return rows.select(*kept, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per copy."""
    return mixed.where(F.col("copies") > 0).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy")).select(*columns)


def op2(spark, sf_dir: str) -> DataFrame:
    from spatialframes.llm.common import read, word_count

    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    sizes = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")))
    return mix(sizes, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), c AS (
  SELECT *, length(bin(size)) AS bits, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS ord FROM d
), k AS (
  SELECT *, bits * 32 + floor(size / pow(2.0, greatest(bits - 5, 0)))::INT AS class FROM c
), s AS (
  SELECT *, ord % ceil(count(*) OVER (PARTITION BY source, class) / 20000)::BIGINT AS slice FROM k
), t AS (
  SELECT source, sum(size)::BIGINT AS source_size, [1.0::DOUBLE, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM t WINDOW o AS (ORDER BY source_size * 3 / weight, source NULLS LAST)
), g AS (
  SELECT source, source_size, least((source_size * 3)::DOUBLE, max(level) OVER () * weight) AS target,
    (('0x' || substr(md5('17|offset|' || coalesce(source, '')), 1, 12))::BIGINT % 1048576) / 1048576.0::DOUBLE AS off
  FROM l
), p AS (
  SELECT s.*, row_number() OVER (PARTITION BY source ORDER BY class, slice, size, ord, doc_id) AS place FROM s
), r AS (
  SELECT p.doc_id, p.size, g.source_size, g.target, g.off, p.place,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, least((floor(off + place * rate) - floor(off + (place - 1) * rate))::BIGINT, 3) * size AS taken FROM r
"""
