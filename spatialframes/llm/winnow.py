"""Line dedup by winnowing: later copies of runs of lines are deleted.

A *window* is the shortest run of lines from a given line on that has ``least_lines`` lines or
``least_words`` words; lines without a word are not counted and not deleted. A *closing* window is
the shortest such run up to a given line. Where two documents share a run that holds a window, they
share that window, because a window follows from its own lines.

1. Of every window the smallest line hash is selected: a guaranteed fingerprint of each shared run.
2. The positions of a fingerprint are joined: fingerprints with one position only are left out.
3. From the positions that stay, matches are extended to both sides (``extend``): every window and
   closing window that the fingerprint was selected from is compared with the earliest equal one. In
   a shared run of that size every line up to the start of the run's last closing window starts a
   window inside the run, and that closing window holds the others. So the union of what equals an
   earlier window is every maximal repeated run, however long it is and whichever earlier documents
   its parts come from. Without ``extend`` closing windows are left out: lines at the end of a run
   that are too few for a window of their own stay.
4. The lines of that union are deleted. Each has an equal line in an earlier document or further up.

Comparing with the earliest window instead of all pairs keeps every stage linear in the lines, also
for a run that a third of all documents share.

Order: by ``doc_id`` (null last), then by the text's digest, then by line. Defined results: null and
empty texts stay as they are; rows with equal id and text are one document, and each gets the same
result; an empty table gives no rows; all columns pass through, except those named ``n_lines`` and
``n_deleted``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from spatialframes.llm.common import read, signed, slices
from spatialframes.session import settle

RESULTS = ("n_lines", "n_deleted")


def windows(text: str, least_lines: int, least_words: int, extend: bool = False) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of each window: the first and last line, its smallest line hash, and its hash.

    With ``extend`` also of each closing window that is not a window.
    """
    places, sizes, hashes = [], [], []
    for i, line in enumerate(text.encode().split(b"\n")):
        words = line.split()
        if words:
            places.append(i)
            sizes.append(len(words))
            hashes.append(xxh3_64_intdigest(b" ".join(words)))
    first, last, least, whole = [], [], [], []
    sums = [0, *np.cumsum(sizes).tolist()]
    spans = []
    end = 0
    for start in range(len(places)):
        end = max(end, start)
        while end < len(places) and end - start < least_lines and sums[end] - sums[start] < least_words:
            end += 1
        if end - start < least_lines and sums[end] - sums[start] < least_words:
            break
        spans.append((start, end))
    if extend and spans:
        known = set(spans)
        start = 0
        for end in range(spans[0][1], len(places) + 1):
            while end - start - 1 >= least_lines or sums[end] - sums[start + 1] >= least_words:
                start += 1
            if (start, end) not in known:
                spans.append((start, end))
    packed = np.array(hashes, np.uint64).tobytes()
    for start, end in spans:
        first.append(places[start])
        last.append(places[end - 1])
        least.append(min(hashes[start:end]))
        whole.append(xxh3_64_intdigest(packed[8 * start : 8 * end]))
    return first, last, least, whole


def _key(text: str):
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))))


def find_windows(docs: DataFrame, text: str, least_lines: int, least_words: int, extend: bool = False) -> DataFrame:
    """``key, doc_id, first, last, least, whole``: one row per document, lists with a place per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            found = [windows(t or "", least_lines, least_words, extend) for t in batch.column("__text").to_pylist()]
            ends = np.cumsum([0] + [len(f[0]) for f in found]).astype(np.int32)
            flat = [[x for f in found for x in f[i]] for i in range(4)]
            lists = [pa.array(flat[0], pa.int32()), pa.array(flat[1], pa.int32())]
            lists += [pa.array(signed(np.array(x, np.uint64))) for x in flat[2:]]
            columns = [batch.column("key"), batch.column("doc_id"), *[pa.ListArray.from_arrays(ends, x) for x in lists]]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "first", "last", "least", "whole"])

    rows = docs.select(_key(text).alias("key"), F.col("doc_id").cast("string").alias("doc_id"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, "key string, doc_id string, first array<int>, last array<int>, least array<long>, whole array<long>")


def repeated_lines(docs: DataFrame, text: str = "text", least_lines: int = 3, least_words: int = 50, extend: bool = False) -> DataFrame:
    """``key, first, last``: the stretches of lines that repeat an earlier window."""
    found = settle(find_windows(docs, text, least_lines, least_words, extend).dropDuplicates(["key"]))
    # numbers order by value, other ids as strings
    order = F.struct(
        F.col("doc_id").isNull().alias("none"), F.try_to_number(F.col("doc_id"), F.lit("S9999999999999999999")).alias("number"),
        F.col("doc_id").alias("id"), F.col("key").alias("key"), F.col("w.first").alias("line"),
    )
    zipped = F.explode(F.arrays_zip("first", "last", "least", "whole")).alias("w")
    rows = found.select("doc_id", "key", zipped)
    # a fingerprint's positions: neighbouring windows select the same line, so windows are counted by what they hold
    prints = rows.groupBy(F.col("w.least").alias("least")).agg(F.count("*").alias("n")).where("n > 1").select("least")
    rows = rows.select("key", order.alias("place"), F.col("w.last").alias("last"), F.col("w.least").alias("least"), F.col("w.whole").alias("whole"))
    rows = rows.join(settle(prints), "least")
    earliest = rows.groupBy("whole").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = rows.join(settle(earliest), "whole").where(F.col("place") > F.col("earliest"))
    return later.select("key", F.col("place.line").alias("first"), "last")


def dedup(docs: DataFrame, text: str = "text", least_lines: int = 3, least_words: int = 50, extend: bool = False) -> DataFrame:
    """The rows with later repeated runs deleted from their texts, ``n_lines`` and ``n_deleted``."""
    spans = repeated_lines(docs, text, least_lines, least_words, extend).groupBy("key")
    # at most a stretch per line of a document
    spans = spans.agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("__spans")).withColumnRenamed("key", "__key")
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], _key(text).alias("__key")).join(spans, "__key", "left").drop("__key")
    schema = rows.drop("__spans").withColumn("n_lines", F.lit(0).cast("long")).withColumn("n_deleted", F.lit(0).cast("long")).schema

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out, lines, deleted = [], [], []
            for t, gone in zip(batch.column(text).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                parts = [] if t is None else t.split("\n")
                lines.append(len(parts))
                if gone:
                    drop = set()
                    at = 0
                    for s in gone:  # sorted by start: each line is visited once
                        drop.update(i for i in range(max(at, s["first"]), s["last"] + 1) if parts[i].encode().split())
                        at = max(at, s["last"] + 1)
                    t = "\n".join(x for i, x in enumerate(parts) if i not in drop)
                deleted.append(len(drop) if gone else 0)
                out.append(t)
            columns = [pa.array(out, pa.string()) if c == text else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(deleted, pa.int64())], names=[*kept, *RESULTS])

    return rows.mapInArrow(strip, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents", "doc_id", "text"), extend=True).select("doc_id", "text", *RESULTS)
