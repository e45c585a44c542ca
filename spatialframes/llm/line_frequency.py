"""Quality rules: counts of a text by itself, and how often its lines stand in other documents.

Lines are normalised (ASCII lower case, digits as 0, white space collapsed), hashed, and counted by
the distinct texts of their host that hold them: copies of one text count once, so that copies do not
make their own lines common. A line in at least ``least_docs`` texts and ``least_share`` of the texts
of its host is boilerplate and is removed. A document that loses more than ``1 - least_left`` of its
words this way is depleted and rejected.

What is shuffled is one row per distinct line of a distinct text, summed up before the shuffle; the
common lines meet the lines of documents in a join that adaptive execution splits where a line is hot.

Defined results: a null or empty text has counts of 0 and fails the base rules; a null host is a host
of its own; rows that repeat are judged each, and are one text in the counts; an empty table gives no
rows; other columns of the input pass through unless they have the name of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from spatialframes.llm.common import combined, read, signed, slices, word_hashes
from spatialframes.session import settle

RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", "base_failed", "kept")
COUNTS = RESULTS[:5]
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"abcdefghijklmnopqrstuvwxyz0000000000")


def repeated_words(hashes: np.ndarray, n: int = 5) -> int:
    """Words that lie in a window of ``n`` words which the text has twice or more."""
    if len(hashes) <= n:
        return 0
    windows = combined(hashes, n)
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[starts] += 1
    edges[starts + n] -= 1
    return int((np.cumsum(edges) > 0).sum())


def text_counts(text: str) -> tuple[list[int], dict[int, int]]:
    """The five counts of a text, its words that equal the word before, and the words in each distinct
    normalised line."""
    data = text.encode()
    hashes = word_hashes(data)
    chars = len(text) - (len(data) - len(data.translate(None, _SPACES)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen, repeats, lines = set(), 0, {}
    for line in data.split(b"\n"):
        words = line.translate(_FOLD).split()
        if not words:
            continue
        repeats += line in seen
        seen.add(line)
        key = xxh3_64_intdigest(b" ".join(words))
        lines[key] = lines.get(key, 0) + len(words)
    stutter = int((hashes[1:] == hashes[:-1]).sum())
    return [len(hashes), chars, symbols, repeats, repeated_words(hashes), stutter], lines


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices((b for b in batches), "__text"):
        rows = [text_counts(t or "") for t in batch.column("__text").to_pylist()]
        arrays = [batch.column(c) for c in batch.schema.names if c != "__text"]
        names = [c for c in batch.schema.names if c != "__text"]
        for i, name in enumerate((*COUNTS, "__stutter")):
            arrays.append(pa.array([r[0][i] for r in rows], pa.int64()))
            names.append(name)
        ends = np.cumsum([0] + [len(r[1]) for r in rows]).astype(np.int32)
        keys = np.array([k for r in rows for k in r[1]], np.uint64)
        words = np.array([w for r in rows for w in r[1].values()], np.int64)
        arrays += [pa.ListArray.from_arrays(ends, signed(keys)), pa.ListArray.from_arrays(ends, words)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, "__lines", "__line_words"])


def count(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows without their text, with the counts and the columns ``__stutter``, ``__host``, ``__digest``,
    ``__lines`` and ``__line_words``."""
    kept = [c for c in docs.columns if c.lower() not in RESULTS and c != text]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("__host"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("__digest"),
        F.col(text).alias("__text"),
    )
    fields = [f for f in rows.schema.fields if f.name != "__text"]
    fields += [T.StructField(c, T.LongType()) for c in (*COUNTS, "__stutter")]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("__lines", "__line_words")]
    return rows.mapInArrow(_counted, T.StructType(fields))


def common_lines(counted: DataFrame, least_docs: int, least_share: float) -> DataFrame:
    """``__host, __line`` of the lines above the limits."""
    texts = counted.groupBy("__host", "__digest").agg(F.any_value("__lines").alias("__lines"))
    sizes = texts.groupBy("__host").agg(F.count("*").alias("__texts"))
    lines = texts.select("__host", F.explode("__lines").alias("__line"))
    # the lower limit alone first: what it leaves is small
    lines = lines.groupBy("__host", "__line").agg(F.count("*").alias("__n")).where(F.col("__n") >= least_docs)
    return lines.join(sizes, "__host").where(F.col("__n") >= F.col("__texts") * least_share).select("__host", "__line")


def judge(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    least_docs: int = 20,
    least_share: float = 0.01,
    least_left: float = 0.3,
    base: Column | None = None,
) -> DataFrame:
    """The rows with the counts, ``n_common_words``, ``base_failed`` and ``kept``, without the text.

    ``base`` is the condition under which a document fails by itself.
    """
    if base is None:
        base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = settle(count(docs, text, host).withColumn("__row", F.monotonically_increasing_id()))
    frequent = settle(common_lines(counted, least_docs, least_share))
    pairs = F.explode(F.arrays_zip(F.col("__lines").alias("l"), F.col("__line_words").alias("w"))).alias("__p")
    lines = counted.select("__row", "__host", pairs).select("__row", "__host", F.col("__p.l").alias("__line"), F.col("__p.w").alias("__w"))
    lost = lines.join(frequent, ["__host", "__line"]).groupBy("__row").agg(F.sum("__w").alias("n_common_words"))
    rows = counted.drop("__stutter", "__lines", "__line_words", "__host", "__digest").join(lost, "__row", "left").drop("__row")
    rows = rows.withColumn("n_common_words", F.coalesce("n_common_words", F.lit(0)).cast("long")).withColumn("base_failed", base)
    left = F.col("n_words") - F.col("n_common_words")
    return rows.withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * least_left))


def remove_common(docs: DataFrame, frequent: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The texts without the lines of ``frequent`` (``__host, __line``).

    Lines are looked up one by one in a join, not in a table that each task holds. A row is known by
    its id and text; rows that repeat get the same result.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    keyed = docs.withColumn("__key", key)
    lines = count(keyed.select("__key", host, text), text, host).select("__key", "__host", F.explode(F.array_distinct("__lines")).alias("__line"))
    drop = lines.join(frequent, ["__host", "__line"]).groupBy("__key").agg(F.collect_set("__line").alias("__drop"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            out = []
            for t, gone in zip(batch.column(text).to_pylist(), batch.column("__drop").to_pylist(), strict=True):
                if gone and t is not None:
                    gone = {g % 2**64 for g in gone}
                    own = lambda x: xxh3_64_intdigest(b" ".join(x.encode().translate(_FOLD).split()))
                    t = "\n".join(x for x in t.split("\n") if own(x) not in gone)
                out.append(t)
            names = [c for c in batch.schema.names if c not in ("__drop", "__key")]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    return keyed.join(drop, "__key", "left").mapInArrow(strip, docs.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return judged.select("doc_id", *RESULTS)


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), p AS (
  SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM w
), g AS (
  SELECT r, i, CASE WHEN i + 4 <= n THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS gram
  FROM p WINDOW o AS (PARTITION BY r ORDER BY i)
), c AS (
  SELECT r, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g
), rep AS (
  SELECT r, count(*) FILTER (hit) AS n_repeat_words
  FROM (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM c) GROUP BY r
), ls AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d
), ln AS (
  SELECT r, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    regexp_replace(trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789' || chr(9) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz0000000000    ')), ' +', ' ', 'g') AS key
  FROM ls
), words AS (
  SELECT * FROM ln WHERE n > 0
), dup AS (
  SELECT r, count(*) FILTER (k > 1) AS n_dup_lines FROM (SELECT r, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM words) GROUP BY r
), texts AS (
  SELECT source, text, min(r) AS r FROM d GROUP BY source, text
), hosts AS (
  SELECT source, count(*) AS texts FROM texts GROUP BY source
), common AS (
  SELECT t.source, key FROM texts t JOIN (SELECT DISTINCT r, key FROM words) k ON t.r = k.r JOIN hosts h ON t.source IS NOT DISTINCT FROM h.source
  GROUP BY t.source, key, texts HAVING count(*) >= 20 AND count(*) >= texts * 0.01
), lost AS (
  SELECT k.r, sum(k.n)::BIGINT AS lost FROM words k JOIN d ON d.r = k.r JOIN common m ON m.source IS NOT DISTINCT FROM d.source AND m.key = k.key GROUP BY k.r
), b AS (
  SELECT d.r, doc_id, len(ws)::BIGINT AS n_words,
    (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g')))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_common_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_words, base_failed,
  NOT base_failed AND n_words - n_common_words >= n_words * 0.3 AS kept
FROM f
"""
