"""Small shared pieces: reading a table, words, and the key that tells rows apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

_ODD = np.uint64(0x9E3779B97F4A7C15)

#: What separates words: space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table (all without names)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, GAP))).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose column holds about ``most_bytes`` at most, one row at least."""
    for batch in batches:
        start, held = 0, 0
        values = batch.column(batch.schema.get_field_index(column))
        lengths = pa.compute.binary_length(values).to_pylist()
        for i, n in enumerate(lengths):
            held += n or 0
            if held >= most_bytes:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def combined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` of the 64-bit hashes; a single one of all if there are fewer."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out ^= hashes[i : len(hashes) - n + 1 + i]
        out *= _ODD
        out ^= out >> np.uint64(29)
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order."""
    return np.array(list(map(xxh3_64_intdigest, data.split())), np.uint64)


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
