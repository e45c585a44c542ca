"""From raw documents to packed token sequences: five operators of ``spatialframes.llm`` in a row.

Every stage takes the whole table that the stage before has written and returns what it keeps; all but
the last return the columns of ``documents``. A row is known by its id and text, so ids that repeat or
are missing do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialframes.llm import mixing, ngram_join, packing, site_quality, winnow
from spatialframes.llm.common import read, word_count
from spatialframes.session import settle

_KEY = "__document"


def _key() -> Column:
    """The id, in an order that texts keep, and the digest of the text."""
    doc = F.coalesce(F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit("~"))
    return F.concat_ws(":", doc, F.md5(F.coalesce(F.col("text"), F.lit(""))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    keyed = docs.withColumn(_KEY, _key())
    judged = site_quality.classify(keyed, read(spark, sf_dir, "labels", "doc_id", "quality"))
    rejected = judged.where(~F.col("kept")).select(_KEY).distinct()
    return keyed.join(rejected, _KEY, "left_anti").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that an earlier document has; what is a repeat as a whole goes."""
    done = winnow.dedup(docs, extend=True)
    done = done.where((F.col("n_deleted") == 0) | (word_count(F.col("text")) > 0))
    chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    keyed = docs.withColumn(_KEY, _key())
    groups = ngram_join.link(keyed.select(F.col(_KEY).alias("doc_id"), "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(_KEY)).distinct()
    # rows that repeat are copies too
    return keyed.join(first, _KEY, "left_semi").dropDuplicates([_KEY]).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.emit(mixing.mix(docs, word_count(F.col("text"))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Tokens, checksums and signature trees have no SQL; ``tests/llm/test_pipeline.py`` compares the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
