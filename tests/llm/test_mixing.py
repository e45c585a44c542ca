"""The mix against its definition on small tables."""

from __future__ import annotations

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spatialframes.llm import mixing
from spatialframes.llm.common import word_count


def leveled(sizes, weights, most=3):
    """Targets by reshares, as the definition says."""
    whole, capped = Fraction(sum(sizes)), set()
    while True:
        rest = whole - sum(most * sizes[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        above = {i for i in open_ if share[i] > most * sizes[i]}
        if not above:
            return [float(share.get(i, most * sizes[i])) for i in range(len(sizes))]
        capped |= above


def test_targets(spark):
    sizes = [5, 1000, 10, 400, 0, 77]
    rows = [(s, n) for s, n in zip(["a", "b", "c", "d", "e", None], sizes, strict=True)]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()
    by = {r["source"]: r["target"] for r in got}
    want = leveled(sizes, [1, 2, 3, 1, 2, 3])
    assert [by[s] for s, _ in rows] == pytest.approx(want)


def mixed(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string")
    return mixing.mix(docs, word_count(F.col("text")), **more)


def test_near_target_and_repeatable(spark):
    rows = [(i, f"s{min(i % 7, 3)}", "w " * (1 + i * i % 997), "x") for i in range(3000)]
    rows += [(i, None, "w", "x") for i in range(50)] + [(None, "s1", None, None), (None, "s1", "", None), (7, "s0", "w w", "x")]
    first = mixed(spark, rows, rows_per_slice=40).collect()
    again = mixed(spark, rows[::-1], rows_per_slice=40).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, first), key=str) == sorted(map(key, again), key=str)
    assert len(first) == len(rows)
    for source in ("s0", "s1", "s2", "s3", None):
        own = [r for r in first if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.02, abs=3)
        assert all(r["taken"] <= 3 * r["size"] and r["copies"] in (0, 1, 2, 3) for r in own)
    out = mixing.emit(mixed(spark, rows), ["doc_id", "text"])
    assert out.count() == sum(r["copies"] for r in mixed(spark, rows).collect())


def test_empty_and_wordless(spark):
    assert mixed(spark, []).count() == 0
    rows = mixed(spark, [(1, "a", None, None), (2, "a", " \t", None)]).collect()
    assert [(r["target"], r["taken"], r["size"]) for r in rows] == [(0.0, 0, 0)] * 2


def test_words(spark):
    texts = ["", " ", "a", " a\tb\x0bc\x0c\r\n d ", "a b", None, "\x1ca"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows] == [0, 0, 1, 4, 1, 0, 1]
