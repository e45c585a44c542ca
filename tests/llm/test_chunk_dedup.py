"""Copies by chunk recipes against their definition."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spatialframes.llm import chunk_dedup


def plain(text):
    return re.sub(r"[ \t\n\x0b\x0c\r]+", " ", text or "")


def brute(rows):
    """doc_id, keep_id, group_size and digest of every row, and the kept ids of every text."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[plain(text)].append(key)
    least = lambda keys: min(keys, key=lambda k: (k is None, k or 0))
    return sorted(
        ((k, least(groups[plain(t)]), len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for k, t in rows), key=str
    )


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(words))


ROWS = [
    (5, "a  b\tc"), (3, "a b c"), (9, "a b c\n"), (9, "a b c "), (2, None), (7, ""), (1, " \t"), (4, " "),
    (None, "x"), (8, "x"), (None, "alone"), (None, "alone"), (6, "twice"), (6, "twice"), (6, "twice "),
    (10, "ä" * 5000), (11, "ä" * 5000), (12, "ä" * 5001), (13, "x" * 200_000), (14, "x" * 200_000), (15, "中" * 9000),
    (20, prose(1, 40_000)), (21, prose(1, 40_000).replace(" ", "\n\n")), (22, prose(1, 40_000) + "."), (23, "\U0001f600" * 3000),
]


@pytest.mark.parametrize("identify", [F.xxhash64, lambda c: F.crc32(c.cast("binary")) % 3])
@pytest.mark.parametrize("slices", [1, 4096])
def test_classes(spark, identify, slices):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in ROWS], "doc_id long, text string, row int, recipe string").repartition(5)
    made = chunk_dedup.recipes(docs, identify=identify)
    got = chunk_dedup.classes(made, slices).collect()
    assert sorted(((r["key"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(ROWS)
    kept = defaultdict(list)
    for r in got:
        if r["kept"]:
            kept[r["text_sha256"]].append(r["key"])
            assert r["key"] == r["keep_id"]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(len(k) == 1 for k in kept.values())


def test_collisions_are_told_apart(spark):
    docs = spark.createDataFrame([(k, t) for k, t in ROWS], "doc_id long, text string")
    unclear = chunk_dedup.ambiguous(docs, identify=lambda c: F.length(c)).collect()
    numbers = defaultdict(list)
    for r in unclear:
        assert len(r["chunk"]) == r["id"]
        numbers[r["id"]].append(r["number"])
    assert numbers and all(sorted(n) == list(range(len(n))) and len(n) > 1 for n in numbers.values())
    assert chunk_dedup.ambiguous(docs).isEmpty()


def test_chunks(spark):
    text = prose(7, 30_000)
    at = len(text) // 2
    texts = [text, text[:at] + "inserted words" + text[at:], "y" * 9000, "", "short", "\U0001f600" * 5000 + " é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(chunk_dedup.chunks(F.col("t")).alias("c")).collect()
    for t, r in zip(texts, rows, strict=True):
        assert "".join(r["c"]) == t
        assert all(chunk_dedup.LEAST <= len(c) <= chunk_dedup.MOST for c in r["c"][:-1])
    first, second = rows[0]["c"], rows[1]["c"]
    assert 500 < len(text) / len(first) < 2000
    # an insertion changes the chunks round it only
    assert len(set(first) - set(second)) <= 3


def test_one_group_holds_most_rows(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same")).otherwise(F.concat(F.lit("text "), F.col("id") % 500)).alias("text")
    )
    got = chunk_dedup.classes(chunk_dedup.recipes(docs), slices=16)
    assert got.where("group_size = 1000 and keep_id = 0").count() == 1000
    assert got.where("kept").count() == 1 + len({i % 500 for i in range(3000) if i % 3})


def test_dedup(spark):
    docs = spark.createDataFrame([(k, t, i, "z") for i, (k, t) in enumerate(ROWS)], "doc_id long, text string, key int, n string")
    out = chunk_dedup.dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted({plain(t) for _, t in ROWS}) == sorted(plain(r["text"]) for r in rows)
    assert {r["doc_id"] for r in rows if plain(r["text"]) == "a b c"} == {3}
    assert all(ROWS[r["key"]] == (r["doc_id"], r["text"]) for r in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert chunk_dedup.classes(chunk_dedup.recipes(docs)).count() == 0
    assert chunk_dedup.dedup(docs).count() == 0


def test_plan_stays_in_the_engine_and_moves_texts_once(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = chunk_dedup.classes(chunk_dedup.recipes(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "chunk" not in plan.split("Physical Plan")[1]
