"""Quality verdicts on labelled texts, shrinkage of sparse sites, and cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spatialframes.llm import site_quality


def corpus(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    text = lambda: [rng.choice(words) for _ in range(rng.randint(30, 200))]
    bad = [
        lambda w: " ".join(x + "%%%" for x in w), lambda w: " | ".join(w), lambda w: " ".join(x.upper() + "!!" for x in w),
        lambda w: " ".join(x for x in w[:8] for _ in range(20)),
    ]
    rows = []
    for i in range(n):
        good = rng.random() < 0.8
        rows.append((i, " ".join(text()) if good else rng.choice(bad)(text()), rng.choice(["x", "y", None]), rng.choice(["p", "q"]), int(good)))
    return rows


def test_verdicts_and_sites(spark):
    rng = random.Random(4)
    rows = corpus(rng, 900)
    rows += [(5000 + i, " ".join("zq" + str(i * k) for k in range(40)), "new", "p", 1) for i in range(2)]
    rows += [(None, None, None, None, 1), rows[3]]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, source string, lang string, good int, score double")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:500]] + [(None, 0), (10**6, 1), (rows[0][0], None)], "doc_id long, quality int")
    out = site_quality.classify(frame, labels).collect()
    assert len(out) == len(rows)
    seen = [r for r in out if r["doc_id"] is not None]
    wrong = [r["doc_id"] for r in seen if r["kept"] != (r["good"] == 1)]
    assert len(wrong) <= 0.02 * len(seen)
    assert all(0 < r["score"] < 1 and 0 < r["host_rate"] < 1 and 0 < r["path_rate"] < 1 for r in out)
    # a host of two documents stays near the whole, and closer to it than its own documents are
    rates = {r["source"]: r["host_rate"] for r in out}
    whole = sum(r["host_rate"] for r in seen) / len(seen)
    assert abs(rates["new"] - whole) < 0.1
    again = site_quality.classify(frame.repartition(7), labels).collect()
    key = lambda r: (str(r["doc_id"]), r["kept"])
    assert sorted(map(key, again)) == sorted(map(key, out))


def test_strength():
    assert site_quality.strength(None, 0.5) == 1e6 and site_quality.strength(-1.0, 0.5) == 1e6
    assert site_quality.strength(0.05, 0.5) == pytest.approx(4.0) and site_quality.strength(9.0, 0.5) == 1.0


def test_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "a b", "x", "p"), (2, None, None, None)], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["kept"] for r in site_quality.classify(frame, none).collect()] == [True, True]
    assert site_quality.classify(frame.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert site_quality.classify(frame, one).where(~F.col("kept")).count() == 0
