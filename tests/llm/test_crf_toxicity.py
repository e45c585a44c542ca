"""Forward-backward against all paths, held-out accuracy, offsets, and cases."""

from __future__ import annotations

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatialframes.llm import crf_toxicity as crf


def test_marginals():
    rng = np.random.default_rng(2)
    lengths = np.array([0, 1, 5, 3, 0, 8, 5])
    potential, move = rng.normal(size=lengths.sum()), np.exp(rng.normal(size=(2, 2)))
    got = crf.marginals(potential, lengths, move)
    at = 0
    for n in lengths:
        own, total, each = potential[at : at + n], 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(own[i] for i in range(n) if path[i])) * np.prod([move[a, b] for a, b in zip(path, path[1:], strict=False)])
            total += weight
            each += weight * np.array(path, float)
        assert got[at : at + n] == pytest.approx(each / total)
        at += n


def texts(rng, n, toxic):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    out = []
    for _ in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(30, 80))]
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["zzbad", "qqstem" + rng.choice("abc"), "Yywort"]))
        out.append(" ".join(own))
    return out


def test_fit_score_offsets(spark):
    rng = random.Random(1)
    model = crf.fit(texts(rng, 150, True), texts(rng, 150, False))
    rows = [(i, t, 1) for i, t in enumerate(texts(rng, 60, True))] + [(100 + i, t, 0) for i, t in enumerate(texts(rng, 60, False))]
    rows += [(None, None, 0), (500, "", 0), (501, "İ İ zzbad!", 1), (502, "clean " * 30_000, 0)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, goal int, spans string")
    got = crf.score(docs, model).collect()
    by = {r["doc_id"]: r for r in got}
    assert [(r["doc_id"], r["score"]) for r in got if (r["score"] >= 0.3) != (r["goal"] == 1)] == []
    assert all(0 <= r["score"] <= 1 for r in got) and by[None]["score"] == by[500]["score"]
    text = dict((r[0], r[1]) for r in rows)
    flagged = [text[r["doc_id"]][s["start"] : s["end"]].lower()[:6] for r in got for s in r["spans"]]
    assert sum(f in ("zzbad", "qqstem", "yywort") for f in flagged) >= 0.75 * len(flagged) > 100
    assert text[501][by[501]["spans"][0]["start"] : by[501]["spans"][0]["end"]] == "zzbad"
    assert crf.score(docs.limit(0), model).count() == 0


def test_fit_on_short_texts():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(120)]

    def short(n, toxic):
        out = []
        for _ in range(n):
            own = [rng.choice(words) for _ in range(rng.randint(2, 19))]
            own.insert(rng.randrange(len(own) + 1), rng.choice(["zzbad", "yywort"] if toxic else words))
            out.append(" ".join(own))
        return out

    # all toxic labels stand on short texts; clean ones are short and long
    model = crf.fit(short(200, True), short(100, False) + texts(rng, 100, False))
    for docs, toxic in ((short(80, True), True), (short(80, False) + texts(rng, 40, False), False)):
        split = [d.split() for d in docs]
        found, lengths = model.tokens(split, {})
        assert ((model.scores(found, lengths) >= 0.5) == toxic).all()
        assert [w for w, p in zip((w for d in split for w in d), found, strict=True) if p >= 0.5] == [w for d in split for w in d if w in ("zzbad", "yywort")]


def test_padding_has_no_part():
    rng = np.random.default_rng(3)
    rows, goal = rng.integers(0, 9, (40, 6, 8)), rng.integers(0, 2, (40, 6))
    wide, more = rng.integers(0, 9, (40, 9, 8)), np.zeros((40, 9), np.int64)
    wide[:, :6], more[:, :6] = rows, goal
    one = crf._fit_chain(rows, rows > 0, goal, 9, 20, 1e-4, np.full(40, 6))
    two = crf._fit_chain(wide, wide > 0, more, 9, 20, 1e-4, np.full(40, 6))
    for a, b in zip(one, two, strict=True):
        assert a == pytest.approx(b)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    assert crf.learn(docs, labels) is None
    assert [r["score"] for r in crf.score(docs, None).collect()] == [0.0, 0.0]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="driver tables not present")
def test_held_out(spark):
    scored = crf.op7(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["n"] for r in scored.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert n[(1, 1)] >= 0.8 * (n[(1, 1)] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[(0, 0)]
