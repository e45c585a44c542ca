"""The pipeline's stages, one by one, against what each must keep of its own input."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from spatialframes.llm import mixing, packing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def grams(text, n=5):
    words = (text or "").split()
    return {tuple(w.lower() for w in words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b):
    return bool(a) and bool(b) and 10 * len(a & b) >= 8 * len(a | b)


@pytest.fixture(scope="module")
def passed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        from spatialframes.session import settle

        frames.append(settle(stage(spark, frames[-1], SF)))
    return frames


def test_columns_and_quality(spark, passed):
    assert all(f.columns == passed[0].columns for f in passed[1:-1])
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in passed[1].collect()}
    assert kept < {r["doc_id"] for r in passed[0].collect()}
    assert all(d in kept for d, q in good.items() if q == 1)
    bad = [d for d, q in good.items() if q == 0]  # a dozen, of four kinds
    assert 2 * sum(d in kept for d in bad) < len(bad)


def test_line_dedup(passed):
    before = {r["doc_id"]: r for r in passed[1].collect()}
    after = {r["doc_id"]: r for r in passed[2].collect()}
    seen = set()
    for d in sorted(before):
        lines = [x for x in before[d]["text"].split("\n")]
        fresh = [x for x in lines if x.split() and tuple(x.split()) not in seen]
        # what no earlier document has must stay
        kept = after[d]["text"].split("\n") if d in after else []
        assert not Counter(fresh) - Counter(kept)
        seen |= {tuple(x.split()) for x in lines}
    assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if r["text"] != before[d]["text"])


def test_one_of_each_group(passed):
    rows = sorted(passed[2].collect(), key=lambda r: r["doc_id"])
    sets = [grams(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert sorted(r["doc_id"] for r in passed[3].collect()) == [r["doc_id"] for i, r in enumerate(rows) if root(i) == i]


def test_mix_and_pack(spark, passed):
    from pyspark.sql import functions as F

    from spatialframes.llm.common import word_count

    mixed = mixing.mix(passed[3], word_count(F.col("text"))).collect()
    copies = Counter(r["doc_id"] for r in passed[4].collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})
    texts = {r["doc_id"]: r["text"] for r in passed[3].collect()}
    ids = packing.WordIds(packing.word_file())
    whole = sum(n * len(ids.texts([texts[d]])[0]) // 2 for d, n in copies.items())
    assert sum(r["length"] for r in passed[5].collect()) == whole


def test_cases(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 5) for _ in range(40))
    same = text()
    rows = [(1, same, "en", "s", 3), (1, same, "en", "s", 3), (2, same, None, None, None), (None, None, None, None, None), (None, text(), "en", None, 1), (3, "", "en", "s", 0), (-4, text(), "de", "t", 9)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int")
    for data in (docs, docs.limit(0)):
        out = data
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
            if name != "packing":
                assert out.columns == docs.columns
        rows = out.collect()
        assert bool(rows) == (data is docs)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
