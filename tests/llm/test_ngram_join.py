"""Components against a comparison of all pairs of word n-gram sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from spatialframes.llm import ngram_join
from spatialframes.llm import signature_tree as tree


def grams(text, n):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(docs, n, percent):
    sets = [grams(t, n) for _, t in docs]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)]


def run(spark, docs, **rule):
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, node string, size int")
    return [tuple(r) for r in ngram_join.link(frame, **rule).collect()]


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "Ü", "THE"]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, docs = text(40), []
    for _ in range(25):
        base = text(rng.choice([3, 5, 12, 60, 150, 300]))
        docs.append(base)
        for _ in range(rng.randint(0, 14)):
            copy = list(base if rng.random() < 0.7 else docs[-1])
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 2)] = text(rng.randint(0, 2))
            docs.append(copy)
    docs += [passage + text(rng.randint(5, 60)) for _ in range(60)]
    out = [(i, rng.choice([" ", "\n"]).join(d)) for i, d in enumerate(docs)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n,percent,chunk", [(4, 85, 1 << 20), (5, 80, 1500), (2, 60, 1 << 20)])
def test_components(spark, n, percent, chunk):
    docs = corpus(random.Random(n))
    docs += [(900, None), (901, ""), (902, " \t"), (None, docs[0][1]), (docs[1][0], docs[2][1]), (903, "one two"), (904, "ONE\ttwo"), (None, "alone here now"), docs[3], docs[3]]
    docs += [(905, "long " * 5000), (906, " ".join(f"x{i}" for i in range(20_000)))]
    docs += [(907, " ".join(f"x{i}" for i in range(19_000)))]
    got = run(spark, docs, n=n, percent=percent, chunk_tokens=chunk)
    assert sorted(got, key=str) == sorted(brute(docs, n, percent), key=str)


@pytest.mark.parametrize("n,percent,chunk", [(4, 85, 1 << 20), (2, 60, 1500)])
def test_number_of_links(spark, n, percent, chunk):
    docs = corpus(random.Random(n + 10))
    docs += [(900, None), (901, ""), (None, docs[0][1]), (903, "one two"), (904, "ONE\ttwo"), docs[3], docs[3]]
    sets = [grams(t, n) for _, t in docs]
    n_links = [sum(i != j and bool(a) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    want = [(*r, k) for r, k in zip(brute(docs, n, percent), n_links, strict=True)]
    # in components of three texts and more, not every two are linked
    assert max(n_links) > 10
    assert sorted(run(spark, docs, n=n, percent=percent, chunk_tokens=chunk, count_links=True), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]


def test_tree_and_bitmaps():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = []
    for _ in range(300):
        keep = base[rng.random(len(base)) > rng.choice([0.02, 0.05, 0.1, 0.3])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 25)).astype(np.uint64)])))
    links = tree.Links(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            if tree.alike(sets[i], sets[j], 85):
                links.join(i, j)
    for hub in (None, 7):
        mine = tree.Links(len(sets))
        for i, j in tree.join(sets, 85, hub, 2):
            assert tree.alike(sets[i], sets[j], 85)
            mine.join(i, j)
        assert [mine.root(i) for i in range(len(sets))] == [links.root(i) for i in range(len(sets))]
    weights, label = rng.integers(1, 5, len(sets)), rng.integers(0, 2, len(sets))
    is_link = np.array([[i != j and tree.alike(a, b, 85) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    for hub in (0, 7):  # the hub first, as one of the sets; then beside two chunks
        order = [hub, *(i for i in range(len(sets)) if i != hub)]
        found, n = tree.tally(sets[hub], [sets[i] for i in order], weights[order], 85)
        assert (n == is_link[np.ix_(order, order)] @ weights[order]).all()
        mine = tree.Links(len(sets))
        for i, j in found:
            assert is_link[order[i], order[j]]
            assert mine.join(order[i], order[j])  # no link too many
        assert [mine.root(i) for i in range(len(sets))] == [links.root(i) for i in range(len(sets))]
        rest = np.array(order[1:])
        across = is_link[np.ix_(rest, rest)] & (label[rest][:, None] != label[rest][None, :])
        assert (tree.tally(sets[hub], [sets[i] for i in rest], weights[rest], 85, label[rest])[1] == across @ weights[rest]).all()
    wide, narrow = tree.bitmap(base, 16), tree.bitmap(base, 4)
    assert (tree.fold(wide, 4) == narrow).all()


def test_rest_meets_in_few_blocks_and_deals_bitmaps_once(spark):
    rng = random.Random(3)
    rows = [(t, n, n, n) for n in range(40) for t in rng.sample(range(12), 7)]
    frame = spark.createDataFrame(rows, "token long, node long, comp long, grp long")
    kept = ngram_join._first(ngram_join._open(frame), ngram_join.F.lit(4)).select("node", "token").collect()
    own = {n: {r[1] for r in kept if r[0] == n} for n in range(40)}
    every = {n: {r[0] for r in rows if r[1] == n} for n in range(40)}
    assert all(len(own[n]) == 4 for n in own)
    assert all(own[a] & own[b] for a in own for b in own if len(every[a] & every[b]) >= 4)
    maps = spark.createDataFrame([(n, b"12345678") for n in range(40)], "node long, bits binary")
    plan = ngram_join.rest_pairs(frame.selectExpr("*", "10L as size"), maps.hint("merge"), 85, 64)._jdf.queryExecution().optimizedPlan().toString()
    # above the bitmaps, only the rows' place is dealt by
    assert plan.index("RepartitionByExpression") < plan.index("Join")
