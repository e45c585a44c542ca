"""Deleted lines against a search over all pairs of windows."""

from __future__ import annotations

import random

from spatialframes.llm import winnow


def brute(docs, least_lines, least_words):
    """A line goes if it lies in a window that equals one at an earlier place."""
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, winnow_key(d)))
    seen, out = set(), {}
    for doc in order:
        lines = (doc[1] or "").split("\n") if doc[1] is not None else []
        full = [i for i, x in enumerate(lines) if x.split()]
        gone = set()
        for s in range(len(full)):
            for e in range(s + 1, len(full) + 1):
                words = sum(len(lines[i].split()) for i in full[s:e])
                if e - s >= least_lines or words >= least_words:
                    run = tuple(" ".join(lines[i].split()) for i in full[s:e])
                    if run in seen:
                        gone |= set(full[s:e])
                    seen.add(run)
                    break
        out[doc] = None if doc[1] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def winnow_key(doc):
    import hashlib

    return f"{'null' if doc[0] is None else doc[0]}:{hashlib.md5((doc[1] or '').encode()).hexdigest()}"


def run(spark, docs, **rule):
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_lines string")
    return [(r["doc_id"], r["text"], r["n_lines"], r["n_deleted"]) for r in winnow.dedup(frame, **rule).collect()]


def test_against_all_windows(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(2, 7))] for _ in range(8)]
    docs = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 4)):
            lines += rng.choice(runs) if rng.random() < 0.6 else [rng.choice(pool), "", f"own {i} {rng.random()}"]
        docs.append((i, "\n".join(lines)))
    docs += [(3, docs[3][1]), (3, "other"), (None, docs[4][1]), (None, None), (900, None), (901, ""), (902, "\n \n"), (10, "x\nx\nx\nx\nx\nx"), (11, "x\nx\nx")]
    for rule in ({"least_lines": 3, "least_words": 50}, {"least_lines": 4, "least_words": 12}):
        want = brute(docs, **rule)
        got = run(spark, docs, **rule)
        assert sorted(((d, t) for d, t, _, _ in got), key=str) == sorted(((d[0], want[d]) for d in docs), key=str)


def maximal(docs, least_lines, least_words):
    """A line goes if it lies in a run of the least size that an earlier place has too."""
    order = sorted(docs)
    lines = [(d, i, x) for d, t in order for i, x in enumerate(t.split("\n"))]
    gone = set()
    for b in range(len(lines)):
        for a in range(b):
            n = words = 0
            while b + n < len(lines) and lines[a + n][2] == lines[b + n][2] and lines[a + n][0] == lines[a][0] and lines[b + n][0] == lines[b][0]:
                words += len(lines[b + n][2].split())
                n += 1
            if n >= least_lines or words >= least_words:
                gone.update(range(b, b + n))
    out = {d: [] for d, _ in order}
    for k, (d, _, x) in enumerate(lines):
        if k not in gone:
            out[d].append(x)
    return {d: "\n".join(x) for d, x in out.items()}


def test_extends_to_maximal_runs(spark):
    def line(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    # a closing long line, with tails too short for a window, also where only the second copy goes on
    docs = [(0, [line("a", 60), line("b", 49), "x0"]), (1, [line("a", 60), line("b", 49), "x1"]), (2, [line("c", 60), line("d", 20), line("e", 20), "x2"])]
    docs += [(3, ["y3", line("c", 60), line("d", 20), line("e", 20), "x3"]), (4, [line("a", 60), line("f", 5), "x4"]), (5, [line("a", 60), line("f", 5), "x5"])]
    docs = [(d, "\n".join(x)) for d, x in docs]
    got = {d: (t, n) for d, t, _, n in run(spark, docs, extend=True)}
    assert got == {0: (docs[0][1], 0), 1: ("x1", 2), 2: (docs[2][1], 0), 3: ("y3\nx3", 3), 4: (line("f", 5) + "\nx4", 1), 5: ("x5", 2)}
    rng = random.Random(8)
    pool = [line(k, rng.choice((1, 3, 8, 20))) for k in "abcdefghijkl"]
    docs = [(i, "\n".join([rng.choice(pool) if rng.random() < 0.8 else f"own {i} {k}" for k in range(rng.randint(1, 9))])) for i in range(60)]
    for rule in ({"least_lines": 3, "least_words": 20}, {"least_lines": 4, "least_words": 22}):
        assert {d: t for d, t, _, _ in run(spark, docs, extend=True, **rule)} == maximal(docs, **rule)


def test_long_line_and_shared_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"begin {i}\n{passage}\nend {i}") for i in range(500)]
    got = sorted(run(spark, docs))
    assert got[0] == (0, docs[0][1], 3, 0)
    assert all(t == f"begin {i}\nend {i}" and gone == 1 for i, t, _, gone in got[1:])
    long = "\n".join(f"line {i}" for i in range(20_000))
    got = sorted(run(spark, [(1, long), (2, "own\n" + long)]))
    assert [(t, gone) for _, t, _, gone in got] == [(long, 0), ("own", 20_000)]


def test_empty(spark):
    assert run(spark, []) == []
