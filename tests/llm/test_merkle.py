"""Trees, proofs and folded roots against a plain recursion."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spatialframes.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, path string, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree_of(nodes, fanout):
    """The root, and the siblings left and right of every node on each level."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_under = [], []
        for start in range(0, len(nodes), fanout):
            run = nodes[start : start + fanout]
            for i in range(len(run)):
                for member in under[start + i]:
                    paths[member].append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(h(*run))
            up_under.append([m for u in under[start : start + fanout] for m in u])
        nodes, under = up, up_under
    return nodes[0], paths


def brute(rows, fanout=3):
    """leaf, subroot, root and path of every row."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, below = [], {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroot, paths = tree_of([leaf_of(r) for r in own], fanout)
        subroots.append(subroot)
        below[name] = own, paths
    if not names:
        return []
    root, tops = tree_of(subroots, fanout)
    out = []
    for name, subroot, top in zip(names, subroots, tops, strict=True):
        own, paths = below[name]
        out += [(r[0], leaf_of(r), subroot, root, tuple(p + top)) for r, p in zip(own, paths, strict=True)]
    return sorted(out, key=str)


def made(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "p", "l") for r in rows], SCHEMA).repartition(7)
    digest = merkle.leaf([F.col(c) for c in FIELDS])
    return merkle.manifest(docs, digest, F.col("source"), [F.col("doc_id")], [F.col("doc_id"), F.col("text")], **more)


def got(frame):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((p["left"], p["right"]) for p in r["path"])) for r in frame.collect()), key=str)


ROWS = [(i, f"s{i % 4}", "en", i, f"text\n{i}") for i in range(40)]
ROWS += [(100 + i, "hot", None, None, None) for i in range(30)] + [(200 + i, f"one{i}", "de", 0, "") for i in range(11)]
ROWS += [(None, None, None, None, None), (None, None, None, None, None), (3, None, "x", 1, "y"), (None, "s1", "a", 2, "b" * 100_000)]
ROWS += [(7, "s3", "en", 7, "text\n7"), (7, "s3", "en", 7, "another"), (-5, "", "en", 7, "empty name"), (5, "=", "en", 7, "sign"), (1, "é", "", 1, "\n\n")]


@pytest.mark.parametrize(("fanout", "digits"), [(3, 6), (3, 1), (3, 2), (2, 3), (5, 1)])
def test_manifest(spark, fanout, digits):
    assert got(made(spark, ROWS, fanout=fanout, digits=digits)) == brute(ROWS, fanout)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_one_group(spark, n):
    rows = [(i, "a", "en", 1, str(i)) for i in range(n)]
    assert got(made(spark, rows, digits=2)) == brute(rows)


def test_fold_and_tampering(spark):
    changed = F.when(F.col("doc_id") == 7, merkle.leaf([F.col("text")]))
    out = made(spark, ROWS).select("doc_id", "root", merkle.fold(F.coalesce(changed, "leaf"), F.col("path")).alias("folded"))
    assert all((r["folded"] == r["root"]) == (r["doc_id"] != 7) for r in out.collect())


def test_query_digests(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "en", i, "a\nb" if i % 5 else None) for i in range(25)]
    spark.createDataFrame([r for r in rows], "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in merkle.op13(spark, str(tmp_path)).collect()}
    for doc_id, leaf, subroot, root, path in brute(rows):
        r, row = found[doc_id], rows[doc_id]
        assert (r["leaf"], r["subroot"], r["root"]) == (leaf, subroot, root)
        assert r["proof_sha256"] == h(*[a + b for a, b in path])
        hit = zlib.crc32(str(doc_id).encode()) % 2 == 0 and row[4] is not None
        low = leaf_of((*row[:4], row[4].replace("\n", ""))) if hit else leaf
        for a, b in path:
            low = h(a, low, b)
        assert (r["folded_root"], r["verified"]) == (low, not hit)


def test_empty_table(spark):
    out = made(spark, [])
    assert out.columns == ["doc_id", "text", "leaf", "subroot", "root", "path"]
    assert out.count() == 0


def test_no_join_between_blocks_and_proofs(spark):
    plan = made(spark, ROWS)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
