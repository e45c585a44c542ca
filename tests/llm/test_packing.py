"""Packed pieces against the tokenizer, sequence by sequence, and the proportions of sources."""

from __future__ import annotations

import sys
import tracemalloc
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spatialframes.llm import packing

ODD = [
    None, "", " ", "It's don't WON'T I'm we'll", "é é x y", "ΑΣ ΣΑ", "a\x0bb\x0cc\x1cd", "123 4.5!!??", "​ x", "日本語 テスト",
    "İI ß", "a<|b <|endoftext|> c<|startoftext|>d", "\U0001f600 ok", "x" * 5000, "ﬁ ǆ", "'S 'Ll", "Über, über. ÿ;", "éa", "word " * 9000,
]


def expected():
    tokenizer = Tokenizer.from_file(packing.word_file())
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in ODD]


def test_ids():
    known = packing.WordIds(packing.word_file())
    for _ in range(2):
        got = known.column(pa.array(ODD)).to_pylist()
        assert [np.frombuffer(g, np.uint16).tolist() for g in got] == expected()
    assert known.column(pa.array(ODD)[3:7]).to_pylist() == got[3:7]
    assert known.column(pa.array([], pa.string())).to_pylist() == []
    assert known.column(pa.array([None, "", " \n"])).to_pylist() == [b"\x01\x00"] * 3


def test_memory_of_a_batch():
    known = packing.WordIds(packing.word_file())
    texts = pa.array([f"some words of a text {i % 50} " * 400 for i in range(1200)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), texts], names=["doc_id", "text"])
    want = known.column(texts)
    tracemalloc.start()
    got = [b.column("__ids") for b in packing._with_ids(iter([batch]), "text", known)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pa.concat_arrays(got).equals(want)
    # 6.5 MB of these are the ids, which are kept here
    assert most < 70e6


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abTZ09.,!?-_/\\|<>'\"`~^@#é ß\n"), max_size=30))
def test_words_by_their_parts(text):
    tokenizer = Tokenizer.from_file(packing.word_file())
    got = packing.WordIds(packing.word_file()).texts([text])[0]
    assert np.frombuffer(got, np.uint16).tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


@cache
def words():
    return packing.WordIds(packing.word_file())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ09.!-|<>'@~éÉßÿŸÀ×÷ÞþÇ·µªº\xad\xa0\x85\x00\x1c\x7f ÄŁıſ日\u0301 \n"), max_size=12), max_size=4))
def test_words_of_other_letters(texts):
    texts = [*texts, "É" * 30 + "a" * 80, "X1" * 60, "<|endoftext|> <|ENDOFTEXT|>"]
    known = words()
    got = known.texts(texts)
    want = [known.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert [np.frombuffer(g, np.uint16).tolist() for g in got] == want


def test_words_are_looked_up_by_distinct_parts():
    stems = [a + b + c for a in "bdfg" for b in "aeiouéü" for c in "klmnrst"]
    forms = [f"{w}{sign}" for s in stems for w in (s, s.title(), s.upper()) for sign in ("", ".", "?!", "2")]
    tokenizer = Tokenizer.from_file(packing.word_file())
    known, calls = packing.WordIds(packing.word_file()), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    got = known.column(pa.array([" ".join(forms)]))
    sys.setprofile(None)
    assert np.frombuffer(got[0].as_py(), np.uint16).tolist() == tokenizer.encode(" ".join(forms), add_special_tokens=False).ids + [1]
    # 2352 words of 199 parts
    assert calls < len(forms)


def test_large_strings():
    assert words().column(pa.array(ODD, pa.large_string())).to_pylist() == words().column(pa.array(ODD)).to_pylist()


def test_parts_that_are_forgotten(monkeypatch):
    known = packing.WordIds(packing.word_file())
    monkeypatch.setattr(packing, "_HELD", 3)
    monkeypatch.setattr(packing, "_JOINED", 2)
    for i in range(8):
        texts = [f"one two, {'three' * i}! {i}", "日本 it's ÉTÉ" * (i % 2), ODD[i]]
        want = [known.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        assert [np.frombuffer(g, np.uint16).tolist() for g in known.texts(texts)] == want
    assert "three" not in known.known | known.older


def pieces(spark, rows, **rule):
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, sequence_id string")
    return packing.pack(frame, **rule).collect()


@pytest.mark.parametrize("tokens_per_shard", [6000, 1 << 21])
def test_pack(spark, tokens_per_shard):
    rows = [(i, ("a", "b", None, "")[i % 4 if i % 3 else 0], f"{ODD[i % len(ODD)] or ''} {i}") for i in range(300)]
    rows += [(1000 + i, "b", t) for i, t in enumerate(ODD)] + [(None, None, None), (0, rows[0][1], rows[0][2])]
    tokenizer = Tokenizer.from_file(packing.word_file())
    want = defaultdict(list)
    for d, _, t in rows:
        want[d].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    got = pieces(spark, rows, tokens_per_shard=tokens_per_shard)
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in got:
        sequences[p["sequence_id"]].append(p)
        docs[p["doc_id"]].append(p)
        ids = want[p["doc_id"]][0]
        assert p["doc_tokens"] == len(ids)
        assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    for d, own in docs.items():
        cover = sorted((p["start"], p["length"]) for p in own)
        whole = sorted(i for a, n in cover for i in range(a, a + n))
        assert whole == sorted(list(range(len(want[d][0]))) * len(want[d]))
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        total = 0
        for p in own:
            assert p["offset"] == total
            total += p["length"]
        assert total == 2048 or total & (total - 1) == 0
    assert set(docs) == set(want)
    # windows hold the sources as the whole does
    share = sum(p["length"] for p in got if p["source"] == "a") / sum(p["length"] for p in got)
    full = [own for own in sequences.values() if sum(p["length"] for p in own) == 2048]
    held = [sum(p["length"] for p in own if p["source"] == "a") / 2048 for own in full]
    assert np.mean(held) == pytest.approx(share, abs=0.12)


def test_round_robin_carries_deficits():
    from collections import deque

    queues = {"a": deque([[0, 0, 5000]]), "b": deque([[1, 0, 300], [2, 0, 700]]), "c": deque([[3, 0, 100]])}
    shares = {"a": 5000 / 6100, "b": 1000 / 6100, "c": 100 / 6100}
    windows = list(packing.fill(queues, shares, dict.fromkeys(shares, 0.0), 1000, 64))
    assert [sum(p[2] for p in w) for w in windows] == [1000] * 6 + [100]
    for w in windows[:6]:
        assert abs(sum(p[2] for p in w if p[0] == 0) - 820) < 130
    assert sorted(packing.sequences([(0, 0, 700), (1, 5, 600)], 2048), key=str) and [sum(p[2] for p in s) for s in packing.sequences([(0, 0, 700), (1, 5, 600)], 2048)] == [1024, 256, 16, 4]


def test_empty(spark):
    assert pieces(spark, []) == []


def test_target_proportions(spark):
    rows = [(i, "ab"[i % 2], f"some words of text number {i} " * 40) for i in range(400)]
    got = pieces(spark, rows, targets={"a": 7, "b": 3}, tokens_per_shard=1 << 15)
    plain = pieces(spark, rows, tokens_per_shard=1 << 15)
    assert sum(p["length"] for p in got) == sum(p["length"] for p in plain)
    windows = defaultdict(lambda: defaultdict(int))
    for p in got:
        windows[p["sequence_id"]][p["source"]] += p["length"]
    shards = defaultdict(list)
    for number in sorted(windows):
        shards[number >> 32].append(windows[number])
    assert len(shards) > 3
    for own in shards.values():
        # a shard's windows, up to the one in which a source runs dry
        last = max(i for i, w in enumerate(own) if w["a"])
        assert last >= 3
        for w in own[:last]:
            assert abs(w["a"] - 0.7 * packing.WINDOW) <= 64 and w["a"] + w["b"] == packing.WINDOW
        assert all(w["a"] == 0 for w in own[last + 1 :])
    assert pieces(spark, rows[:6], targets={"a": 1})
