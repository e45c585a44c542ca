"""Layouts, the exact round trip of the template, and digests of conversations."""

from __future__ import annotations

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from spatialframes.llm import chat

PIECES = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "\\", "<|im_end|>", "<", "/", "s>", "[", "INST]", "é", "\n", " ", "a"]
TEXT = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    formatted = "".join(chat.format_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(formatted)] == turns
    for role, text in turns:
        assert not any(c in chat.escape(text) or c in chat.escape(role) for c in chat.CONTROL)


LAYOUTS = [
    ({"conv_id": 1, "turn": 0, "role": "user", "text": "a"}, "row", [(0, "user", "a")]),
    ({"conv_id": 1, "turn": 0, "role": None, "text": None}, "row", [(0, "", "")]),
    ({"conv_id": 1, "prompt": "p", "response": "r"}, "prompt", [(0, "user", "p"), (1, "assistant", "r")]),
    ({"conv_id": 1, "prompt": "p"}, "prompt", [(0, "user", "p")]),
    ({"conv_id": 1, "prompt": "p", "completion": "c"}, "completion", [(0, "user", "p"), (1, "assistant", "c")]),
    ({"conv_id": 1, "instruction": "i", "input": "x", "output": "o"}, "instruction", [(0, "system", "i"), (1, "user", "x"), (2, "assistant", "o")]),
    ({"conv_id": 1, "instruction": "i", "input": None, "output": "o"}, "instruction", [(0, "system", "i"), (1, "assistant", "o")]),
    ({"conv_id": 1, "question": "q", "answer": "a", "system": "s"}, "question", [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "a")]),
    ({"conv_id": 1, "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}]}, "messages", [(0, "user", "u"), (1, "assistant", "")]),
    ({"conv_id": 1, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [(0, "user", "h"), (1, "assistant", "g")]),
    ({"conv_id": 1, "weird": {"deep": [1]}}, None, []),
    ({"conv_id": 1, "messages": []}, None, []),
]


def test_layouts():
    for record, layout, turns in LAYOUTS:
        assert chat.turns_of(record) == (layout, turns), record
    assert chat.fingerprint(chat.paths({"a": [{"b": 1}, {"c": 2}]})) == chat.fingerprint(["a[].c", "a[].b"])


def test_digests(spark):
    rows = [(1, 0, "user", "q</s>"), (1, 1, "assistant", "a\\"), (1, 1, "assistant", "b"), (2, None, None, None), (2, 3, "assistant", ""), (None, 1, "user", "lost"), (1, 1, "assistant", "b")]
    rows += [(7, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    got = {r["conv_id"]: r for r in chat.read_back(chat.to_turns(frame.select(F.to_json(F.struct("*"))))).collect()}
    assert set(got) == {1, 2, 7, None}
    for key in got:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == key))
        said = "".join(x for _, r, x in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        row = got[key]
        assert (row["n_turns"], row["turns_sha256"]) == (len(own), digest)
        assert (row["loss_chars"], row["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert row["formatted_chars"] == sum(len(chat.format_turn(r, x)) for _, r, x in own)
    assert chat.read_back(chat.to_turns(frame.limit(0).select(F.to_json(F.struct("*"))))).count() == 0
    unknown = spark.createDataFrame([(json.dumps({"conv_id": 9, "odd": 1}),)], "record string")
    assert chat.to_turns(unknown).collect()[0]["layout"] is None


def test_records_of_no_use_are_rows(spark):
    deep = "[" * 100_000
    bad = [None, "", "no json", "[1, 2]", "3", "null", deep, '{"conv_id": "x", "prompt": "p"}', '{"conv_id": 1.5, "prompt": "p"}', '{"conv_id": true, "prompt": "p"}']
    bad += [json.dumps({"conv_id": 1 << 70, "prompt": "p"}), '{"conv_id": 4, "turn": "one", "role": "user", "text": "t"}', '{"conv_id": 5, "messages": "text"}']
    bad += ['{"conv_id": 6, "weird": 1}', '{"conv_id": 7, "prompt": {"a": 1}}', '{}']
    long = "word </s> " * 200_000
    good = [json.dumps({"conv_id": 8, "prompt": long}), json.dumps({"prompt": "no id"}), '{"conv_id": 9, "prompt": "\\ud800 half"}', json.dumps({"conv_id": 10, "prompt": ["a", {"b": 1}]})]
    rows = chat.to_turns(spark.createDataFrame([(r,) for r in bad + good], "record string").coalesce(1)).collect()
    known = [r for r in rows if r["layout"] is not None]
    assert {r["rejected"] for r in rows if r["layout"] is None} >= set(bad[:13])
    assert {r["conv_id"] for r in rows if r["layout"] is None} >= {None, 4, 5, 6}
    assert chat.parse(next(r for r in known if r["conv_id"] == 8)["formatted"])[0][1] == long
    assert next(r for r in known if r["conv_id"] == 9)["text"] == "? half"
    assert chat.read_back(spark.createDataFrame(rows, chat.SCHEMA)).where("conv_id = 8").first()["n_turns"] == 1
