"""Spans of personal data against a plain search written with Python's own patterns."""

from __future__ import annotations

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from spatialframes.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(docs).collect()}
    return [[(s["kind"], s["start"], s["end"]) for s in rows[i]["spans"]] for i in range(len(texts))]


def LONG(n):
    return ["a@" + "b." * n + "c", "7" * n, "a" * n, "1 " * n, "1." * n, "+1" + "(" * n, "%" * n + "a@b.c"]


CASES = [
    None, "", "x@y", "a@b.c", "a@b.c%d@e.f", "a@b..c", "a@b.c.", "é a.b+c@x-y.zz.q ü", "@a.b", "a@b.c@d.e", "..a@b.c", "a@b.c-d@e.f.g",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "01.002.003.0004", "1.2.3", "999999999999999999999.1.1.1 1.1.1.1",
    "4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "x4111-1111-1111-1111-y", "41111111111111111111111", "4111 1111 1111 1112",
    "+1 (988) 555-2485", "+1 2", "+123456789012345678 +49 30 123456", "++49 30 1234567)", "call +1 555 123 4567.",
    "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89370400440532013001", "\x01a@b.c\x02 \x03 1.2.3.4\x04",
    *LONG(2_000),
]


def test_cases(spark):
    for text, spans in zip(CASES, found(spark, CASES), strict=True):
        assert [s for s in spans if s[0] in pii.BASE] == plain(text), (text or "")[:60]
    spans = dict(zip(CASES, found(spark, CASES), strict=True))
    assert spans["GB82 WEST 1234 5698 7654 32"][-1] == ("iban", 0, 27)
    assert spans["DE89370400440532013000"][-1] == ("iban", 0, 22)
    assert "iban" not in [s[0] for s in spans["DE89370400440532013001"]]


def test_very_long(spark):
    spans = found(spark, LONG(60_000))
    assert [len(s) for s in spans] == [1, 0, 0, 0, 15_000, 0, 1]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab@.-%+1245 ()é\n", max_size=60), min_size=200, max_size=200))
def test_random(spark, texts):
    for text, spans in zip(texts, found(spark, texts), strict=True):
        assert [s for s in spans if s[0] in pii.BASE] == plain(text), text


def test_scores_clashes_and_empty(spark):
    docs = spark.createDataFrame([(1, "my card 4111111111111111", "x"), (1, "see 4111111111111111", "y")], "doc_id long, text string, spans string")
    rows = pii.find(docs).collect()
    assert sorted(r["spans"][0]["score"] for r in rows) == [0.8, 1.0]
    assert pii.find(docs.limit(0)).count() == 0
    one = pii.redact(pii.find(docs)).orderBy("text").collect()
    assert [r["text"] for r in one] == ["my card [card]", "see [card]"]


KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
NEAR = [
    # words before and after count, those of the match itself and those farther off do not
    ("4111111111111111 is my card", "card", 1.0), ("my card 4111111111111111", "card", 1.0), ("4111111111111111", "card", 0.8),
    ("1.2.3.4 is the server", "ip", 0.8), ("1.2.3.4 " + "x " * 20 + "server", "ip", 0.5), ("observer 1.2.3.4", "ip", 0.5),
    ("a@mail.com", "email", 0.8), ("a@mail.com my contact", "email", 1.0), ("contact: a@b.c 1.2.3.4", "ip", 0.5), ("host a@b.c 1.2.3.4", "ip", 0.8),
    (f'token = "{KEY}"', "key", 0.8), (f"{KEY} is the API key", "key", 0.8), (f"digest {KEY}", "key", None), ("token " + "a" * 40, "key", None),
    ("SSN 123-45-6789", "ssn", 0.8), ("123-45-6789", "ssn", None), ("ssn 1123-45-6789", "ssn", None), ("123-45-6789 (social security)", "ssn", 0.8),
    ("DE89370400440532013000 is my account", "iban", 1.0), ("e " * 30 + "1.1.1.1,2.2.2.2,3.3.3.3;host", "ip", 0.8),
]


def test_context_on_both_sides_decides(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(NEAR)], "doc_id long, text string")
    rows = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    for i, (text, kind, score) in enumerate(NEAR):
        own = [s for s in rows[i] if s["kind"] == kind]
        assert (own[0]["score"] if own else None) == score, text
        assert all(s["kind"] in pii.BASE or s["score"] >= 0.8 for s in rows[i])


def test_the_tables_have_added_spans(spark):
    found = pii.op10(spark, "/root/testdata/sf0.01").collect()
    assert any("key:" in r["spans"] for r in found)
