"""Quality rules against plain counts, and their cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from spatialframes.llm import line_frequency

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(hit))


def normal(line):
    return " ".join(WORD.findall(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))


def judged(docs, least_docs, least_share, least_left):
    texts = defaultdict(set)
    for _, t, s in docs:
        texts[s].add(t or "")
    held = defaultdict(Counter)
    for s, own in texts.items():
        for t in own:
            held[s].update({normal(x) for x in t.split("\n") if WORD.search(x)})
    out = []
    for d, t, s in docs:
        base = plain(t)
        lost = sum(
            len(WORD.findall(x)) for x in (t or "").split("\n")
            if WORD.search(x) and held[s][normal(x)] >= max(least_docs, least_share * len(texts[s]))
        )
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        out.append((d, *base, lost, failed, not failed and base[0] - lost >= base[0] * least_left))
    return out


def docs():
    rng = random.Random(3)
    words = ["a", "Bé", "c|", "$%", "d9", "E", "ü<>", "f", "g", "h\x0b"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
    common = [line() for _ in range(4)]
    rows = []
    for i in range(300):
        lines = [rng.choice(common).upper() if rng.random() < 0.5 else line() for _ in range(rng.randint(0, 8))]
        lines += rng.sample(lines, min(len(lines), rng.randint(0, 2))) + rng.choice([[], ["", " \t"]])
        rows.append((i, "\n".join(lines), rng.choice(["x", "y", None, ""])))
    rows += [(None, None, "x"), (5, "", None), rows[7], rows[7], (301, "w " * 30_000, "x"), (302, "one two three four five " * 2, "y")]
    return rows


def test_against_plain_counts(spark):
    rows = docs()
    frame = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, source string, kept string, n_words int")
    out = line_frequency.judge(frame, least_docs=8, least_share=0.1, least_left=0.5)
    got = [tuple(r) for r in out.select("doc_id", *line_frequency.RESULTS).collect()]
    assert sorted(got, key=str) == sorted(judged(rows, 8, 0.1, 0.5), key=str)
    assert line_frequency.judge(frame.limit(0)).count() == 0


def test_copies_do_not_make_lines_common(spark):
    rows = [(i, "the same ten words of one text that is copied often", "x") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r["kept"] for r in line_frequency.judge(frame).collect())


def test_remove_common(spark):
    rows = [(i, f"own {chr(97 + i)}\nShared  LINE 7\nend {'z' * i}", "x") for i in range(30)] + [(None, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    common = line_frequency.common_lines(line_frequency.count(frame), 20, 0.01)
    out = line_frequency.remove_common(frame, common).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([(i, f"own {chr(97 + i)}\nend {'z' * i}") for i in range(30)] + [(None, None)], key=str)
