"""Toxicity by a linear-chain conditional random field over the tokens of a text.

**Token labels.** Labels are given per document. A token counts as toxic if it stands in a labelled
toxic document and its word, or one of the word's beginnings, leans to toxic documents: the log odds
ratio of the numbers of documents that hold it, with a weak prior, divided by its standard error, is
at least ``lean``.

**Model.** Two states per token, weights for the word, its beginnings of 3 to 8 letters and its
ending, and for the four transitions. It is fitted to the likelihood of the token labels in short
stretches round toxic tokens and in stretches of clean documents. The fit sees at most ``most_docs``
labelled documents of either kind, chosen by the digest of their id, and stretches of ``STRETCH``
tokens, ``PER_DOC`` a document at most; its size does not depend on the corpus. A shorter text is a
stretch as a whole, drawn as often; what it lacks is masked in the messages and the gradient.

**Scoring.** Forward-backward gives every token of a whole text its probability of the toxic state.
With two states the messages are ratios, one number each, and all texts of a batch are advanced
together. A document's score is a logistic function of the toxic tokens, counted by the squares of
their probabilities, fitted to
the same labelled documents; tokens above ``flag`` give the offending offsets (code points).

Defined results: null texts are empty, and empty texts score as texts without toxic tokens; labels
without text are left out, contradicting labels count as toxic; without labels of both kinds every
score is 0; rows that repeat are scored each; an empty table gives no rows; other columns pass through
unless they have the name of a result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialframes.llm.common import read, slices

RESULTS = ("score", "spans")
STRETCH, PER_DOC = 21, 6
_WORD = re.compile(r"[^\W_]+")
_HELD = 300_000  # words whose weight a task remembers


def features(word: str) -> list[str]:
    """The word, its beginnings and its ending."""
    return [f"w{word}", *[f"{n}{word[:n]}" for n in (3, 4, 5, 6, 7, 8) if len(word) >= n], f"e{word[-3:]}"]


def leaning(toxic: list[list[str]], clean: list[list[str]], lean: float) -> set[str]:
    """Words and beginnings that lean to toxic documents."""
    counts = []
    for docs in (toxic, clean):
        held = Counter()
        for words in docs:
            held.update({f for w in set(words) for f in features(w) if f[0] in "w45678"})
        counts.append(held)
    out, n, m = set(), len(toxic), len(clean)
    for f, a in counts[0].items():
        b = counts[1][f]
        odds = math.log((a + 0.5) / (n - a + 0.5)) - math.log((b + 0.5) / (m - b + 0.5))
        if odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= lean and odds > 3:
            out.add(f)
    return out


def marginals(potential: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of state 1 at every token of sequences that stand one after another.

    ``potential`` is the log weight of state 1 against 0 of each token, ``move[a, b]`` the weight of
    going from state a to b. Messages are ratios of state 1 to state 0.
    """
    own = np.exp(np.clip(potential, -30, 30))
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # sequences longer than t
    ahead, back = np.empty_like(own), np.ones_like(own)
    ratio = np.ones(0)
    for t in range(steps):
        at = first[: active[t]] + t
        if t:
            ratio = ratio[: active[t]]
            ratio = own[at] * (move[1, 1] * ratio + move[0, 1]) / (move[1, 0] * ratio + move[0, 0])
        else:
            ratio = own[at]
        ahead[at] = ratio
    ratio = np.ones(0)
    for t in range(steps - 1, 0, -1):
        k = active[t]
        ratio = np.concatenate([ratio, np.ones(k - len(ratio))])
        at = first[:k] + t
        nxt = own[at] * ratio
        ratio = (move[1, 1] * nxt + move[1, 0]) / (move[0, 1] * nxt + move[0, 0])
        back[at - 1] = ratio
    both = ahead * back
    return both / (1 + both)


def amounts(probabilities: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Toxic tokens of each text. The small doubt at each of many tokens must not add up: tokens below
    a tenth do not count, others by their squares."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(probabilities >= 0.1, probabilities**2, 0.0))])
    ends = np.cumsum(lengths)
    return np.maximum(sums[ends] - sums[ends - lengths], 0)


class Model:
    """Weights of features and transitions, and the logistic function from token to document."""

    def __init__(self, weights: dict[str, float], bias: float, move: np.ndarray, curve: tuple[float, float]):
        self.weights, self.bias, self.move, self.curve = weights, bias, move, curve

    def potential(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))

    def tokens(self, texts: list[list[str]], held: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of all tokens, and the lengths of the texts."""
        if len(held) > _HELD:
            held.clear()
        for words in texts:
            for word in words:
                if word not in held:
                    held[word] = self.potential(word)
        flat = np.array([held[w] for words in texts for w in words], float)
        lengths = np.array([len(words) for words in texts], np.int64)
        return marginals(flat, lengths, self.move), lengths

    def scores(self, probabilities: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] + self.curve[1] * np.log1p(amounts(probabilities, lengths)))))


def _fit_chain(rows: np.ndarray, mask: np.ndarray, goal: np.ndarray, n_features: int, rounds: int, decay: float, sizes: np.ndarray):
    """Weights and transitions by gradient steps on stretches of ``sizes`` tokens.

    ``rows`` has the feature numbers of each token of each stretch, ``mask`` is 0 where there is none.
    What stands after the tokens of a stretch has no part in the likelihood.
    """
    weights, bias, moves = np.zeros(n_features), -2.0, np.zeros((2, 2))
    n, length, _ = rows.shape
    real = np.arange(length) < sizes[:, None]
    follows = real[:, 1:]
    state = [np.zeros(n_features), np.zeros(n_features), 0.0, 0.0, np.zeros((2, 2)), np.zeros((2, 2))]
    scale = 1.0 / max(1, n)
    for step in range(1, rounds + 1):
        potential = (weights[rows] * mask).sum(2) + bias
        move = np.exp(moves)
        own = np.exp(np.clip(potential, -30, 30))
        ahead = np.zeros((n, length, 2))
        back = np.ones((n, length, 2))
        both = np.stack([np.ones_like(own), own], 2)
        ahead[:, 0] = both[:, 0] / both[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            ahead[:, t] = both[:, t] * (ahead[:, t - 1] @ move)
            ahead[:, t] /= ahead[:, t].sum(1, keepdims=True)
        for t in range(length - 1, 0, -1):
            back[:, t - 1] = (both[:, t] * back[:, t]) @ move.T
            back[:, t - 1] /= back[:, t - 1].sum(1, keepdims=True)
            back[~real[:, t], t - 1] = 1.0  # nothing follows
        token = ahead * back
        token = token[:, :, 1] / token.sum(2)
        pair = ahead[:, :-1, :, None] * move * (both[:, 1:] * back[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (goal[:, :-1][follows], goal[:, 1:][follows]), 1)
        error = (token - goal) * real
        g_weights = np.bincount(rows.ravel(), (error[:, :, None] * mask).ravel(), n_features) * scale + decay * weights
        g_bias = error.sum() * scale
        g_moves = (pair[follows].sum(0) - seen) * scale
        rate = 0.3 / (1 + step / rounds)
        fresh = []
        for i, (value, slope) in enumerate(((weights, g_weights), (bias, g_bias), (moves, g_moves))):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * slope
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * slope**2
            fresh.append(value - rate * (state[2 * i] / (1 - 0.9**step)) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**step)) + 1e-8))
        weights, bias, moves = fresh
    return weights, float(bias), np.exp(moves)


def _fit_curve(amount: np.ndarray, goal: np.ndarray) -> tuple[float, float]:
    """Logistic function of ``log1p(amount)``, by Newton steps with a weak prior."""
    x = np.stack([np.ones_like(amount), np.log1p(amount)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (p - goal) + 0.05 * beta
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(beta[0]), float(beta[1])


def fit(toxic: list[str], clean: list[str], lean: float = 3.5, rounds: int = 60) -> Model | None:
    """A model of the labelled texts; None without texts of both kinds."""
    if not toxic or not clean:
        return None
    toxic, clean = sorted(set(toxic)), sorted(set(clean))
    words = [[_WORD.findall(t.lower()) for t in docs] for docs in (toxic, clean)]
    leans = leaning(*words, lean)
    rng = np.random.default_rng(7)
    stretches, goals = [], []
    for kind, docs in enumerate(words):
        for doc in docs:
            marks = [kind == 0 and any(f in leans for f in features(w)) for w in doc]
            centres = [i for i, m in enumerate(marks) if m] if kind == 0 else []
            centres = [centres[i] for i in rng.permutation(len(centres))[: PER_DOC // 2]]
            centres += rng.integers(0, len(doc), PER_DOC // 2).tolist() if doc else []
            for c in centres:
                start = max(0, min(c - STRETCH // 2, len(doc) - STRETCH))
                part, mark = doc[start : start + STRETCH], marks[start : start + STRETCH]
                stretches.append(part)
                goals.append(mark + [False] * (STRETCH - len(part)))
    if not stretches:
        return None
    seen = Counter(f for part in stretches for w in part for f in features(w))
    number = {f: i + 1 for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    rows = np.zeros((len(stretches), STRETCH, 8), np.int64)
    for i, part in enumerate(stretches):
        for t, word in enumerate(part):
            own = [number[f] for f in features(word) if f in number]
            rows[i, t, : len(own)] = own
    sizes = np.array(list(map(len, stretches)), np.int64)
    weights, bias, move = _fit_chain(rows, rows > 0, np.array(goals, np.int64), len(number) + 1, rounds, 1e-4, sizes)
    model = Model({f: float(weights[i]) for f, i in number.items() if abs(weights[i]) > 1e-3}, bias, move, (0.0, 1.0))
    found, lengths = model.tokens([d for docs in words for d in docs], {})
    model.curve = _fit_curve(amounts(found, lengths), np.repeat([1.0, 0.0], [len(toxic), len(clean)]))
    return model


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", most_docs: int = 1500) -> Model | None:
    """A model from at most ``most_docs`` labelled documents of either kind."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("__toxic"))
    chosen = []
    for value in (1, 0):
        own = marks.where(F.col("__toxic") == value).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(most_docs)
        chosen += own.collect()
    if not chosen:
        return None
    # at most 2 * most_docs ids and marks
    few = F.broadcast(docs.sparkSession.createDataFrame(chosen, marks.schema))
    found = docs.select("doc_id", F.col(text).alias("__text")).where(F.col("__text") != "").join(few, "doc_id").collect()
    found = sorted(found, key=lambda r: (r["doc_id"], r["__text"]))
    return fit([r["__text"] for r in found if r["__toxic"] == 1], [r["__text"] for r in found if r["__toxic"] != 1])


def score(docs: DataFrame, model: Model | None, text: str = "text", flag: float = 0.5) -> DataFrame:
    """The rows without their text, with ``score`` and the offending ``spans`` ``(start, end, p)``."""
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])
    schema = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, float] = {}
        for batch in slices(batches, text, 4_000_000):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            spans: list[list[dict]] = [[] for _ in texts]
            if model is None:
                values = np.zeros(len(texts))
            else:
                found, lengths = model.tokens([_WORD.findall(t.lower()) for t in texts], held)
                values = model.scores(found, lengths)
                ends = np.cumsum(lengths)
                for i in np.unique(np.searchsorted(ends, np.flatnonzero(found >= flag), side="right")):
                    own = found[ends[i] - lengths[i] : ends[i]]
                    spans[i] = _offsets(texts[i], own, flag)
            names = [c for c in batch.schema.names if c != text]
            columns = [batch.column(c) for c in names] + [pa.array(values, pa.float64()), pa.array(spans, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *RESULTS])

    return rows.mapInArrow(run, schema)


def _offsets(text: str, own: np.ndarray, flag: float) -> list[dict]:
    """Places of the tokens above ``flag``; lower case may be longer than the text, so it is mapped back."""
    lower = text.lower()
    places = [m.span() for m in _WORD.finditer(lower)]
    back = None
    if len(lower) != len(text):
        back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    out = []
    for t in np.flatnonzero(own >= flag):
        start, end = places[t]
        if back:
            start, end = back[start], back[end - 1] + 1
        out.append({"start": start, "end": end, "p": float(own[t])})
    return out


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out(F.col("doc_id")))
    scored = score(docs, learn(docs, labels))
    predicted = F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"), "spans")
