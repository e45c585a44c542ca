"""Quality classifier: evidence of a document, pooled with its path and its host.

1. Counts of a text are cut into bins; the labelled documents give every bin the log of how much more
   often good documents fall into it than bad ones (counts of neighbouring bins are mixed, and
   ``alpha`` is added to each). A document's
   *evidence* is its worst measure plus, damped, the sum of the others: bad documents are bad in one
   way or another, and being in order otherwise does not make up for it.
2. With the global share of good documents as prior, evidence gives every document, labelled or not, a
   probability. A host's rate is the mean over its documents, shrunk towards the global rate with a
   prior strength that the spread between hosts tells (method of moments); a path's rate is shrunk
   towards its host's in the same way. Sparse sites so stay near what lies above them.
3. A document's score combines its evidence with the rate of its path. It is kept from ``least`` on.

Everything but the table of bins (measures x bins, known beforehand) and two prior strengths stays
distributed; sites are summed up before any shuffle. Sums are of millionths, so that they do not
depend on the order of addition.

Defined results: null and empty texts have counts of 0; a null host or path is one of its own; rows
that repeat are scored each; without labels of both kinds evidence is 0 and nothing is rejected; an
empty table gives no rows; other columns pass through unless they have the name of a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialframes.llm import line_frequency
from spatialframes.llm.common import read
from spatialframes.session import settle

RESULTS = ("evidence", "host_rate", "path_rate", "score", "kept")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
BINS = 24


def _number(text: str, chars: str) -> Column:
    whole = F.coalesce(F.col(text), F.lit(""))
    return (F.length(whole) - F.length(F.translate(whole, chars, ""))).cast("long")


def _bin(value: Column, whole: Column) -> Column:
    """Bins of a ratio, finer near 0."""
    share = F.when(whole > 0, F.least(value / whole, F.lit(1.0))).otherwise(F.lit(0.0))
    return F.floor(F.sqrt(share) * (BINS - 1)).cast("int")


def measures() -> dict[str, Column]:
    """Bin numbers of the counts of :func:`line_frequency.count` and of ``__upper`` and ``__bang``."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": _bin(F.col("n_symbols"), n),
        "repeats": _bin(F.col("n_repeat_words"), n),
        "lines": _bin(F.col("n_dup_lines"), F.size("__lines") + F.col("n_dup_lines")),
        "upper": _bin(F.col("__upper"), chars),
        "bang": _bin(F.col("__bang"), n),
        "stutter": _bin(F.col("__stutter"), n),
    }


def measured(docs: DataFrame, text: str, host: str, path: str) -> DataFrame:
    """The rows without their text, with a bin per measure and the keys ``__h`` and ``__p``."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.struct(*[F.col(f"`{c}`") for c in kept if c != text]).alias("__row"),
        key(host).alias("__h"), key(path).alias("__p"), _number(text, _UPPER).alias("__upper"), _number(text, "!").alias("__bang"),
    ).select("__row", "__h", "__p", "__upper", "__bang", F.col(text).alias("__t"), F.lit(None).cast("string").alias("__s"))
    counted = line_frequency.count(rows, "__t", "__s")
    return counted.select("__row", "__h", "__p", *[c.alias(f"__m_{name}") for name, c in measures().items()])


def bin_weights(rows: DataFrame, labels: DataFrame, alpha: float) -> tuple[dict[str, list[float]], float, int, int]:
    """Weight of every bin of every measure, the share of good labels, and the numbers of labels."""
    names = list(measures())
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__good"))
    marked = rows.select(F.col("__row.doc_id").alias("doc_id"), *[f"__m_{m}" for m in names]).join(marks, "doc_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"__m_{m}").alias("b")) for m in names])).alias("x")
    table = marked.select("__good", pairs).groupBy("x.m", "x.b").agg(F.sum(F.when(F.col("__good") == 1, 1).otherwise(0)).alias("g"), F.count("*").alias("n")).collect()
    good = sum(r["g"] for r in table if r["m"] == names[0])
    bad = sum(r["n"] - r["g"] for r in table if r["m"] == names[0])
    weights = {m: [0.0] * BINS for m in names}
    if good and bad:
        by = {(r["m"], r["b"]): (r["g"], r["n"] - r["g"]) for r in table}
        for m in names:
            for b in range(BINS):
                # neighbours tell about each other, but not about a share of 0
                near = {0: {0: 1.0}, 1: {1: 0.75, 2: 0.25}}.get(b, {b - 1: 0.25, b: 0.5, b + 1: 0.25})
                g, w = (sum(part * by.get((m, x), (0, 0))[i] for x, part in near.items()) for i in (0, 1))
                ratio = math.log((g + alpha) / (good + alpha * BINS)) - math.log((w + alpha) / (bad + alpha * BINS))
                # a bin that no label has says nothing
                weights[m][b] = ratio if g + w else 0.0
    return weights, good / (good + bad) if good + bad else 0.5, good, bad


def _logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def strength(spread: float | None, rate: float) -> float:
    """Prior strength, in documents, of rates that vary around ``rate`` with variance ``spread``."""
    if not spread or spread <= 0:
        return 1e6
    return min(1e6, max(1.0, rate * (1 - rate) / spread - 1))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    least: float = 0.2,
    alpha: float = 0.25,
    damping: float = 0.3,
) -> DataFrame:
    """The rows with ``evidence, host_rate, path_rate, score, kept``, without the text.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad).
    """
    rows = settle(measured(docs, text, host, path))
    weights, share, good, bad = bin_weights(rows, labels, alpha)
    share = min(max(share, 0.001), 0.999)
    parts = [F.element_at(F.array(*[F.lit(v) for v in values]), F.col(f"__m_{m}") + 1) for m, values in weights.items()]
    worst = F.least(*parts)
    evidence = worst + damping * (sum(parts, F.lit(0.0)) - worst)
    rows = rows.select("__row", "__h", "__p", evidence.alias("evidence"))
    millionths = F.round(_sigmoid(F.col("evidence") + math.log(share / (1 - share))) * 1e6).cast("long")
    paths = settle(rows.groupBy("__h", "__p").agg(F.sum(millionths).alias("s"), F.count("*").alias("n")))
    hosts = paths.groupBy("__h").agg((F.sum("s") / 1e6).alias("hs"), F.sum("n").alias("hn"))

    whole = hosts.agg((F.sum("hs") / F.sum("hn")).alias("rate")).first()["rate"]
    rate = min(max(whole if whole is not None else share, 0.001), 0.999)
    # variance between hosts beyond that of a mean of hn documents
    noise = rate * (1 - rate)
    between = hosts.agg((F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - rate, 2) - noise) / F.sum("hn")).alias("v"))
    k_host = strength(between.first()["v"], rate)
    hosts = hosts.withColumn("host_rate", (k_host * rate + F.col("hs")) / (k_host + F.col("hn")))
    both = paths.join(hosts.select("__h", "host_rate"), "__h")
    inner = both.agg((F.sum(F.col("n") * F.pow(F.col("s") / 1e6 / F.col("n") - F.col("host_rate"), 2) - F.col("host_rate") * (1 - F.col("host_rate"))) / F.sum("n")).alias("v"))
    k_path = strength(inner.first()["v"], rate)
    sites = settle(both.select("__h", "__p", "host_rate", ((k_path * F.col("host_rate") + F.col("s") / 1e6) / (k_path + F.col("n"))).alias("path_rate")))

    scored = rows.join(sites, ["__h", "__p"])
    inside = F.least(F.greatest("path_rate", F.lit(1e-6)), F.lit(1 - 1e-6))
    scored = scored.withColumn("score", _sigmoid(F.col("evidence") + _logit(inside)))
    verdict = F.col("score") >= least if good and bad else F.lit(True)
    return scored.select("__row.*", "evidence", "host_rate", "path_rate", "score", verdict.alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return classify(docs, read(spark, sf_dir, "labels", "doc_id", "quality")).select("doc_id", *RESULTS)
