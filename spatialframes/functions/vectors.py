"""Expressions over probability arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; a lambda would recompute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column) -> Column:
    def exps(s):
        return F.transform(s["x"], lambda v: F.exp(v - s["top"]))

    def share(s):
        return F.transform(s["e"], lambda v: v / s["total"])

    def normalized(e):
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return let(F.struct(e.alias("e"), total.alias("total")), share)

    shifted = let(F.struct(logits.alias("x"), F.array_max(logits).alias("top")), exps)
    return let(shifted, normalized)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def argmax(probs: Column) -> Column:
    """Zero-based position of the largest entry, the first one on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def threshold_grid(n: int = 50, low: float = 0.01, high: float = 0.99) -> list[float]:
    """The grid of decision thresholds, ends included."""
    step = (high - low) / (n - 1)
    return [i * step + low for i in range(n)]
