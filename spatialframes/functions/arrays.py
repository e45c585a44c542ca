"""Dense arrays from (position, value) entries.

Catalyst looks up an entry by reading the array, which is quadratic for filling a grid. So the entries are sorted
and each is followed by as many missing values as lie before the next: linear, and one row at a time in memory.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACED = "array<struct<at:int,nth:int,value:double>>"


def scatter(entries: Column, size: int | Column, missing: float = 0.0) -> Column:
    """Array of ``size`` doubles from structs ``(at, value)``; the last entry of a position wins.

    Without entries, or for NULL, all are missing; an entry whose value is NULL is NaN.
    """
    n = (F.lit(size) if isinstance(size, int) else size).cast("int")
    fill, nan = F.lit(float(missing)), F.lit(float("nan"))
    placed = F.transform(entries, lambda e, i: F.struct(e["at"].cast("int").alias("at"), i.alias("nth"), F.coalesce(e["value"].cast("double"), nan).alias("value")))
    # a first entry before all positions, for the missing values that lie before the first
    before = F.array(F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("nth"), fill.alias("value"))).cast(_PLACED)
    ordered = F.sort_array(F.concat(before, F.coalesce(placed.cast(_PLACED), F.array().cast(_PLACED))))
    pairs = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda e, after: F.struct(e["at"].alias("at"), e["value"].alias("value"), after["at"].alias("next")))
    last = F.filter(pairs, lambda p: p["next"].isNull() | (p["next"] != p["at"]))
    runs = F.transform(last, lambda p: F.concat(F.array(p["value"]), F.array_repeat(fill, F.coalesce(p["next"], n) - p["at"] - 1)))
    return F.slice(F.flatten(runs), 2, n)
