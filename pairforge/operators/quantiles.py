"""Exact quantiles by refined histograms: each pass counts values in a fixed number of bins around the ranks that are asked for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 256


def order_statistics(df: DataFrame, value: str, ranks: list[int], bins: int = BINS) -> dict[int, float]:
    """The values of the given ranks, from 0, among the finite and infinite values of a column; nulls and NaN do not count.

    A pass keeps count, least and greatest value of `bins` bins for each interval that holds a rank; the next one cuts only the bins that hold
    one, down to bins of one value.  Intervals are disjoint, so a row counts once, and what comes to the driver is bins times ranks, whatever
    the table.  `df` is read once a pass: it should be a written table.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    inf = float("inf")
    finite = (F.col("x") > -inf) & (F.col("x") < inf)
    lower, n, upper, least, most = rows.agg(F.count_if(F.col("x") == -inf), F.count_if(finite), F.count_if(F.col("x") == inf), F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x")))).first()
    found: dict[int, float] = {}
    todo: dict[tuple[float, float, int], list[int]] = {}  # (least, most, values below it): ranks within
    for r in sorted(set(ranks)):
        if not 0 <= r < lower + n + upper:
            raise ValueError(f"no rank {r} among {lower + n + upper} values")
        if r < lower or r >= lower + n:
            found[r] = -inf if r < lower else inf
        else:
            todo.setdefault((least, most, lower), []).append(r)
    while todo:
        for (lo, hi, _), inside in list(todo.items()):
            if lo == hi:
                found |= dict.fromkeys(inside, lo)
        todo = {k: v for k, v in todo.items() if k[0] != k[1]}
        if not todo:
            break
        intervals = list(todo)
        place = F.lit(None).cast("int")
        cut = F.lit(None).cast("int")
        for k, (lo, hi, _) in enumerate(intervals):
            here = F.col("x").between(lo, hi)
            share = (F.col("x") - lo) / (hi - lo) if hi - lo < inf else (F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves where the span overflows
            place = F.when(here, k).otherwise(place)
            cut = F.when(here, F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")).otherwise(cut)
        counted = rows.select("x", place.alias("k"), cut.alias("b")).where("k is not null").groupBy("k", "b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        below = {k: key[2] for k, key in enumerate(intervals)}
        after: dict[tuple[float, float, int], list[int]] = {}
        for r in sorted(counted.collect(), key=lambda r: (r.k, r.b)):
            inside = [x for x in todo[intervals[r.k]] if below[r.k] <= x < below[r.k] + r.n]
            if inside:
                after[r.lo, r.hi, below[r.k]] = inside
            below[r.k] += r.n
        todo = after
    return found


def quantiles(df: DataFrame, value: str, shares: list[float], rule: str = "interpolated", bins: int = BINS) -> list[float | None]:
    """The quantiles of a column at the given shares; rule: interpolated between neighbours, or the lower or higher of them.  None where there is no value."""
    x = F.col(value).cast("double")
    n = df.where(x.isNotNull() & ~F.isnan(x)).count()
    if not n:
        return [None for _ in shares]
    at = [s * (n - 1) for s in shares]
    known = order_statistics(df, value, [f(p) for p in at for f in (math.floor, math.ceil)], bins)
    if rule == "lower":
        return [known[math.floor(p)] for p in at]
    if rule == "higher":
        return [known[math.ceil(p)] for p in at]
    pairs = [(known[math.floor(p)], known[math.ceil(p)], p - math.floor(p)) for p in at]
    return [a if a == b or not f else a + (b - a) * f for a, b, f in pairs]
