"""Ranks and retrieval measures.  Ties count against the pair without groups and for it with them."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.shared import settled
from pairforge.operators.maxsim import BLOCK, UNITS, Rough, all_pairs, all_rows, codes, matches
from pairforge.operators.quantiles import quantiles


RULES = ("ungrouped", "grouped")


def both_ranks(left: DataFrame, right: DataFrame, relevant: str | None = None, sides: tuple[int, ...] = (0, 1), rules: tuple[str, ...] = RULES) -> DataFrame:
    """(side, id, pos, best_pos, and of ungrouped, grouped what `rules` names): of each query among the candidates (side 0) and of each candidate among the
    queries (side 1) the own pair's score, the best relevant score, and the ranks under both rules.

    left: q, tokens; right: c, tokens; the own pair is q = c; `relevant` names a column of both whose equality makes a pair
    relevant too.  Own and relevant scores come from blocks of like ids and like groups alone; one pass over all blocks then counts what stands above them,
    for both sides at once.  Each block gives one row an item; the score matrix is never kept.
    """

    def met(x: pd.DataFrame, y: pd.DataFrame, s: Rough, best: Callable[[int], np.ndarray]) -> pd.DataFrame:
        out = pd.concat([pd.DataFrame({"side": k, "id": ids.to_numpy(), "s": best(1 - k)}) for k, ids in ((0, x.q), (1, y.c)) if k in sides])
        return out[out.s > -np.inf]

    def own_best(x: pd.DataFrame, y: pd.DataFrame, s: Rough) -> pd.DataFrame:
        one, two = (pd.DataFrame({"id": v.to_numpy(), k: np.arange(len(v))}).dropna() for v, k in ((x.q, "i"), (y.c, "j")))
        i, j = one.merge(two, on="id")[["i", "j"]].to_numpy().T
        v = s.exact(i, j)

        def best(axis: int) -> np.ndarray:
            most = np.full(len(x) if axis else len(y), -np.inf)
            np.maximum.at(most, i if axis else j, v)
            return most

        return met(x, y, s, best)

    def relevant_best(x: pd.DataFrame, y: pd.DataFrame, s: Rough) -> pd.DataFrame:
        mask = matches(x[relevant], y[relevant])
        return met(x, y, s, lambda axis: s.best(mask, axis) if mask.any() else np.full(mask.shape[1 - axis], -np.inf))

    left, right = (settled(df, "side") for df in (left, right))  # read by every pass
    every = [df.select(F.lit(k).alias("side"), F.col(c).alias("id")) for k, (df, c) in enumerate(((left, "q"), (right, "c"))) if k in sides]
    every = every[0] if len(every) == 1 else every[0].union(every[1])
    schema = "side int, id long, s double"
    pos = all_pairs(left, right, own_best, schema, near=("q", "c"), rough=True).groupBy("side", "id").agg(F.max("s").alias("pos"))
    lowest = F.lit(float("-inf"))
    known = every.join(pos, ["side", "id"], "left")
    if relevant:
        top = all_pairs(left, right, relevant_best, schema, near=(relevant, relevant), rough=True).groupBy("side", "id").agg(F.max("s").alias("top"))
        known = known.join(top, ["side", "id"], "left")
    best = F.greatest("pos", "top") if relevant else F.col("pos")
    known = settled(known.select("side", "id", F.col("pos").isNotNull().cast("long").alias("has"), F.coalesce("pos", lowest).alias("pos"), F.coalesce(best, lowest).alias("best_pos")), "positives")

    def with_known(df: DataFrame, k: int, c: str) -> DataFrame:
        return df.join(known.where(F.col("side") == k).select(F.col("id").alias(c), "pos", "best_pos"), c) if k in sides else df

    def above(x: pd.DataFrame, y: pd.DataFrame, s: Rough) -> pd.DataFrame:
        q, c = x.q.to_numpy(), y.c.to_numpy()
        mine, theirs = codes(x[relevant], y[relevant]) if relevant else (None, None)
        own = lambda i, j: q[i] == c[j]
        rel = (lambda i, j: own(i, j) | (mine[i] == theirs[j])) if relevant else own
        out = []
        for k, df, ids in ((0, x, q), (1, y, c)):
            if k in sides:
                n = s.beyond(df.pos.to_numpy(), 1 - k, True, own) if "ungrouped" in rules else 0
                m = s.beyond(df.best_pos.to_numpy(), 1 - k, False, rel) if "grouped" in rules else 0
                out.append(pd.DataFrame({"side": k, "id": ids, "n": n, "m": m}))
        return pd.concat(out)

    counted = all_pairs(with_known(left, 0, "q"), with_known(right, 1, "c"), above, "side int, id long, n long, m long", rough=True)
    counted = counted.groupBy("side", "id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    placed = known.join(counted, ["side", "id"])
    ranked = {"ungrouped": F.col("n") + F.col("has"), "grouped": F.col("m") + 1}
    return placed.select("side", "id", "pos", "best_pos", *(ranked[k].alias(k) for k in rules))


def ranks(left: DataFrame, right: DataFrame, relevant: str | None = None, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(q, pos, best_pos, and of ungrouped, grouped what `rules` names) of each query among the candidates, as `both_ranks` has them."""
    return both_ranks(left, right, relevant, (0,), rules).select(F.col("id").alias("q"), "pos", "best_pos", *rules)


def full_ranks(left: DataFrame, right: DataFrame, relevant: str, block: int = BLOCK, name: str = "q") -> DataFrame:
    """(q, pos, best_pos, ungrouped, grouped, ap): what `ranks` gives, and the mean precision at the relevant candidates, by falling score and then by c.

    One pass: each task has whole rows of scores and sorts them, of at most `block` queries at once; no score leaves it.
    name: the column of left that stands in q's place in the result, where rows of one q differ.
    """

    def place(x: pd.DataFrame, y: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        named, q, c = x[name].to_numpy(), x.q.to_numpy(), y.c.to_numpy()
        order = np.argsort(c, kind="stable")
        by_id = np.empty(len(c), np.int64)
        by_id[order] = np.arange(len(c))
        lo, hi = (np.searchsorted(c[order], q, side) for side in ("left", "right"))
        mine, theirs = codes(x[relevant], y[relevant])  # once a block
        of_row = _whole_row if s.dtype == np.int32 else _double_row
        out = []
        for i in range(len(q)):
            own, rel = order[lo[i] : hi[i]], theirs == mine[i]
            rel[own] = True
            out.append((named[i], *of_row(s[i], by_id, rel, own)))
        return pd.DataFrame(out, columns=[name, "pos", "best_pos", "ungrouped", "grouped", "ap"])

    return all_rows(left, right, place, f"{name} long, pos double, best_pos double, ungrouped long, grouped long, ap double", block)


def _precision(at: np.ndarray) -> float:
    """The mean precision at these places."""
    return float((np.arange(1, len(at) + 1) / at).sum() / max(1, len(at)))


def _double_row(v: np.ndarray, by_id: np.ndarray, rel: np.ndarray, own: np.ndarray) -> tuple[float, float, int, int, float]:
    """(pos, best_pos, ungrouped, grouped, ap) of one query's scores; own: places of its own candidates, which are in rel."""
    pos, best = v[own].max(initial=-np.inf), v[rel].max(initial=-np.inf)
    ahead = np.count_nonzero(v >= pos) - np.count_nonzero(v[own] >= pos)
    return pos, best, ahead + (len(own) > 0), np.count_nonzero(~rel & (v > best)) + 1, _precision(np.flatnonzero(_by_score(v, by_id, rel)) + 1)


def _whole_row(v: np.ndarray, by_id: np.ndarray, rel: np.ndarray, own: np.ndarray) -> tuple[float, float, int, int, float]:
    """The same of scores as whole numbers of 1 / UNITS: all of it comes from one sort of numbers of 32 bits, a score and whether it is relevant each."""
    keys = (np.int32(1 << 30) - v).view(np.uint32)
    keys <<= 1
    keys |= rel
    ranked, at = _places(keys, by_id)
    pos, best, ungrouped, grouped = -np.inf, -np.inf, len(v), len(v) + 1
    if len(own):
        top = int(v[own].max())
        pos = top / UNITS
        ungrouped = int(np.searchsorted(ranked, np.uint32(((1 << 30) - top) * 2 + 1), "right")) - np.count_nonzero(v[own] == top) + 1
    if len(at):
        first = ranked[at[0] - 1] >> 1
        best = ((1 << 30) - int(first)) / UNITS
        grouped = int(np.searchsorted(ranked, first << 1)) + 1
    return pos, best, ungrouped, grouped, _precision(at)


def _places(keys: np.ndarray, by_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, and the places (from 1) of the odd ones among all by key // 2 and then by_id.

    Where only one of two neighbours with equal key // 2 is odd, by_id decides.  These few are looked up and put in order by themselves, or all keys are
    where they are many.
    """
    out = np.sort(keys)
    odd = (out & 1).astype(bool)
    at = np.flatnonzero(odd)
    later = at[at > 0]
    tied = out[later[out[later] - out[later - 1] == 1]]
    if len(tied):
        maybe = np.zeros(1 << 16, bool)
        maybe[np.concatenate([tied, tied - 1]).astype(np.uint16)] = True
        near = np.flatnonzero(maybe[keys.astype(np.uint16)])
        if many := 8 * len(near) > len(keys):
            near, k = slice(None), keys
        else:
            k = keys[near] | 1
            found = tied[np.minimum(np.searchsorted(tied, k), len(tied) - 1)] == k
            near, k = near[found], k[found]
        each = ((k >> 1).astype(np.int64) << 32) + (by_id[near] << 1) + (keys[near] & 1)
        each.sort()
        if many:
            odd = (each & 1).astype(bool)
        else:
            k = (each >> 32).astype(np.uint32) << 1
            odd[np.searchsorted(out, k) + np.arange(len(k)) - np.searchsorted(k, k)] = each & 1
        at = np.flatnonzero(odd)
    return out, at + 1


def _by_score(v: np.ndarray, by_id: np.ndarray, rel: np.ndarray) -> np.ndarray:
    """rel by falling v (of 9 decimals) and rising by_id.  One number holds all three where v is within 2 and rows are fewer than 2**31."""
    if len(v) < 1 << 31 and np.abs(v).max(initial=0) <= 2:
        keys = (-np.rint(v * 1e9).astype(np.int64) << 32) + (by_id << 1) + rel
        keys.sort()
        return keys & 1
    return rel[np.lexsort((by_id, -v))]


def asked_once(sides: dict[str, DataFrame], right: DataFrame, relevant: str) -> DataFrame:
    """(id, q, tokens, relevant, asked): the queries of all sides, of which those are one that have the same tokens, in any order, and the same
    relevant candidates; asked: (side, q) of each.  Their best relevant score, rank by groups and average precision are the same.

    A query whose own candidate is not in its group has relevant candidates that no other has, so it stays by itself.
    """
    every = [df.select(F.lit(side).alias("side"), "q", F.array_sort("tokens").alias("tokens"), relevant) for side, df in sides.items()]
    every = settled(functools.reduce(DataFrame.union, every), "queries")
    own = right.select("c", F.col(relevant).alias("_of"))
    strays = every.join(own, F.col("q") == F.col("c")).where(~F.coalesce(F.col(relevant) == F.col("_of"), F.lit(False))).select("side", "q").distinct()
    every = every.join(strays.withColumn("_alone", F.col("q")), ["side", "q"], "left")
    once = every.groupBy("tokens", relevant, "_alone").agg(F.min("q").alias("q"), F.collect_list(F.struct("side", "q")).alias("asked"))
    return settled(once.select(F.monotonically_increasing_id().alias("id"), "q", "tokens", relevant, "asked"), "once")


def _each_ranked(sides: dict[str, DataFrame], right: DataFrame, relevant: str, block: int = BLOCK, how: str = "inner") -> DataFrame:
    """(side, q, best_pos, grouped, ap) of every query of every side, as `full_ranks` has them."""
    once = asked_once(sides, right, relevant)
    ranked = full_ranks(once.drop("asked"), right, relevant, block, "id").select("id", "best_pos", "grouped", "ap")
    return once.select("id", F.explode("asked").alias("a")).join(ranked, "id", how).select("a.side", "a.q", "best_pos", "grouped", "ap")


def average_precisions(left: DataFrame, right: DataFrame, relevant: str, block: int = BLOCK) -> DataFrame:
    """(q, ap): mean precision at the relevant candidates, by falling score and then by c; 0 without any."""
    return _each_ranked({"": left}, right, relevant, block, "left").select("q", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def measures_of(sides: dict[str, DataFrame], right: DataFrame, relevant: str, ks: tuple[int, ...] = (1, 5, 10)) -> dict[str, DataFrame]:
    """For each side, all against the same candidates in one pass, one row: n, recall at each k up to the number of queries (r1, ...), the lower median
    rank, the mean best relevant score, mean average precision."""
    ranked = settled(_each_ranked(sides, right, relevant), "ranks")

    def row(r: DataFrame) -> DataFrame:
        at = [F.when(F.count("*") >= k, F.avg((F.col("grouped") <= k).cast("double"))).alias(f"r{k}") for k in ks]
        middle = quantiles(r, "grouped", [0.5], "lower")[0]
        return r.agg(F.count("*").alias("n"), *at, F.lit(middle).cast("long").alias("median_rank"), F.avg("best_pos").alias("best_pos"), F.avg("ap").alias("map"))

    return {side: row(ranked.where(F.col("side") == side)) for side in sides}


def measures(left: DataFrame, right: DataFrame, relevant: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """The same of one side."""
    return measures_of({"": left}, right, relevant, ks)[""]


def recall(ranked: DataFrame, rank: str, ks: list[int]) -> DataFrame:
    return ranked.agg(*(F.avg((F.col(rank) <= k).cast("double")).alias(f"r{k}") for k in ks))
