"""Whole rows of scores are ranked where they are made, and no score leaves its task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairforge.functions import shared
from pairforge.operators import maxsim, ranking, roundtrip
from test_pairs import plan, sides


def test_full_ranks_give_one_row_a_query(spark):
    left, right, a, b = sides(spark)
    ranked = ranking.full_ranks(a, b, "g", 7)
    assert "Window" not in plan(ranked) and "Exchange" not in plan(ranked).replace("Exchange SinglePartition", "")
    got = {r.q: r for r in ranked.collect()}
    want = {r.q: r for r in ranking.ranks(a, b, "g").collect()}
    assert len(got) == len(want) == 60
    for q, r in want.items():
        assert (r.pos, r.best_pos, r.ungrouped, r.grouped) == (got[q].pos, got[q].best_pos, got[q].ungrouped, got[q].grouped)
    lone = got[0]  # without a group: only its own candidate is relevant
    assert lone.ap == pytest.approx(1 / lone.grouped)


def test_order_of_scores_beyond_two():
    v, place = np.array([5.0, -5000.0, 5.0, 0.1]), np.array([3, 0, 1, 2])
    rel = np.array([True, False, False, True])
    assert ranking._by_score(v, place, rel).tolist() == [False, True, True, False]
    assert ranking._by_score(v / 1e4, place, rel).tolist() == [0, 1, 1, 0]


def test_whole_numbers_rank_as_doubles():
    rng = np.random.default_rng(3)
    for trial in range(200):
        n, most = int(rng.integers(1, 300)), int(rng.choice([2, 40, 10**9]))
        v = rng.integers(-most, most + 1, n).astype(np.int32)
        rel = rng.random(n) < rng.choice([0, 0.1, 0.6])
        own = rng.choice(n, int(rng.integers(0, min(n, 2) + 1)), replace=False)
        rel[own] = True
        by_id = rng.permutation(n).astype(np.int64)
        assert ranking._whole_row(v, by_id, rel, own) == ranking._double_row(v / 1e9, by_id, rel, own)


def test_few_ties_in_a_long_row_are_put_in_order():
    rng = np.random.default_rng(4)
    v = rng.integers(-(10**9), 10**9, 40000).astype(np.int32)
    v[rng.choice(40000, 300, replace=False)] = v[rng.choice(40000, 100, replace=False)].repeat(3)
    rel, by_id = rng.random(40000) < 0.3, rng.permutation(40000).astype(np.int64)
    assert ranking._whole_row(v, by_id, rel, np.array([], int)) == ranking._double_row(v / 1e9, by_id, rel, np.array([], int))


def test_each_file_of_blocks_is_a_task_and_long_tokens_are_ranked_as_doubles(spark):
    _, _, a, b = sides(spark)
    whole = ranking.full_ranks(a, b, "g", 7)
    assert whole.rdd.getNumPartitions() == 9
    scaled = a.withColumn("tokens", F.transform("tokens", lambda v: F.transform(v, lambda x: x * 3)))
    got, want = ({r.q: (r.ungrouped, r.grouped, r.ap) for r in df.collect()} for df in (ranking.full_ranks(scaled, b, "g", 7), whole))
    assert maxsim._evenly(scaled)[2] == pytest.approx(3) and got == want


def test_equal_queries_are_scored_once(spark):
    left, right, a, b = sides(spark)
    right[5] = (5, right[5][1], "z")  # query 5 has a relevant candidate that no other has
    schema = "tokens array<array<double>>, g string"
    b = spark.createDataFrame(right, "c long, " + schema)
    more = [(q + 100, x[::-1], g) for q, x, g in left] + [(200, left[5][1], left[5][2])]
    both = spark.createDataFrame(left + more, "q long, " + schema)
    once = ranking.asked_once({"": both}, b, "g").collect()
    stays = {5} | {k for k in range(60) if k % 7 == 0}
    assert len(once) == 60 + len(stays) and sorted(x.q for r in once for x in r.asked) == sorted(q for q, _, _ in left + more)
    got = {r.q: (r.best_pos, r.grouped, r.ap) for r in ranking._each_ranked({"": both}, b, "g").collect()}
    want = {r.q: (r.best_pos, r.grouped, r.ap) for r in ranking.full_ranks(both, b, "g").collect()}
    assert len(got) == 121 and got == want


def test_round_trips_share_passes(spark, monkeypatch):
    asked = []
    was = ranking.full_ranks
    monkeypatch.setattr(ranking, "full_ranks", lambda left, *a: asked.append(left.count()) or was(left, *a))
    _, _, a, b = sides(spark)
    a = a.withColumn("g", F.coalesce("g", F.lit("n")))
    records = a.selectExpr("q AS row_idx", "g AS uid", "tokens AS z_src").join(b.selectExpr("c AS row_idx", "tokens AS z_gen", "reverse(tokens) AS z_true"), "row_idx")
    m = {r.comparison: r.asDict() for r in roundtrip.measures(records).collect()}
    assert asked == [60, 60] and set(m) == set(roundtrip.COMPARISONS)
    gen, true = ({k: v for k, v in m[c].items() if k != "comparison"} for c in ("generated_to_source", "true_to_source"))
    assert gen == true and gen["n"] == 60
    ranks = sorted(r.grouped for r in ranking.ranks(b.drop("g").join(a.select(F.col("q").alias("c"), "g"), "c").withColumnRenamed("c", "q"), a.withColumnRenamed("q", "c"), "g").collect())
    assert gen["r1"] == pytest.approx(sum(r <= 1 for r in ranks) / 60) and gen["median_rank"] == ranks[29]


def test_blocks_below_a_folder_with_odd_characters(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_base", lambda _: f"file://{tmp_path}/a b%20c")
    _, _, a, b = sides(spark)
    assert ranking.full_ranks(a, b, "g", 7).count() == 60
