import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from pairforge.llm import pq_dedup


def brute(rows, cosine=0.98):
    def fine(r):
        v = r[1]
        return r[2] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = dict.fromkeys(root, 0)
    groups = {}
    for r in rows:
        if fine(r):
            groups.setdefault((r[2], len(r[1])), []).append(r)
    for rs in groups.values():
        x = np.array([r[1] for r in rs], float)
        norm = np.sqrt((x * x).sum(1))
        link = (x @ x.T) / np.outer(norm, norm) >= cosine
        for i, a in enumerate(rs):
            n[a[0]] = int(link[i].sum()) - 1
            for j in np.flatnonzero(link[i]):
                p, q = sorted((find(a[0]), find(rs[j][0])))
                root[q] = p
    return sorted((i, n[i], find(i), find(i) == i) for i in root)


def test_table(spark, tables):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in tables["embeddings"]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, pq_dedup.near_duplicates(df).collect())) == brute(rows)


@pytest.mark.parametrize("list_rows,block_rows,sample", [(1000, 2048, 16384), (20, 16, 64)])
def test_copies_blocks_and_odd_vectors(spark, list_rows, block_rows, sample):
    rng = np.random.default_rng(7)
    rows = []
    for group in range(12):
        base = rng.normal(size=16)
        for k in range(40):
            v = base + rng.normal(size=16) * (0.05 if group % 2 else 0.12) * np.linalg.norm(base) / 4
            rows.append((len(rows), [float(np.float32(x)) for x in (v * rng.uniform(0.1, 9) if k % 4 else base)], group % 3 if k % 10 else None))
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [-0.0, 1.0], [0.0, 1.0]]
    rows += [(len(rows) + k, v, 1) for k, v in enumerate(odd)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, label int, list string, copies int")
    got = pq_dedup.near_duplicates(df.repartition(3), list_rows=list_rows, block_rows=block_rows, sample=sample)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert pq_dedup.near_duplicates(df.limit(0)).collect() == []
    assert len(pq_dedup.near_duplicates(df.where("embedding is null")).collect()) == 1


def test_probes_and_codes_lose_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24))
    x[300:] = x[:300] + rng.normal(size=(300, 24)) * 0.03
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q = pq_dedup.Quantiser(u, 12, words=32)
    at, codes, error = q.encode(u)
    r = math.sqrt(0.04)
    probes = q.probes(u, r)
    near = (u @ u.T) >= 0.98
    for i, j in zip(*np.nonzero(near), strict=True):
        assert probes[i, at[j]]
        assert q.distances(u[i : i + 1], at[j], codes[j : j + 1])[0, 0] <= r + error[j] + 1e-9
    assert probes.mean() < 0.9


def test_long_lists_are_cut_once_more(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(60, 12))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.04 * k for k in range(15)])
    rows = [(k, v.tolist(), 0 if k % 3 else 1) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    monkeypatch.setattr(pq_dedup, "MOST_LISTS", 3)  # far fewer first lists than rows ask for
    cut = []
    real = pq_dedup._cut
    monkeypatch.setattr(pq_dedup, "_cut", lambda *a: cut.append(real(*a)) or cut[0])
    monkeypatch.setattr(pq_dedup, "SALT_ROWS", 200)
    monkeypatch.setattr(pq_dedup, "SENT", 50)
    got = pq_dedup.near_duplicates(df, list_rows=15, block_rows=30)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    per = cut[0].where("kind = 0").groupBy("label", "list").agg({"sub": "max", "*": "count"}).collect()
    assert all(r["max(sub)"] > 0 for r in per if r["count(1)"] > 30) and any(r["count(1)"] > 30 for r in per)
    assert cut[0].where("kind = 0").count() == len(rows)


def test_nearest_in_parts_of_any_size():
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(5000, 3)), rng.normal(size=(2000, 3))
    assert np.array_equal(pq_dedup.nearest(x, c), ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)) and len(pq_dedup.nearest(x[:0], c)) == 0


def test_labels_are_compared_in_their_own_type(spark):
    """Fractions that one whole number would stand for, texts, and dates: equal labels only."""
    vectors = [(k, [1.0, 0.001 * k], x) for k, x in enumerate(["1.2", "1.7", "1.2", None, "b"])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, name string")
    for label in (F.expr("try_cast(name as double)"), F.col("name"), F.expr("case name when '1.2' then date'2024-01-01' when '1.7' then date'2024-01-02' end")):
        got = {r.vec_id: (r.n_links, r.component_id) for r in pq_dedup.near_duplicates(df.withColumn("label", label)).collect()}
        assert got == {0: (1, 0), 1: (0, 1), 2: (1, 0), 3: (0, 3), 4: (0, 4)}


def test_lists_to_visit_are_those_of_all_distances():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    cells = pq_dedup.Cells(x[:40])
    got = cells.probes(x, 0.2)
    far = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    at = pq_dedup.nearest(x, cells.centroids)
    i, j = np.nonzero(far <= 0.2)
    assert got[i, at[j]].all() and got.mean() < 0.8
