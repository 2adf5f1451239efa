import math
import random
from collections import Counter

import pytest

from pairforge.llm import kneser_ney


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney from the textbook definition; returns log probability of a byte after a context."""
    c = {order: Counter()}
    for t in texts:
        b = b"\n" * (order - 1) + t
        c[order].update(b[k : k + order] for k in range(len(t)))
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    ds = {}
    for k in c:
        n = [sum(v == i for v in c[k].values()) for i in (1, 2, 3, 4)]
        ds[k] = kneser_ney.discounts(n)

    def p(g):
        if not g:
            return 1 / 256
        k, h = len(g), g[:-1]
        below = p(g[1:])
        follow = {x: v for x, v in c[k].items() if x[:-1] == h}
        s = sum(follow.values())
        if not s:
            return below
        d = lambda v: ds[k][min(v, 3) - 1]
        gamma = sum(d(v) for v in follow.values()) / s
        v = follow.get(g, 0)
        return (v - d(v) if v else 0) / s + gamma * below

    return p


@pytest.mark.parametrize("most_rows", [1 << 20, 40])
def test_model_is_the_textbooks(spark, most_rows):
    texts = ["the cat sat on the mat", "the dog sat", "a cat ate the rat", "über den Wölfen", "", None, "that that that"]
    order = 3
    p = brute_model([(t or "").encode() for t in texts], order)
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in texts], "text string"), order)
    probe = ["the rat sat", "xyzzy", "", None, "über", "\n"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(probe)], "doc_id long, text string, g string")
    got = {r.doc_id: r.s for r in kneser_ney.score(docs, model, "s", order, most_rows).collect()}
    for k, t in enumerate(probe):
        raw = (t or "").encode()
        b = b"\n" * (order - 1) + raw
        want = sum(math.log(p(b[i : i + order])) for i in range(len(raw)))
        assert got[k].units == len(raw) and got[k].log_prob / kneser_ney.UNIT == pytest.approx(want, rel=1e-6, abs=1e-5)
    # probabilities after a context sum to one
    for h in (b"th", b"zz", b"e "):
        assert sum(p(h + bytes([x])) for x in range(256)) == pytest.approx(1)


def test_shards_change_nothing(spark, odd_docs):
    """However many shards, whatever the order of rows: the very same sums."""
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).select("text")
    model = kneser_ney.train(texts, 5)
    docs = texts.union(odd_docs.select("text").where("length(text) < 20000")).distinct()
    want = {r.text: r.s for r in kneser_ney.score(docs, model, "s").collect()}
    for rows in (500, 7000):
        assert {r.text: r.s for r in kneser_ney.score(docs.repartition(3), model, "s", most_rows=rows).collect()} == want


def test_report_against_brute_force(spark):
    """Folds, held-out quantiles, margin and room for short texts, from their definitions."""
    rng = random.Random(2)
    vocab = {"en": "the cat sat on a mat with one dog".split(), "es": "el gato come en la casa del perro".split(), None: "zu hund und haus".split()}
    docs = [(k, " ".join(rng.choices(vocab[x], k=rng.randint(2, 9))) + ("" if k % 7 else " qq#%&"), x) for k in range(60) for x in [["en", "es", None][k % 3]]]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(45)] + [(50, 0, 0)], "doc_id long, quality int, toxic int")
    folds = {r.doc_id: r.f for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 5) f").collect()}
    order, by = 3, {}

    def ppl(p, t):
        b = b"\n" * (order - 1) + t
        return math.exp(-sum(math.log(p(b[i : i + order])) for i in range(len(t))) / len(t))

    models = [brute_model([t.encode() for k, t, _ in docs if k < 45 and folds[k] != f], order) for f in range(5)]
    for k, t, x in docs:
        if k < 45:
            by.setdefault(x, []).append(ppl(models[folds[k]], t.encode()))
    limit = {x: sorted(v)[math.ceil(0.9 * len(v)) - 1] * 1.25 for x, v in by.items()}
    got = {r.doc_id: r for r in kneser_ney.report(df, labels, order=order, quantile=0.9).collect()}
    for k, t, x in docs:
        want, most = ppl(models[folds[k]], t.encode()), limit[x] * math.exp(2 / math.sqrt(len(t.encode())))
        assert got[k].perplexity == pytest.approx(want, rel=1e-4) and got[k].threshold == pytest.approx(most, rel=1e-4)
        assert got[k].rejected == (want > most) and got[k].n_bytes == len(t.encode())


def test_trusted_texts_are_judged_like_held_out_ones(spark):
    """Median perplexities of the trusted documents agree from fold to fold: none is scored by a model that has seen it."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    got = kneser_ney.report(docs, labels).selectExpr("doc_id", "perplexity", "pmod(xxhash64(doc_id), 5) f", "lang").where("lang = 'en'").collect()
    by = {}
    for r in got:
        if r.doc_id in trusted:
            by.setdefault(r.f, []).append(r.perplexity)
    middle = [sorted(v)[len(v) // 2] for v in by.values()]
    assert len(middle) == 5 and max(middle) < 1.08 * min(middle)


def test_exact_quantiles(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([1.0, 2.0, rng.random()])) for k in "abc" for _ in range(rng.randint(1, 400))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for q in (0.0, 0.5, 0.98, 1.0):
        want = {k: sorted(v for x, v in rows if x == k) for k in "abc"}
        got = {r.k: r.v for r in kneser_ney.quantiles(df, "k", "v", q).collect()}
        assert got == {k: v[max(0, math.ceil(q * len(v)) - 1)] for k, v in want.items()}


def test_rejects_junk_and_keeps_clean_texts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in kneser_ney.report(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r for r in labels.collect()}
    junk = [got[d].rejected for d, r in truth.items() if r.quality == 0]
    clean = [got[d].rejected for d, r in truth.items() if r.quality == 1]
    assert sum(clean) <= 0.005 * len(clean)
    assert sum(junk) >= 0.6 * len(junk)


def test_odd_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = kneser_ney.without_rejected(odd_docs, none)
    assert out.count() == odd_docs.count() and out.schema.names == odd_docs.schema.names
    some = spark.createDataFrame([(3, 1, 0), (6, 1, None), (6, 1, 0), (9, None, 0), (None, 1, 0), (18, 1, 1), (21, 0, 0), (36, 1, 0)], "doc_id long, quality int, toxic int")
    q = {r.doc_id: r for r in kneser_ney.report(odd_docs, some, least=1).collect()}
    assert len(q) == odd_docs.count() and q[-6].perplexity is None and not q[-6].rejected
    assert kneser_ney.report(odd_docs.limit(0), some).collect() == []


@pytest.mark.parametrize("n", [[0, 0, 0, 0], [5, 0, 0, 0], [0, 3, 1, 0], [1, 1, 50, 1], [3, 9, 1, 80], [100, 40, 20, 10], [7, 3, 0, 2]])
def test_discounts_leave_something_for_the_unseen(n):
    for k, d in enumerate(kneser_ney.discounts(n)):
        assert 0 < d <= k + 1


def test_text_of_few_and_frequent_ngrams(spark):
    """Counts with hardly any rare n-gram, as in a large corpus of a small language."""
    model = kneser_ney.train(spark.createDataFrame([("abc " * 300,), ("abd " * 300,), ("abd abd abc x",)], "text string"), 4)
    got = kneser_ney.score(spark.createDataFrame([("abc abd",), ("zzzz",), ("ab",)], "text string"), model, "s", 4).collect()
    assert all(math.isfinite(r.s.log_prob) for r in got)
    assert got[0].s.log_prob / 7 > got[1].s.log_prob / 4


@pytest.mark.parametrize("n_labels", [0, 10])
def test_clean_texts_of_a_language_with_few_labels_pass(spark, n_labels):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    spanish = {r.doc_id for r in docs.where("lang = 'es'").select("doc_id").collect()}
    rows = labels.collect()
    clean = sorted(r.doc_id for r in rows if r.quality == 1 and not r.toxic and r.doc_id in spanish)
    assert len(clean) > 100
    kept = set(clean[:n_labels])
    few = spark.createDataFrame([r for r in rows if r.doc_id not in spanish or r.doc_id in kept], labels.schema)
    got = {r.doc_id: r for r in kneser_ney.report(docs, few).collect()}
    rejected = sum(got[d].rejected for d in clean)
    if not n_labels:
        assert not rejected and all(got[d].threshold is None for d in clean)
    assert rejected <= 0.05 * len(clean)
    assert sum(got[r.doc_id].rejected for r in rows if r.quality == 0 and r.doc_id not in spanish) > 0
