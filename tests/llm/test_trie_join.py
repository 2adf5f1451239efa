import random
import re

import numpy as np
import pytest

from pairforge.llm import trie_join


def sets_of(docs, ngram=5):
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[d] = {tuple(w[k : k + ngram]) for k in range(len(w) - ngram + 1)} if len(w) >= ngram else ({tuple(w)} if w else set())
    return out


def brute(docs, ngram=5, percent=75):
    sets = sets_of(docs, ngram)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        for t in s:
            by.setdefault(t, []).append(d)
    pairs = {(a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[i + 1 :]}
    for a, b in pairs:
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in sets)


def near_copies(seed, bases=6, each=30):
    rng = random.Random(seed)
    out = []
    for b in range(bases):
        words = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(8, 120))]
        for k in range(each):
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
            out.append(" ".join(w) if k % 3 else " ".join(w).upper())
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("few", [2, 8, 1000])
def test_components(spark, few):
    docs = near_copies(few)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for frequent, hot in ((0, 1 << 16), (1 << 18, 1 << 16), (1 << 18, 5)):
        got = trie_join.near_duplicates(df, few=few, bucket_tokens=300, group_sets=7, most_frequent=frequent, block_sets=9, hot_sets=hot)
        assert sorted(map(tuple, got.collect())) == brute(docs)


def test_words_made_to_agree_under_polynomials(spark):
    a = "".join("ab"[k.bit_count() & 1] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    docs = [(1, f"{a} one two three four five six"), (2, f"{b} one two three four five six"), (3, a), (4, b), (5, a)]
    got = trie_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_blocks_give_no_more_links_than_rows(spark, monkeypatch):
    """A large group of near copies, many of them alike to few others only."""
    docs = near_copies(5, 1, 400)
    made = []
    met = trie_join._met

    def spy(rows, percent, columns, own):
        out = met(rows, percent, columns, own)
        made.append((out.count(), rows.count()))
        return out

    monkeypatch.setattr(trie_join, "_met", spy)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = trie_join.near_duplicates(df, few=2, block_sets=16)
    assert sorted(map(tuple, got.collect())) == brute(docs)
    assert made and all(links <= sent for links, sent in made)


def test_tables(spark, tables, odd_docs, odd_texts):
    docs = [(d["doc_id"], d["text"]) for d in tables["documents"]]
    assert sorted(map(tuple, trie_join.near_duplicates(spark.createDataFrame(tables["documents"])).collect())) == brute(docs)
    docs = [(k * 3 - 6, t) for k, t in enumerate(odd_texts)]
    want = brute(docs)
    assert sorted(map(tuple, trie_join.near_duplicates(odd_docs).collect())) == want
    kept = trie_join.one_of_each(odd_docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({x[2] for x in want}) and kept.schema == odd_docs.schema
    assert trie_join.near_duplicates(odd_docs.limit(0)).collect() == []


def test_trie_finds_all_and_only_similar_sets():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.choice(400, 150, replace=False)
        sets = []
        for _ in range(25):
            keep = base[rng.random(150) < rng.uniform(0.6, 1.0)]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 400, rng.integers(0, 30))])).astype(np.uint64))
        sets += [np.unique(base).astype(np.uint64), np.zeros(0, np.uint64), np.unique(base).astype(np.uint64)]
        probe = sets[rng.integers(0, 25)]
        want = [k for k, s in enumerate(sets) if (i := len(np.intersect1d(s, probe))) and 100 * i >= 75 * (len(s) + len(probe) - i)]
        assert sorted(trie_join.SetTrie(sets).similar(probe, 75, stride=int(rng.integers(1, 70)))) == want


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    sets = []
    for n in (1, 5, 60, 64, 65, 200, 700):
        base = rng.integers(0, 1 << 60, n).astype(np.uint64)
        for cut in (0.0, 0.1, 0.3, 0.6):
            keep = base[rng.random(n) >= cut]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, int(n * cut / 2)).astype(np.uint64)])))
    vectors = trie_join.parities(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    size = np.array([len(s) for s in sets])
    ruled_out = 0
    for i in range(len(sets)):
        ok = trie_join.may_link([vectors[i]] * len(sets), vectors, np.full(len(sets), size[i]), size, 75)
        for j, s in enumerate(sets):
            common = len(np.intersect1d(s, sets[i]))
            linked = common and 100 * common >= 75 * (len(s) + size[i] - common)
            assert ok[j] or not linked
            ruled_out += not ok[j]
    assert ruled_out > len(sets)
