import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from pairforge.llm import fm_index, repeats, runlength_index


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_bytes(docs, window):
    seen = {}
    for d, t in docs:
        raw = (t or "").encode()
        for k in range(len(raw) - window + 1):
            seen[raw[k : k + window]] = seen.get(raw[k : k + window], 0) + 1
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        for k in range(len(raw) - window + 1):
            if seen[raw[k : k + window]] > 1:
                gone[k] += 1
                gone[k + window] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(raw), int(gone.sum()), edges, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def brute_words(docs, window):
    first = {}
    for d, t in sorted(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), (d, k))
    out = []
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] != (d, k):
                gone[k : k + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out)


def made_up(seed, n=60):
    """Texts with shared passages, near copies, exact copies and periodic stretches."""
    rng = random.Random(seed)
    vocab = ["a", "b", "the", "of", "é", "long" * 3, "x."]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(5, 90))) for _ in range(6)]
    out = []
    for k in range(n):
        parts = [" ".join(f"{rng.choice(vocab)}{rng.randint(0, 40)}" for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        if rng.random() < 0.2:
            parts.append("ing " * rng.randint(10, 120))
        out.append((k * 7 % n, " ".join(parts)))
    out += [(n + k, out[k % 5][1]) for k in range(12)]
    return out


def in_every_text(seed, n=150):
    """One passage in each text, between different words, and some texts of the passage alone."""
    rng = random.Random(seed)
    passage = " ".join(f"licence{k}" for k in range(60))
    some = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 30)))
    return [(k, passage if k % 9 == 0 else f"{some()} {passage} {some()}") for k in range(n)]


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n)), "".join("ba"[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("hot", [2, 2048])
def test_a_passage_in_every_text(spark, hot):
    docs = in_every_text(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(runlength_index.report(df, hot_runs=hot)) == brute_bytes(docs, 200)
    assert rows(fm_index.report(df, hot_runs=hot, shard_units=600)) == brute_words(docs, 20)


def test_texts_made_to_agree_under_polynomials(spark):
    a, b = thue_morse(1024)
    rng = random.Random(8)
    shared = "".join(rng.choices("cdefgh ", k=390))
    docs = [(1, a + shared), (2, b + shared + "tail"), (3, a), (4, b)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(runlength_index.report(df)) == brute_bytes(docs, 200)
    words = [f"q{k}" for k in range(40)]
    docs = [(k, " ".join([*words[:19], x, *words[20:]])) for k, x in enumerate((a, b))] + [(5, " ".join(words))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(fm_index.report(df)) == brute_words(docs, 20)


@pytest.mark.parametrize("options", [{}, {"hot_units": 1, "shard_units": 4096}])
def test_repeated_bytes(spark, odd_docs, odd_texts, tables, options):
    docs = made_up(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(runlength_index.report(df, **options)) == brute_bytes(docs, 200)
    assert rows(runlength_index.report(df, 40, gram=12, **options)) == brute_bytes(docs, 40)
    docs = [(k * 3 - 6, t) for k, t in enumerate(odd_texts) if not t or len(t) < 20000]
    assert rows(runlength_index.report(odd_docs.where("text is null or length(text) < 20000"), **options)) == brute_bytes(docs, 200)
    if not options:
        docs = [(d["doc_id"], d["text"]) for d in tables["documents"]]
        assert rows(runlength_index.report(spark.createDataFrame(tables["documents"]))) == brute_bytes(docs, 200)
        assert rows(runlength_index.report(odd_docs.limit(0))) == []


@pytest.mark.parametrize("options", [{}, {"hot_units": 1, "shard_units": 512}])
def test_repeated_words(spark, odd_docs, odd_texts, tables, options):
    docs = made_up(2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(fm_index.report(df, **options)) == brute_words(docs, 20)
    assert rows(fm_index.report(df, 6, **options)) == brute_words(docs, 6)
    docs = [(k * 3 - 6, t) for k, t in enumerate(odd_texts)]
    assert rows(fm_index.report(odd_docs, **options)) == brute_words(docs, 20)
    if not options:
        docs = [(d["doc_id"], d["text"]) for d in tables["documents"]]
        assert rows(fm_index.report(spark.createDataFrame(tables["documents"]))) == brute_words(docs, 20)
        assert rows(fm_index.report(odd_docs.limit(0))) == []


def test_a_long_text_in_stretches(spark, monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choices("abc ", k=700))
    long = "".join(rng.choices("klmnop ", k=9000))
    docs = [(1, long[:3000] + passage + long[3000:8000] + passage + long[8000:]), (2, "start" + passage), (3, long[100:420])]
    monkeypatch.setattr(repeats, "STRETCH", 1000)
    got = [x for part in repeats._stretches(np.frombuffer(docs[0][1].encode(), np.uint8), np.array([0, len(docs[0][1])]), 200) for x in [part]]
    assert len(got) > 5
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(runlength_index.report(df)) == brute_bytes(docs, 200)


def test_texts_without_repeats(spark, odd_docs, odd_texts):
    out = runlength_index.without_repeats(odd_docs)
    assert out.schema.names == odd_docs.schema.names
    got = {r.doc_id: r for r in out.collect()}
    want = {k * 3 - 6: t for k, t in enumerate(odd_texts)}
    assert got.keys() == want.keys() and got[-6].text is None and got[0].text == " "
    long = next(k for k, t in want.items() if t and len(t) > 50000)
    assert got[long].text == "" and got[long].n_chars == 0 and got[long].key == "clash"
    passage = next(k for k, t in want.items() if t and t.startswith("start "))
    assert got[passage].text.strip() in ("startend", "start end", "start  end", "startd", "star end")


def test_runs_cover_every_window():
    rng = np.random.default_rng(5)
    values = repeats.values_of(rng.integers(97, 100, 3000).astype(np.uint8))
    at = np.array([0, 0, 700, 705, 3000])
    for levels in (1, 3):
        key, first, n, _ = repeats.least_runs(values, at, 50, 8, levels)
        starts = sorted(k for f, c in zip(first, n, strict=True) for k in range(f, f + c))
        assert starts == [k for a, b in zip(at, at[1:], strict=False) for k in range(a, b - 49)]


def test_run_length_index_is_exact():
    text = b"banana bandana banana\xffbandana ban\xff"
    base, stop = np.array([0, 22]), np.array([21, 33])
    index = runlength_index.RunLengthIndex(np.frombuffer(text, np.uint8), base, stop)
    assert index.run_lengths.sum() == len(text) and len(index.runs) < len(text)
    got = index.matching_statistics(0, len(text))
    for p in range(len(text)):
        end = 21 if p <= 21 else 33
        best = max(k for k in range(end - p + 1) if k == 0 or any(text[q : q + k] == text[p : p + k] for q in range(len(text)) if q != p))
        assert got[p] == best, p


def matching_bodies(kind: str, n: int) -> tuple[list[bytes], np.ndarray]:
    rng = np.random.default_rng(3)
    letters = lambda k: rng.integers(97, 123, k, dtype=np.uint8).tobytes()
    if kind == "edges":  # one passage after different words
        passage = letters(250)
        return [letters(150) + passage for _ in range(n // 400)], np.ones(n // 400, np.int64)
    return {"random": ([letters(n)], np.array([1])), "copies": ([letters(300) for _ in range(n // 600)], np.full(n // 600, 2)), "period": ([b"ab" * (n // 2)], np.array([1]))}[kind]


@pytest.mark.parametrize("kind", ["random", "edges", "copies", "period"])
def test_an_index_takes_few_bytes_a_unit(kind):
    """It took 146 to 248 bytes a unit, so that two tasks with full shards held over half a gigabyte."""
    bodies, times = matching_bodies(kind, 1 << 19)
    runlength_index.mark(bodies, times)
    tracemalloc.start()
    who, lo, hi = runlength_index.mark(bodies, times)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * sum(len(b) * min(t, 2) for b, t in zip(bodies, times.tolist(), strict=True))
    want = {"random": 0, "period": 1}.get(kind, len(bodies))
    assert len(who) == want and (hi - lo >= 200).all()


@pytest.mark.parametrize("chunk", [1, 5, 1 << 16])
def test_an_index_in_chunks_is_exact(chunk, monkeypatch):
    monkeypatch.setattr(runlength_index, "CHUNK", chunk)
    test_run_length_index_is_exact()
    rng = np.random.default_rng(chunk)
    for _ in range(5):
        bodies = list({rng.integers(97, 99, k, dtype=np.uint8).tobytes() for k in rng.integers(1, 60, 12).tolist()})
        times = rng.integers(1, 3, len(bodies))
        got = {(b, p) for b, lo, hi in zip(*runlength_index.mark(bodies, times, 7), strict=True) for p in range(lo, hi)}
        places = Counter(x[p : p + 7] for x, t in zip(bodies, times.tolist(), strict=True) for _ in range(t) for p in range(len(x) - 6))
        assert got == {(b, q) for b, x in enumerate(bodies) for p in range(len(x) - 6) if places[x[p : p + 7]] > 1 for q in range(p, p + 7)}


def test_backward_search_counts():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([rng.integers(1, 6, 400), [0], rng.integers(1, 6, 300), [0]])
    matrix = fm_index.WaveletMatrix(symbols)
    for c in range(6):
        i = rng.integers(0, len(symbols) + 1, 50)
        assert matrix.rank(np.full(50, c), i).tolist() == [(symbols[:k] == c).sum() for k in i]
    index = fm_index.FMIndex(symbols, 5)
    for stream, k, length, lo in index.statistics(symbols, np.array([0, 401]), np.array([400, 300])):
        for s, p, n, a in zip(stream, k, length, lo, strict=True):
            p += (0, 401)[s]
            match = symbols[p : p + n].tolist()
            found = sorted(q for q in range(len(symbols)) if symbols[q : q + n].tolist() == match)
            if n == 5:
                g = index.group[a]
                assert sorted(index.order[index.edge[g] : index.edge[g + 1]].tolist()) == found
