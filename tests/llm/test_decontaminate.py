import hashlib
import re

import numpy as np

from pairforge.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, width=13):
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        n = min(len(w), width)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    found |= x
        h = sum(hit)
        out.append((d, len(w), h, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), h > 0 and 20 * h >= len(w)))
    return sorted(out)


def test_report(spark, tables):
    docs, bench = spark.createDataFrame(tables["documents"]), spark.createDataFrame(tables["benchmark"])
    got = sorted(map(tuple, decontaminate.report(docs, bench).collect()))
    assert got == brute([(d["doc_id"], d["text"]) for d in tables["documents"]], [(b["item_id"], b["text"]) for b in tables["benchmark"]])
    assert any(r[5] for r in got)


def test_odd_rows_blocks_and_removal(spark, odd_docs, odd_texts):
    items = [(1, "One, two"), (10, "common3 COMMON4 common5 common6 common7 common8 common9 common10 common11 common12 common13 common14 common15 common16"), (2, None), (3, "?!"), (4, "one two"), (5, "w1é w2é w3é"), (9, "über"), (None, "one")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    docs = [(k * 3 - 6, t) for k, t in enumerate(odd_texts)]
    want = brute(docs, [x for x in items if x[0] is not None and x[1] is not None])
    assert sorted(map(tuple, decontaminate.report(odd_docs, bench).collect())) == want
    found = decontaminate.scan(odd_docs, bench, "f", most_bytes=20)
    got = sorted((r.doc_id, r.f.n_words, sum(s.hi - s.lo for s in r.f.spans), len(r.f.items)) for r in found.collect())
    assert got == [x[:4] for x in want]
    assert found.drop("f").schema == odd_docs.schema
    kept = decontaminate.without_contaminated(odd_docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [x[0] for x in want if not x[5]] and kept.schema == odd_docs.schema
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(odd_docs, bench).collect()}
    assert cut[12] == " three four five" and cut[-6] is None
    assert decontaminate.report(odd_docs.limit(0), bench).collect() == []
    assert all(r[2] == 0 for r in map(tuple, decontaminate.report(odd_docs, bench.limit(0)).collect()))


def test_every_window_of_one_hash_is_kept(spark, monkeypatch):
    """Windows that agree in their hash are told apart by their bytes."""
    monkeypatch.setattr(decontaminate, "window_hash", lambda values, n: np.zeros(max(len(values) - n + 1, 0), np.uint64))
    texts = [" ".join(f"{w}{k}" for k in range(13)) for w in ("alpha", "beta", "gamma", "beta")]
    items = decontaminate.Windows([1, 2, 3, 4], texts, 13)
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    at, hit, docs, found = items.hits(buf, offs)
    assert np.diff(at).tolist() == [13] * 4 and hit.all()
    assert sorted(zip(docs.tolist(), found.tolist(), strict=True)) == [(0, 1), (1, 2), (1, 4), (2, 3), (3, 2), (3, 4)]
