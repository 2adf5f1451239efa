import random
import re

import zstandard

from pairforge.llm import compression_rules as cr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    hit = {p + j for at in windows.values() if len(at) > 1 for p in at for j in range(3)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(hit), failed


def within(data):
    low, high = [b for b in cr.BANDS if len(data) >= b[0]][-1][1:]
    return low <= len(data) / len(zstandard.ZstdCompressor(level=cr.LEVEL).compress(data)) <= high


def kept(text):
    raw = (text or "").encode()
    chunks = [raw[k : k + cr.CHUNK] for k in range(0, len(raw), cr.CHUNK)]
    if len(chunks) > 1 and len(chunks[-1]) < cr.LEAST_CHUNK:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    bad = sum(not within(c) for c in chunks)
    return not counts(text)[5] and within(raw) and (bad == 0 or cr.SHARE * bad < len(chunks))


def check(docs, rows):
    got = {r.doc_id: tuple(r)[1:8] for r in cr.report(docs).collect()}
    assert got == {i: (*counts(t), kept(t)) for i, t in rows}
    return got


def prose(rng, n):
    names = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    return " ".join(rng.choice(names) for _ in range(n))


def test_documents(spark, tables):
    rows = [(d["doc_id"], d["text"]) for d in tables["documents"]]
    got = check(spark.createDataFrame(tables["documents"]), rows)
    good = [d["doc_id"] for d in tables["labels"] if d["quality"] == 1 and not got[d["doc_id"]][5]]
    assert good and all(got[i][6] for i in good)


def test_odd_texts_and_what_the_bands_reject(spark, odd_docs, odd_texts):
    check(odd_docs, [(k * 3 - 6, t) for k, t in enumerate(odd_texts)])
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(90))
    alike = " ".join(f"item {k} of the list is the same as item {k - 1} of the list" for k in range(600))
    long = prose(rng, 9000)
    rows = [(1, prose(rng, 60)), (2, prose(rng, 600)), (3, long), (4, noise), (5, alike), (6, long[:9000] + " " + noise + noise), (7, long + " " + noise)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert {i: r[6] for i, r in got.items()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True}


def test_filter_and_tables_of_no_rows(spark, odd_docs):
    docs = odd_docs.withColumn("found", odd_docs.start).withColumn("FOUND_", odd_docs.start)
    kept_ids = {r.doc_id for r in cr.report(docs).collect() if r.kept}
    out = cr.without_rejected(docs.union(docs))
    assert out.schema == docs.schema and sorted(r.doc_id for r in out.collect()) == sorted([*kept_ids, *kept_ids])
    assert cr.report(docs.limit(0)).collect() == [] and cr.without_rejected(docs.limit(0)).collect() == []
    none = docs.selectExpr("cast(null as long) doc_id", "text")
    assert cr.report(none).count() == docs.count()
