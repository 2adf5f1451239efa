import hashlib
import random
import zlib

from pairforge.llm import branch_merge as bm


def code(branch, doc, name):
    return zlib.crc32(f"{branch}:{doc}:{name}".encode()) % 11


def brute(rows):
    """rows: (doc_id, lang, source, text); the contract written out, unit by unit."""
    out, adds = [], {}
    held = {r[0] for r in rows}
    for d, lang, source, text in rows:
        if d is None:
            continue
        lang, source, lines = lang or "", source or "", (text or "").split("\n")
        row = [code(b, d, "row") for b in "LR"]
        for k, b in enumerate("LR"):
            if row[k] in (3, 4):
                adds.setdefault(-1 - k - d, {}).setdefault(b, []).append(("!" if row[k] == 3 else "?", lang, source))
        clean = ee = ed = ii = 0
        values = []
        touched = [False, False]
        for name, was in (("lang", lang), ("source", source)):
            new = []
            for k, b in enumerate("LR"):
                c = code(b, d, name)
                new.append("" if c == 0 else was + "!" if c == 1 else was + "?" if c == 2 else was)
                touched[k] |= new[k] != was
            x, y = new
            if x != was and y != was and x != y:
                ee += 1
                values.append(was)
            else:
                clean += x != was or y != was
                values.append(x if x != was else y)
        merged = []
        for k, line in enumerate(lines):
            cs = [code(b, d, str(k)) for b in "LR"]
            touched = [t or c < 5 for t, c in zip(touched, cs, strict=True)]
            edits = {c for c in cs if c < 3}
            both = sum(c < 3 for c in cs) == 2
            if both and len(edits) == 2:
                ed, ee = ed + (0 in edits), ee + (0 not in edits)
                merged.append(line)
            elif edits:
                clean += 1
                merged += {0: [], 1: [line + "!"], 2: [line + "?"]}[edits.pop()]
            else:
                merged.append(line)
            gaps = {c for c in cs if c in (3, 4)}
            if len(gaps) == 2:
                ii += 1
            elif gaps:
                clean += 1
                merged.append("!" if gaps.pop() == 3 else "?")
        state = (*values, hashlib.sha256("\n".join(merged).encode()).hexdigest())
        base = (lang, source, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        if row[0] == 0 and row[1] == 0:
            out.append((d, None, None, None, 1, 0, 0, 0))
        elif 0 in row:
            lost = touched[1 if row[0] == 0 else 0]
            out.append((d, *base, 0, 0, 1, 0) if lost else (d, None, None, None, 1, 0, 0, 0))
        else:
            out.append((d, *state, clean, ee, ed, ii))
    for d, by in adds.items():
        if d in held:
            continue
        new = {min(x) for x in by.values()}
        if len(new) == 2:
            out.append((d, None, None, None, 0, 0, 0, 1))
        else:
            text, lang, source = new.pop()
            out.append((d, lang, source, hashlib.sha256(text.encode()).hexdigest(), 1, 0, 0, 0))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_report_against_the_contract(spark, tables):
    rows = [(d["doc_id"], d["lang"], d["source"], d["text"]) for d in tables["documents"]]
    assert got(bm.report(spark.createDataFrame(tables["documents"]))) == brute(rows)
    short = [(k, ["en", None][k % 2], ["", "s", None][k % 3], ["", None, "a", "a\nb", "\n"][k % 5]) for k in range(4000)]
    out = got(bm.report(spark.createDataFrame(short, "doc_id long, lang string, source string, text string")))
    assert out == brute(short)
    for k in range(4, 8):
        assert any(r[k] for r in out)
    assert any(r[1] is None and r[4] for r in out) and any(r[0] < 0 and r[7] for r in out) and any(r[0] < 0 and r[4] for r in out)


def test_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert got(bm.report(odd_docs)) == brute(rows)
    twice = odd_docs.union(odd_docs).union(odd_docs.selectExpr("cast(null as long)", *odd_docs.columns[1:]))
    want = brute(rows + rows)
    assert got(bm.report(twice)) == want
    assert bm.report(odd_docs.limit(0)).collect() == []


def random_ops(rng, n):
    ops, at = [], 0
    while True:
        if rng.random() < 0.3:
            m = rng.randint(1, 3)
            bm.put(ops, "insert", m, [rng.choice("pqr") for _ in range(m)])
        if at == n:
            return ops
        kind, m = rng.choice(["retain", "delete", "replace"]), min(n - at, rng.randint(1, 3))
        bm.put(ops, kind, m, [rng.choice("xyz") for _ in range(m)] if kind == "replace" else None)
        at += m


def test_both_orders_give_one_merge():
    rng = random.Random(5)
    for _ in range(3000):
        base = [rng.choice("abc") for _ in range(rng.randint(0, 7))]
        left, right = random_ops(rng, len(base)), random_ops(rng, len(base))
        after, counts = bm.transform(left, right, base)
        before, same = bm.transform(right, left, base)
        one = bm.apply(after, bm.apply(left, base))
        assert one == bm.apply(before, bm.apply(right, base)) and counts == same
        assert one == bm.apply(bm.compose(left, after, len(base)), base)
        assert bm.transform(left, [], base)[0] == [("retain", len(bm.apply(left, base)), None)] or not bm.apply(left, base)


def test_merge_of_given_operations(spark):
    row = lambda d, text, l_ops, r_ops, l_drop=False, **r: {"doc_id": d, "lang": None, "source": "s", "text": text, "left": {"dropped": l_drop, "lang": None, "source": None, "ops": l_ops}, "right": {"dropped": False, "lang": r.get("lang"), "source": None, "ops": r_ops}}
    op = lambda kind, n, lines=None: {"kind": kind, "n": n, "lines": lines}
    rows = spark.createDataFrame(
        [
            row(1, "a\nb\nc", [op("delete", 1)], [op("retain", 2), op("insert", 1, ["new"])], lang="en"),
            row(2, "a\nb", [op("replace", 1, ["x"])], [op("delete", 1), op("insert", 2, ["y", "z"])]),
            row(3, None, [], [], True), row(4, "t", [], [op("insert", 1, ["top"])], True),
        ],
        f"doc_id long, lang string, source string, text string, left {bm.BRANCH}, right {bm.BRANCH}",
    )
    out = {r.doc_id: tuple(r)[1:] for r in bm.merge_rows(rows).collect()}
    assert out == {1: ("en", "s", "b\nnew\nc", 3, 0, 0, 0), 2: ("", "s", "a\ny\nz\nb", 1, 0, 1, 0), 3: (None, None, None, 1, 0, 0, 0), 4: ("", "s", "t", 0, 0, 1, 0)}
