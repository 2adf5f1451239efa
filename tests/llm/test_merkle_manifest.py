import hashlib
import zlib

import pytest

from pairforge.llm import merkle_manifest as mm


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """All levels, and each node's siblings from the bottom up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[k : k + 8]) for k in range(0, len(last), 8)])
    paths = []
    for k in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            lo = k // 8 * 8
            path.append((k - lo, level[lo:k] + level[k + 1 : lo + 8]))
            k //= 8
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf_of(r[0], r[3], r[2], r[4], r[1]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for g in langs:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        subs[g] = tree([x[1] for x in groups[g]])
    root, tops = tree([subs[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for (i, leaf, r), path in zip(groups[g], subs[g][1], strict=True):
            path = path + top
            text, node = r[1], leaf
            if i is not None and text is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                node = leaf_of(i, r[3], g, r[4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
            for place, siblings in path:
                node = h(*siblings[:place], node, *siblings[place:])
            out.append((i, leaf, subs[g][0], root, h(*(s for _, x in path for s in x)), node, node == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 513, 700])
@pytest.mark.parametrize("step", [1, 2, 3])
def test_traversal_gives_every_path(n, step):
    nodes = [hashlib.sha256(b"%d" % k).digest() for k in range(n)]
    root, paths = tree([x.hex() for x in nodes])
    levels = mm.height(n)
    mine = list(mm.Traversal(nodes, levels, step))
    assert [[(p, s.hex()) for p, s in path] for path in mine] == [[(p, "".join(s)) for p, s in path] for path in paths]
    assert {mm.folded(x, p).hex() for x, p in zip(nodes, mine, strict=True)} == {root}


def test_traversal_holds_few_nodes():
    nodes = [bytes([k % 256]) * 32 for k in range(8**4)]
    walk = mm.Traversal(nodes, 4, 2)
    most = 0
    for _ in walk:
        held = sum(len(x) for t in (*walk.existing, *walk.desired) for x in (*t.kept, *t.runs))
        most = max(most, held)
    assert most <= 2 * 2 * (8**2 + 8) + 4 * 8 < len(nodes) // 8


def test_report_against_brute_force(spark, tables):
    rows = [(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"]) for d in tables["documents"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = got(mm.report(docs))
    assert out == brute(rows) and {r[-1] for r in out} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_small_blocks_and_many_languages(spark, monkeypatch, levels):
    monkeypatch.setattr(mm, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(mm, "BLOCK", 8**levels)
    rows = [(k, f"Text {k}", None if k % 7 == 0 else "en" if k % 3 else f"l{k % 101}é", None, k) for k in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert got(mm.report(docs)) == brute(rows)


def test_odd_rows(spark, odd_docs):
    ids = odd_docs.selectExpr("if(doc_id = 0, null, doc_id) doc_id", "text", "lang", "source", "n_chars", "key", "start", "length")
    twice = ids.union(ids)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in twice.collect()]
    assert got(mm.report(twice)) == brute(rows)
    assert mm.report(ids.limit(0)).collect() == []
    one = ids.where("doc_id = 3")
    assert got(mm.report(one)) == brute([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in one.collect()])
