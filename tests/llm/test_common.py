import numpy as np
import pyarrow.fs as pafs
import pytest

from pairforge.llm import common


def test_publish_replaces_an_earlier_attempt(tmp_path):
    class Strict:
        """A store that does not move onto what is there."""

        def __init__(self):
            self.fs = pafs.LocalFileSystem()

        def move(self, a, b):
            if self.fs.get_file_info(b).type != pafs.FileType.NotFound:
                raise OSError("exists")
            self.fs.move(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    for fs in (pafs.LocalFileSystem(), Strict()):
        for text in ("one", "two"):
            (tmp_path / "mine").write_text(text)
            common.publish(fs, str(tmp_path / "mine"), str(tmp_path / "final"))
            assert (tmp_path / "final").read_text() == text
    with pytest.raises(OSError):
        common.publish(Strict(), str(tmp_path / "none"), str(tmp_path / "nowhere"))


def test_equal_content_hashes_alike_wherever_it_stands():
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 4, 3000).astype(np.uint8)
    buf[1000:1200] = buf[100:300]
    a, b = np.array([100, 1000, 5]), np.array([300, 1200, 5])
    h = common.byte_hash(buf, a, b)
    assert h[0] == h[1] != h[2]
    assert common.window_hash(common._byte_values()[buf], 50)[100] == common.window_hash(common._byte_values()[buf], 50)[1000]


def test_words_at_the_edges():
    texts = [b"", b"a", b" a b", b"ab ", b"\n", b"c"]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    _, starts, ends, at = common.words(buf, offs, common.SPACED, False)
    got = [[bytes(buf[s:e]) for s, e in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(at, at[1:], strict=False)]
    assert got == [t.split() for t in texts]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    assert {r.node: r.root for r in common.components(df, "a", "b").collect()} == {x: find(x) for x in root if find(x) != x}
    assert common.components(df.limit(0), "a", "b").collect() == []


def test_broadcasts_are_judged_by_what_the_rows_take_in_memory(spark):
    long = "x" * 100_000
    rows = [(k, long, [(1, long)], [k] * 50, None) for k in range(40)]
    df = common.written(spark.createDataFrame(rows, "k long, t string, l array<struct<a int, b string>>, n array<int>, z array<string>"), "same")
    assert common.written_bytes(df) < 100_000
    assert 8_000_000 <= common.held_bytes(df) <= 8_100_000
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString()
    assert hinted(common.small_side(df, 1 << 20))
    assert not hinted(common.small_side(df, 1 << 20, 1 << 20)) and not hinted(common.small_side(df, 10))
    assert common.held_bytes(df.where("k < 0")) == 0


def test_words_are_told_apart_by_a_key_that_each_run_draws(spark):
    """Words built to agree under a fixed chain of mixing steps; documents of one or the other neither link, nor repeat, nor lose hits."""
    from pairforge.llm import decontaminate, fm_index, trie_join

    one, two = "pwq1nw17rvaappda", "fr1b8c5g885a209g"
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in (one, two))
    ends = np.array([16])
    assert common.byte_hash(a, ends * 0, ends) == common.byte_hash(b, ends * 0, ends)
    own = lambda text: int(common.word_hash(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))[0])
    assert own(one.encode()) != own(two.encode())
    before = common._SECRET
    common.use_secret(b"another")
    changed = own(one.encode())
    common.use_secret(before)
    assert changed != own(one.encode())
    docs = spark.createDataFrame([(1, " ".join([one] * 31)), (2, " ".join([two] * 31)), (3, " ".join([one] * 13))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in trie_join.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    around = [f"x{k}" for k in range(30)]
    texts = [(k, " ".join([*around[:15], w, *around[15:]])) for k, w in enumerate((one, two, one))]
    assert {r.doc_id: r.n_removed for r in fm_index.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == {0: 0, 1: 0, 2: 31}
    items = spark.createDataFrame([(1, " ".join([one] * 13)), (2, " ".join([two] * 13))], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.report(docs, items).collect()} == {1: (31, 1), 2: (31, 1), 3: (13, 1)}


def test_words_of_any_length(spark):
    """Equal bytes agree wherever they stand; words that differ in one byte, in trailing zeros or in length do not."""
    rng = np.random.default_rng(0)
    for size in (1, 3, 4, 7, 8, 9, 16, 31, 32, 33, 511, 512, 513, 3000):
        word = rng.integers(0, 256, size).astype(np.uint8)
        others = [np.append(word, np.uint8(0)), word[:-1], np.where(np.arange(size) == size - 1, word ^ 1, word), np.where(np.arange(size) == 0, word ^ 128, word)]
        parts = [word, *others, word]
        ends = np.cumsum([len(x) for x in parts])
        h = common.word_hash(np.concatenate(parts), ends - [len(x) for x in parts], ends)
        assert h[0] == h[-1] and len({*h.tolist()}) == 5
    assert common.word_hash(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_workers_hash_as_the_driver_does(spark):
    import pyarrow as pa

    from pairforge.llm import common as mine

    own = lambda text: int(mine.word_hash(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))[0]) >> 1

    @common.lean
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([own(w.encode()) for w in batch.column(0).to_pylist()])], names=["h"])

    rows = spark.createDataFrame([(f"word{k}",) for k in range(50)], "w string").repartition(4)
    assert {r.h for r in rows.mapInArrow(run, "h long").collect()} == {own(b"word%d" % k) for k in range(50)}
