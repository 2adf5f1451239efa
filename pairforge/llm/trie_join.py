"""Set-similarity join of documents by word n-grams in prefix trees.

Documents are sets of n-gram hashes in one global order: rare before frequent.  Two sets as similar as asked for share one of the first
tokens of both (prefix filter), so only prefixes are dealt out.  Copies of one set are taken once.  A token of few sets gives
all pairs of fitting sizes; a token of many gives a star around some of them first.  Candidates meet in tries of ordered sets that
a set walks down: paths share partial overlaps, and a subtree is left as soon as what remains cannot reach the needed overlap.
What the links so far leave apart within a token's sets is then joined block by block: a block holds a trie of its sets and a forest
of their components, and gives only verified links that join two of them, so it gives fewer links than it has rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import SPACED, components, lean, mix, ragged, run_hash, text_blocks, unused, words, written
from pairforge.llm.common import small_side as bounded_side

NGRAM, PERCENT = 5, 75
#: Tokens that the driver ranks and broadcasts: 4 MB at most.  Tasks report those that 3 of about 4 M tokens are, so any other makes up
#: less than one token in 2**18; any order gives the same result.
MOST_FREQUENT = 1 << 18
FEW = 8  # sets of a token that give all pairs at once
LEADERS = 4  # of more sets, so many are compared with all at first
BUCKET_TOKENS, GROUP_SETS = 1 << 20, 128
BLOCK_SETS = 256  # of a token's sets that a task holds while as many others of it pass by
BLOCK_SIZE = 1 << 20  # n-grams that these hold together, about
FREQUENT = np.uint64(1 << 63)
MET_SETS = 1 << 18  # sets that a task remembers to leave out their copies
HOT_SETS = 1 << 16  # a token met in more sets than this is dealt out in parts
BROADCAST_BYTES = HELD_BYTES = 16 << 20  # of files, of rows in memory: the driver holds several such tables at a time
FEATURES = "kind int, a long, n long, x long, y long, parity binary"
PREFIXES = "bucket int, docs binary, marks binary, marks2 binary, sizes binary, counts binary, tokens binary"
FOUND = "kind int, a long, b long, docs array<long>"


def small_side(df: DataFrame, limit: int) -> DataFrame:
    """df (from `written`), marked for a broadcast only within `limit` and HELD_BYTES."""
    return bounded_side(df, limit, HELD_BYTES)


def shingles(buf: np.ndarray, offs: np.ndarray, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, ascending, and the texts' offsets among them; fewer words are one n-gram."""
    hashes, _, _, at = words(buf, offs, SPACED, True)
    count = np.diff(at)
    per = np.where(count >= ngram, count - ngram + 1, (count > 0).astype(np.int64))
    start = ragged(at[:-1], per)
    doc = np.repeat(np.arange(len(count)), per)
    grams = run_hash(hashes, start, np.minimum(ngram, count)[doc])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(len(count) + 1))


def in_order(grams: np.ndarray, ptr: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The sets' tokens as numbers that ascend from rare to frequent, each set sorted: 63 bits of the hash, or the place among the frequent."""
    tokens = grams >> np.uint64(1)
    if len(common):
        k = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        tokens = np.where(common[k] == grams, FREQUENT | place[k], tokens)
    return tokens[np.lexsort((tokens, np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))))]


def marks_of(grams: np.ndarray, ptr: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set, as two numbers."""
    out = []
    for seed in (1, 2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams + np.uint64(seed)), dtype=np.uint64)])
        out.append((sums[ptr[1:]] - sums[ptr[:-1]]).view(np.int64))
    return out


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first tokens one must look at."""
    return np.where(n > 0, n - -(-n * percent // 100) + 1, 0)


def parities(grams: np.ndarray, ptr: np.ndarray) -> list[bytes]:
    """A bit vector of each set: bit k is the parity of how many elements hash to k; 2n to 4n bits for n elements.

    The bits in which two vectors differ are at most as many as the elements in which the sets differ, and folding a
    vector's halves together keeps that.
    """
    size = np.diff(ptr)
    bits = 1 << np.ceil(np.log2(np.maximum(2 * size, 256))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(bits)])
    spot = begin[:-1].repeat(size) + (mix(grams ^ np.uint64(0x5A5A)) & (bits - 1).astype(np.uint64).repeat(size)).astype(np.int64)
    odd = np.packbits((np.bincount(spot, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[a // 8 : b // 8] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def may_link(left: list[bytes], right: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """False for pairs whose vectors differ in more bits than sets of these sizes may differ in elements."""
    most = (100 - percent) * (n + m) // (100 + percent)
    out = np.ones(len(n), bool)
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    for x, y in {*zip(a.tolist(), b.tolist(), strict=True)}:
        k = np.flatnonzero((a == x) & (b == y))
        one, two = (np.frombuffer(b"".join(v[i] for i in k), np.uint64).reshape(len(k), -1) for v in (left, right))
        while one.shape[1] > two.shape[1]:
            one = one[:, : one.shape[1] // 2] ^ one[:, one.shape[1] // 2 :]
        while two.shape[1] > one.shape[1]:
            two = two[:, : two.shape[1] // 2] ^ two[:, two.shape[1] // 2 :]
        out[k] = np.bitwise_count(one ^ two).sum(1, dtype=np.int64) <= most[k]
    return out


def _features(docs: DataFrame, ngram: int) -> DataFrame:
    """kind 0: doc_id, set size and two marks of its set; kind 1: a token and how often it occurs, for tokens often met in a task."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def frequent() -> pa.RecordBatch:
            tokens, often = np.unique(np.concatenate(held), return_counts=True)
            keep = often >= 3
            zero = np.zeros(int(keep.sum()), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(zero.astype(np.int32) + 1), pa.array(tokens[keep].view(np.int64)), pa.array(often[keep]), pa.array(zero), pa.array(zero), pa.nulls(len(zero), pa.binary())], names=["kind", "a", "n", "x", "y", "parity"])

        for rows, buf, offs in text_blocks(batches, "text"):
            grams, ptr = shingles(buf, offs, ngram)
            marks = marks_of(grams, ptr)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows.num_rows, np.int32)), rows.column(0), pa.array(np.diff(ptr)), pa.array(marks[0]), pa.array(marks[1]), pa.array(parities(grams, ptr), pa.binary())], names=["kind", "a", "n", "x", "y", "parity"])
            held.append(grams)
            if sum(map(len, held)) >= 1 << 22:
                yield frequent()
                held = []
        if held:
            yield frequent()

    return docs.mapInArrow(scan, FEATURES)


def parts_of(tokens: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """In how many parts each token is dealt out; parts: of the frequent tokens, by place from 1."""
    out = np.ones(len(tokens), np.uint64)
    often = tokens >= FREQUENT
    out[often] = parts[(tokens[often] ^ FREQUENT).astype(np.int64) - 1]
    return out


def _prefixes(docs: DataFrame, ngram: int, percent: int, ranked: "object", buckets: int) -> DataFrame:
    """Prefix tokens, packed by bucket; those of very many sets in as many parts as keep each small.

    ranked: broadcast (frequent tokens ascending, their places in order of frequency, the number of parts by place).
    """

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place, parts = ranked.value
        met: set[tuple[int, int]] = set()
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            docs_k, marks, marks2, sizes, counts, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            owner = np.repeat(np.arange(len(docs_k)), counts)
            part = marks[owner].view(np.uint64) % parts_of(tokens, parts)
            bucket = (mix(tokens + mix(part)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tokens, owner, bucket = tokens[order], owner[order], bucket[order]
            present, first = np.unique(bucket, return_index=True)
            out = []
            for b, lo, hi in zip(present.tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
                who, per = np.unique(owner[lo:hi], return_counts=True)
                out.append((b, docs_k[who].tobytes(), marks[who].tobytes(), marks2[who].tobytes(), sizes[who].astype(np.int32).tobytes(), per.astype(np.int32).tobytes(), tokens[lo:hi].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 6], strict=True)], names=[x.split()[0] for x in PREFIXES.split(", ")])

        n = 0
        for rows, buf, offs in text_blocks(batches, "text"):
            grams, ptr = shingles(buf, offs, ngram)
            size = np.diff(ptr)
            mark, mark2 = marks_of(grams, ptr)
            names = list(zip(mark.tolist(), mark2.tolist(), strict=True))
            fresh = np.array([s > 0 and m not in met for m, s in zip(names, size.tolist(), strict=True)], bool)
            met.update(m for m, f in zip(names, fresh.tolist(), strict=True) if f)
            if len(met) > MET_SETS:
                met.clear()
            take = np.where(fresh, prefix_length(size, percent), 0)
            tokens = in_order(grams, ptr, common, place)[ragged(ptr[:-1], take)]
            if len(tokens):
                held.append((rows.column(0).to_numpy()[fresh], mark[fresh], mark2[fresh], size[fresh], take[fresh], tokens))
                n += len(tokens)
            if n >= 1 << 19:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(scan, PREFIXES)


def fitting_pairs(docs: np.ndarray, sizes: np.ndarray, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (smaller id first) in one group, sizes close enough.  group: ascending."""
    out = []
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    per = np.diff(edges)
    for gap in range(1, int(per.max(initial=1))):
        i = ragged(edges[:-1], np.maximum(per - gap, 0))
        j = i + gap
        ok = (np.minimum(sizes[i], sizes[j]) * 100 >= np.maximum(sizes[i], sizes[j]) * percent) & (docs[i] != docs[j])
        if ok.any():
            out.append(np.stack([np.minimum(docs[i[ok]], docs[j[ok]]), np.maximum(docs[i[ok]], docs[j[ok]])]))
    a, b = np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)
    return a, b


def _candidates(prefixes: DataFrame, percent: int, few: int, ranked: "object", partitions: int) -> DataFrame:
    """kind 0: pairs (a, b); kind 1: group a and some of its sets, for tokens of more than `few` sets and those dealt out in parts;
    kind 2: the first set b of a part of token a."""

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_l, marks_l, marks2_l, sizes_l, counts_l, tokens_l = [], [], [], [], [], []
        for batch in batches:
            for k in range(batch.num_rows):
                for into, c, t in ((docs_l, 1, np.int64), (marks_l, 2, np.int64), (marks2_l, 3, np.int64), (sizes_l, 4, np.int32), (counts_l, 5, np.int32), (tokens_l, 6, np.uint64)):
                    into.append(np.frombuffer(batch.column(c)[k].as_buffer(), t))
        if not docs_l:
            return
        docs, marks, marks2, sizes, counts, tokens = (np.concatenate(x) for x in (docs_l, marks_l, marks2_l, sizes_l, counts_l, tokens_l))
        parts = ranked.value[2]
        owner = np.repeat(np.arange(len(docs)), counts)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        same = tokens[1:] == tokens[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (parts_of(tokens, parts) > 1)
        tokens, owner = tokens[shared], owner[shared]
        d, m, m2, s = docs[owner], marks[owner], marks2[owner], sizes[owner].astype(np.int64)
        order = np.lexsort((d, m, tokens))  # copies of one set: the smallest id
        tokens, d, m, m2, s = tokens[order], d[order], m[order], m2[order], s[order]
        one = np.ones(len(tokens), bool)
        one[1:] = (tokens[1:] != tokens[:-1]) | (m[1:] != m[:-1]) | (m2[1:] != m2[:-1])
        tokens, d, s = tokens[one], d[one], s[one]
        if not len(tokens):
            return
        edges = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
        per = np.diff(edges)
        group = np.repeat(np.arange(len(per)), per)
        many = parts_of(tokens[edges[:-1]], parts) > 1
        wide = many | (per > few)
        small = ~wide[group]
        a, b = fitting_pairs(d[small], s[small], group[small], percent)
        # the least marks of the group: the same sets for many tokens
        stars = [np.stack([a, b])]
        for k in range(LEADERS):
            lead = np.minimum(edges[:-1] + k, edges[1:] - 1)[group]
            star = ~small & (np.arange(len(d)) > lead) & (np.minimum(s, s[lead]) * 100 >= np.maximum(s, s[lead]) * percent)
            stars.append(np.stack([np.minimum(d, d[lead])[star], np.maximum(d, d[lead])[star]]))
        a, b = np.unique(np.concatenate(stars, axis=1), axis=1)

        def batch_of(kind: int, a: np.ndarray, b: np.ndarray, lists: list | None = None) -> pa.RecordBatch:
            docs = pa.array(lists, pa.list_(pa.int64())) if lists else pa.nulls(len(a), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), docs], names=["kind", "a", "b", "docs"])

        for lo in range(0, len(a), 1 << 16):
            yield batch_of(0, a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)])
        heads = tokens[edges[:-1]].view(np.int64)
        if many.any():
            yield batch_of(2, heads[many], d[edges[:-1]][many])
        # groups of the very same sets tell the same pairs: one of them is enough
        seen = set()
        for g in np.flatnonzero(wide).tolist():
            ids = d[edges[g] : edges[g + 1]]
            name = int(heads[g]) if many[g] else int.from_bytes(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), "little", signed=True)
            if name not in seen or many[g]:
                seen.add(name)
                lists = [ids[k : k + 1024].tolist() for k in range(0, len(ids), 1024)]
                yield batch_of(1, np.full(len(lists), name), np.zeros(len(lists), np.int64), lists)

    return prefixes.repartition(partitions, "bucket").mapInArrow(meet, FOUND)


class SetTrie:
    """Ordered sets by shared beginnings: sets in lexicographic order, with how much each shares with the one before."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.sets = [sets[k] for k in self.order]
        self.shared = [0]
        for x, y in zip(self.sets, self.sets[1:], strict=False):
            n = min(len(x), len(y))
            differ = x[:n] != y[:n]
            self.shared.append(int(differ.argmax()) if differ.any() else n)

    def similar(self, probe: np.ndarray, percent: int, stride: int = 64, live: np.ndarray | None = None, found: Callable[[int], None] | None = None) -> list[int]:
        """Numbers of the sets with 100 * intersection >= percent * union.

        live: which sets to look at, asked as the walk reaches each; found: called with each result, and may change `live`.
        """
        out, n = [], len(probe)
        known: list[tuple[int, int]] = [(0, 0)]  # (depth, overlap up to it) along the path to the last set
        dead = None  # the depth at which the last set's path was left for good
        for k, x in enumerate(self.sets):
            depth = self.shared[k]
            if dead is not None and depth < dead[0]:
                dead = None
            while known[-1][0] > depth:
                known.pop()
            if dead is not None and len(x) >= dead[1]:
                continue  # in the subtree that was left: no shorter set, so no smaller need
            if live is not None and not live[self.order[k]]:
                continue
            at, overlap = known[-1]
            need = -(-percent * (len(x) + n) // (100 + percent))
            while at < len(x):
                step = min(at + stride, len(x)) if at >= depth else min(depth, at + stride)
                part = x[at:step]
                spot = np.searchsorted(probe, part)
                overlap += int((probe[np.minimum(spot, n - 1)] == part).sum()) if n else 0
                at = step
                known.append((at, overlap))
                beyond = n - int(np.searchsorted(probe, x[at - 1], "right"))
                if overlap + min(len(x) - at, beyond) < need:
                    # for sets that share this beginning and are no shorter, what is left of the probe bounds them as well
                    if dead is None and overlap + beyond < need:
                        dead = (at, len(x))
                    break
            else:
                if overlap and 100 * overlap >= percent * (len(x) + n - overlap):
                    out.append(self.order[k])
                    if found:
                        found(self.order[k])
        return out


def _verified(docs: DataFrame, pairs: DataFrame, ngram: int, percent: int, group_sets: int, ranked: "object") -> DataFrame:
    """(a, b) of `pairs` that are similar.  A set's candidates travel to it, at most about `group_sets` of them together."""
    many = small_side(written(pairs.groupBy("a").agg(F.count("*").alias("c")).where(F.col("c") > group_sets), "many"), BROADCAST_BYTES)
    dealt = pairs.join(many, "a", "left").select("a", "b", F.when(F.col("c").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / group_sets))).alias("block"))
    needed = dealt.select("a", "block", F.col("b").alias("doc_id")).union(dealt.select("a", "block", F.col("a").alias("doc_id")).distinct())
    texts = docs.select("doc_id", "text").join(needed.hint("shuffle_hash"), "doc_id").select("a", "block", "doc_id", "text")

    @lean
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, n = None, [], [], 0

        def links() -> Iterator[tuple[int, int]]:
            rest = [k for k, i in enumerate(ids) if i != now[0]]
            probes = [x for x, i in zip(sets, ids, strict=True) if i == now[0]]  # several only where rows repeat an id
            if probes and rest:
                trie = SetTrie([sets[r] for r in rest])
                for x in probes:
                    yield from ((now[0], ids[rest[k]]) for k in trie.similar(x, percent))

        out: list[tuple[int, int]] = []
        for rows, buf, offs in text_blocks(batches, "text"):
            grams, ptr = shingles(buf, offs, ngram)
            grams = in_order(grams, ptr, *ranked.value[:2])
            owners, blocks, docs_k = (rows.column(c).to_pylist() for c in range(3))
            for k, key in enumerate(zip(owners, blocks, strict=True)):
                if key != now:
                    out += links()
                    now, ids, sets = key, [], []
                ids.append(docs_k[k])
                sets.append(grams[ptr[k] : ptr[k + 1]].copy())
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["a", "b"])
                out = []
        out += links()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["a", "b"])

    return texts.repartition("a", "block").sortWithinPartitions("a", "block").mapInArrow(walk, "a long, b long")


def _close(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity vectors do not rule a link out."""
    mine = sets.select("doc_id", "n", "parity")
    both = pairs.join(mine.toDF("a", "n", "p"), "a").join(mine.toDF("b", "m", "q"), "b").select("a", "b", "n", "m", "p", "q")

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                ok = may_link(part.column(4).to_pylist(), part.column(5).to_pylist(), part.column(2).to_numpy(), part.column(3).to_numpy(), percent)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(keep, "a long, b long")


class Block:
    """Some of a group's sets: their parities as matrices, the component of each as far as it is known, and, if they are at hand, their trie."""

    def __init__(self, parts: list[tuple], percent: int) -> None:
        self.node, self.size, self.root = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
        self.bits, self.percent = [v for p in parts for v in p[3]], percent
        self.label = self.root.copy()
        by: dict[int, list[int]] = {}
        for k, v in enumerate(self.bits):
            by.setdefault(len(v), []).append(k)
        self.parity = [(np.array(ks), np.frombuffer(b"".join(self.bits[k] for k in ks), np.uint64).reshape(len(ks), -1)) for ks in by.values()]
        self.sets = [np.frombuffer(v, np.uint64) for p in parts for v in p[4]] if len(parts[0]) > 4 else None
        self.trie = SetTrie(self.sets) if self.sets else None
        self.merged: dict[int, int] = {}
        self.cluster = np.arange(len(self.node))

    def own(self) -> Iterator[tuple[int, int]]:
        """The block's sets asked for each other; those of its largest component wait for the others."""
        labels, count = np.unique(self.label, return_counts=True)
        for k in np.flatnonzero(self.label != labels[count.argmax()]).tolist():
            yield from self.ask(int(self.node[k]), int(self.size[k]), int(self.label[k]), self.bits[k], self.sets[k] if self.sets else None)

    def ask(self, node: int, size: int, label: int, parity: bytes, tokens: np.ndarray | None) -> Iterator[tuple[int, int]]:
        """Verified links from the set, one to each component that is not its own; they become one.

        Without tokens: pairs that sizes and parities let be linked, one to each cluster of such pairs; those become one cluster.
        """
        while label in self.merged:
            label = self.merged[label]
        live = (self.root != label) & (np.minimum(self.size, size) * 100 >= np.maximum(self.size, size) * self.percent)
        if not live.any():
            return
        one = np.frombuffer(parity, np.uint64)[None]
        for ks, two in self.parity:
            if not live[ks].any():
                continue
            mine = one
            while mine.shape[1] > two.shape[1]:
                mine = mine[:, : mine.shape[1] // 2] ^ mine[:, mine.shape[1] // 2 :]
            while two.shape[1] > mine.shape[1]:
                two = two[:, : two.shape[1] // 2] ^ two[:, two.shape[1] // 2 :]
            live[ks] &= np.bitwise_count(mine ^ two).sum(1, dtype=np.int64) <= (100 - self.percent) * (self.size[ks] + size) // (100 + self.percent)
        if not live.any():
            return
        if self.trie is None:
            at = np.flatnonzero(live)
            clusters, first = np.unique(self.cluster[at], return_index=True)
            yield from ((node, int(self.node[k])) for k in at[first].tolist())
            if len(clusters) > 1:
                self.cluster[np.isin(self.cluster, clusters)] = clusters[0]
            return
        links: list[tuple[int, int]] = []

        def found(k: int) -> None:
            links.append((node, int(self.node[k])))
            old = int(self.root[k])
            self.merged[old] = label
            self.root[self.root == old] = label
            live[self.root == label] = False

        self.trie.similar(tokens, self.percent, live=live, found=found)
        yield from links


def _met(rows: DataFrame, percent: int, columns: list[str], own: bool) -> DataFrame:
    """Pairs (a, b) from `Block`: verified links if there are tokens, else pairs that may be.  rows: g, block, chunk, side and `columns`;
    the sets of side 0 are held, and with `own` asked for each other; those of side 1 pass by."""

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, parts = None, None, []

        def held() -> Iterator[tuple[int, int]]:
            nonlocal block
            if parts and block is None:
                block = Block(parts, percent)
                if own:
                    yield from block.own()

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs, strict=True)], names=["a", "b"])

        for batch in batches:
            g, blk, chunk, side, node, s, label = (batch.column(k).to_numpy() for k in range(7))
            lists = [batch.column(k).to_pylist() for k in range(7, batch.num_columns)]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (blk[1:] != blk[:-1]) | (chunk[1:] != chunk[:-1]) | (side[1:] != side[:-1])
            edges = np.flatnonzero(new).tolist()
            out: list[tuple[int, int]] = []
            for lo, hi in zip(edges, [*edges[1:], len(g)], strict=True):
                if (key := (g[lo], blk[lo], chunk[lo])) != now:
                    out += held()
                    now, block, parts = key, None, []
                if side[lo] == 0:
                    parts.append((node[lo:hi], s[lo:hi], label[lo:hi], *(x[lo:hi] for x in lists)))
                    continue
                out += held()
                if block is not None:
                    for k in range(lo, hi):
                        out += block.ask(int(node[k]), int(s[k]), int(label[k]), lists[0][k], np.frombuffer(lists[1][k], np.uint64) if len(lists) > 1 else None)
            if out:
                yield batch_of(out)
        if out := list(held()):
            yield batch_of(out)

    by = ["g", "block", "chunk"]
    return rows.select(*by, "side", *columns).repartition(*by).sortWithinPartitions(*by, "side").mapInArrow(meet, "a long, b long")


def _mixed(groups: DataFrame, roots: DataFrame) -> tuple[DataFrame, bool]:
    """(g, node, label, main) of the groups whose sets lie in several components, main being the largest; whether there are any."""
    spread = written(groups.join(small_side(roots, BROADCAST_BYTES), "node", "left").select("g", "node", F.coalesce("root", "node").alias("label")), "groups")
    mixed = spread.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    mixed = written(mixed.drop("labels"), "mixed")
    return spread.join(small_side(mixed, BROADCAST_BYTES), "g"), mixed.limit(1).count() > 0


def _ordered(docs: DataFrame, nodes: DataFrame, ngram: int, ranked: "object") -> DataFrame:
    """(node, tokens) of the sets of `nodes`."""

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_blocks(batches, "text"):
            grams, ptr = shingles(buf, offs, ngram)
            tokens = in_order(grams, ptr, *ranked.value[:2])
            sets = [tokens[a:b].tobytes() for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sets, pa.binary())], names=["node", "tokens"])

    some = docs.join(small_side(written(nodes.select(F.col("node").alias("doc_id")).distinct(), "nodes"), BROADCAST_BYTES), "doc_id", "left_semi").select("doc_id", "text")
    return small_side(written(some.mapInArrow(scan, "node long, tokens binary"), "tokens"), BROADCAST_BYTES)


def _dealt(rows: DataFrame, block_sets: int) -> DataFrame:
    """rows (g, node, label, main, s, ...) in blocks of their group of about `block_sets` sets and at most some n-grams."""
    rows = written(rows, "rows")
    sized = rows.groupBy("g").agg(F.count("*").alias("m"), F.sum("s").alias("all"), F.count_if(F.col("label") != F.col("main")).alias("odd"))
    blocks = sized.select("g", F.ceil(F.greatest(F.col("m") / block_sets, F.col("all") / BLOCK_SIZE)).cast("int").alias("blocks"), F.ceil(F.col("odd") / block_sets).cast("int").alias("chunks"))
    rows = rows.join(small_side(written(blocks, "blocks"), BROADCAST_BYTES), "g")
    return rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("chunk", F.lit(0)).withColumn("side", F.lit(0))


def _passing(dealt: DataFrame) -> DataFrame:
    """The rows that a pass over all blocks needs: those outside their group's largest component, in chunks, by each block."""
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    odd = dealt.where("label <> main").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")).withColumn("side", F.lit(1)).withColumn("block", upto("blocks"))
    return dealt.withColumn("chunk", upto("chunks")).union(odd)


SKETCH = ["node", "s", "label", "parity"]


def _sketched(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """rows (g, node, label, main) with s and parity of their sets.  The sketch is the wide side and holds a row for nearly each document: it stays where it
    lies, and the rows go to it, or both are shuffled."""
    return sketch.join(small_side(written(rows, "narrow"), BROADCAST_BYTES), "node")


def _joined_within(docs: DataFrame, sets: DataFrame, groups: DataFrame, links: DataFrame, ngram: int, percent: int, block_sets: int, ranked: "object") -> DataFrame:
    """`links` with those that join what they leave apart within a token's sets.  groups: (g, node), distinct.

    First each set meets a block of one of its groups, that of least hash, which near copies choose alike; then, in groups that are
    mixed still, the sets outside the largest component pass by all blocks.  Sizes and parities alone say what may be linked; these
    pairs make clusters, and each set travels once, to a block of its cluster, to be verified there.
    """
    roots = components(links, "a", "b")
    nodes = written(groups.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    sketch = written(sets.join(small_side(nodes, BROADCAST_BYTES), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), F.col("n").alias("s"), "parity"), "sketch")

    def joined(rows: DataFrame, own: bool) -> None:
        nonlocal links, roots
        new = written(_met(rows.join(tokens, "node"), percent, [*SKETCH, "tokens"], own), "joins")
        if new.limit(1).count():
            links = links.union(new)
            roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(new), "a", "b")

    for all_groups in (False, True):
        mixed, some = _mixed(groups, roots)
        if not some:
            break
        if not all_groups:
            mixed = mixed.groupBy("node").agg(F.min_by(F.struct("g", "label", "main"), F.struct(F.xxhash64("g"), "g")).alias("x")).select("x.g", "node", "x.label", "x.main")
        dealt = _dealt(_sketched(mixed, sketch), block_sets)
        near = written(_met(_passing(dealt) if all_groups else dealt, percent, SKETCH, not all_groups), "near")
        if not near.limit(1).count():
            continue
        found = components(near, "a", "b").select(F.col("root").alias("g"), "node")
        clusters = written(found.union(found.select("g", F.col("g").alias("node")).distinct()), "clusters")
        tokens = _ordered(docs, clusters, ngram, ranked)
        dealt = _dealt(_sketched(_mixed(clusters, roots)[0], sketch), block_sets)
        joined(dealt, True)
        if dealt.where("blocks > 1").limit(1).count():
            joined(_passing(_dealt(_sketched(_mixed(clusters, roots)[0], sketch), block_sets)), False)
    return links


def near_duplicates(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, few: int = FEW, bucket_tokens: int = BUCKET_TOKENS, group_sets: int = GROUP_SETS, most_frequent: int = MOST_FREQUENT, block_sets: int = BLOCK_SETS, hot_sets: int = HOT_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id): the set's size and the smallest doc_id reachable over links.

    Documents are linked when 100 * intersection >= percent * union of their sets of lower-cased word n-grams; fewer words
    than n are one n-gram; null texts and texts without words have empty sets and no links.  No link between different
    sets is lost, except such as join two documents of one component already.  Rows with a null id are left out; rows that
    repeat an id give a row each, with that id's component; other columns are ignored; an empty table gives none.  N-grams and sets are compared by hashes of 64 and 128 bits.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    features = written(_features(docs, ngram), "sets")
    sets = features.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "x", "y", "parity")
    often = features.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(most_frequent).orderBy("n", "a").toArrow()
    frequent = often.column("a").to_numpy().view(np.uint64)
    by = np.argsort(frequent)
    parts = -(-often.column("n").to_numpy() // hot_sets)
    ranked = spark.sparkContext.broadcast((frequent[by], by.astype(np.uint64) + np.uint64(1), parts.astype(np.uint64)))
    tokens = int((sets.agg(F.sum("n")).first()[0] or 0) * (100 - percent) / 100)
    partitions = max(4, math.ceil(tokens / bucket_tokens))
    found = written(_candidates(_prefixes(docs, ngram, percent, ranked, 4 * partitions), percent, few, ranked, partitions), "candidates")
    # the parts of one token meet through their first sets
    firsts = found.where("kind = 2").select(F.col("a").alias("token"), "b").distinct()
    joints = firsts.join(firsts.groupBy("token").agg(F.min("b").alias("a")), "token").where("a < b").select("a", "b")
    pairs = found.where("kind = 0").select("a", "b").union(joints).distinct()
    pairs = written(_close(pairs, sets, percent), "pairs")
    links = written(_verified(docs, pairs, ngram, percent, group_sets, ranked), "links")
    groups = found.where("kind = 1").select(F.col("a").alias("g"), F.explode("docs").alias("node"))
    if groups.limit(1).count():
        links = _joined_within(docs, sets, written(groups.distinct(), "hot-groups"), links, ngram, percent, block_sets, ranked)
    groups = sets.where("n > 0").groupBy("n", "x", "y").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = small_side(written(groups, "copies"), BROADCAST_BYTES)  # written, so that the join's skew can be split beyond that
    copies = sets.join(groups, ["n", "x", "y"]).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    roots = components(links.union(copies), "a", "b").withColumnRenamed("node", "doc_id")
    return sets.join(roots, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest doc_id of their component, unchanged, and the rows with a null id.

    Null and empty texts are components of their own and stay, as do all rows of an id that stays; other columns pass, whatever
    their names; an empty table gives none.
    """
    (name,) = unused(docs, "gone")
    gone = written(near_duplicates(docs, ngram, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(name)), "gone")
    return docs.join(small_side(gone, BROADCAST_BYTES), F.col("doc_id").cast("long") == F.col(name), "left_anti")
