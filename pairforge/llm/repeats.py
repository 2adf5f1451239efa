"""Finding the places where long exact repeats can lie, and dealing them to index shards.

Every window of `window` units (bytes or words) has a least gram hash.  Equal windows have equal least hashes, so windows are
routed by them: a maximal run of window starts with one least hash is cut out as one segment, and only segments
whose hash turns up twice in the corpus travel at all.  A shard then holds every copy of each window that it holds, whatever
the corpus size, and is indexed on its own.  Copies of whole texts are taken once (the smallest doc_id).  A hash with
very many segments is split further by two more independent least hashes of the same windows, and segments with one content
are taken once: a task passes on the first few of them, and a shard keeps only the one with the least place.  All others
lie wholly in windows that occur elsewhere, and earlier, so they are marked as they pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import BLOCK_BYTES, SPACED, _byte_values, digests, lean, mix, ragged, small_side, text_blocks, window_hash, within, words, written

Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
RUNS = "key long, copy long, copy2 long, start int, doc_id long, n int, seen int"
SEGMENTS = "shard long, key long, doc_id long, start int, size int, body binary"
SPANS = "doc_id long, lo int, hi int"
BROADCAST_BYTES = 16 << 20
STRETCH = 1 << 21  # units of a long text that are looked at together
#: Keys that one row of SHARE (by hash of the id) lets expect in HOT_RUNS runs or more are dealt out over SALTS tasks; at most MOST_HOT of
#: them, so a key that is not dealt out holds at most one run in MOST_HOT or has fewer than HOT_RUNS.  This moves rows and changes no result.
SHARE, HOT_RUNS, SALTS, MOST_HOT = 8, 2048, 256, 1 << 17


def byte_units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return buf, offs


def values_of(raw: np.ndarray) -> np.ndarray:
    return _byte_values()[raw] if raw.dtype == np.uint8 else raw


def word_units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, _, _, at = words(buf, offs, SPACED, False)
    return hashes, at


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over every run of `width` values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def least_runs(values: np.ndarray, at: np.ndarray, window: int, gram: int, levels: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window start, number of windows, times the least gram occurs, 2 for more) of each run of equal keys.

    levels > 1 joins the least hashes under so many hash families into the key; times are then all 1.
    """
    n, m = len(values) - window + 1, window - gram + 1
    none = np.zeros(0, np.int64)
    if n <= 0 or not (ok := within(at, window, len(values))).any():
        return none.astype(np.uint64), none, none, none
    grams = window_hash(values, gram)
    least = key = sliding(grams, m, np.minimum)
    for level in range(1, levels):
        key = mix(key + np.uint64(level)) ^ sliding(mix(grams ^ np.uint64(0x9E37 << (8 * level))), m, np.minimum)
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    end = np.zeros(n, bool)
    end[:-1] = ok[:-1] & (~ok[1:] | (key[1:] != key[:-1]))
    end[-1] = ok[-1]
    count = np.flatnonzero(end) + 1 - first
    times = np.ones(len(first), np.int64)
    if levels == 1:
        pad = np.zeros(m - 1, np.uint64)
        over = sliding(np.concatenate([pad, np.where(ok, least, np.uint64(0)), pad]), m, np.maximum)
        spots = np.flatnonzero(grams == over)
        lo, hi = np.searchsorted(spots, first), np.searchsorted(spots, first + count + m - 1)
        run = np.repeat(np.arange(len(first)), hi - lo)
        same = grams[spots[ragged(lo, hi - lo)]] == key[first][run]
        times = np.clip(np.bincount(run[same], minlength=len(first)), 1, 2)
    return key[first], first, count, times


def _stretches(raw: np.ndarray, at: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(values, offsets, where they begin): all units of a block, or one long text in stretches that overlap by a window less one."""
    if len(raw) <= 2 * STRETCH or len(at) != 2:
        yield values_of(raw), at, 0
        return
    for lo in range(0, len(raw), STRETCH):
        part = raw[lo : lo + STRETCH + window - 1]
        if len(part) >= window:
            yield values_of(part), np.array([0, len(part)]), lo


def _segments(docs: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """Runs of every text, copies of one text in a task put together."""

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            key, copy, copy2, start, doc, count, times = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((doc, start, copy2, copy, key))
            same = np.zeros(len(order), bool)
            same[1:] = (key[order][1:] == key[order][:-1]) & (copy[order][1:] == copy[order][:-1]) & (copy2[order][1:] == copy2[order][:-1]) & (start[order][1:] == start[order][:-1])
            o = order[~same]
            cols = [key[o].view(np.int64), copy[o], copy2[o], start[o].astype(np.int32), doc[o], count[o].astype(np.int32), times[o].astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "copy", "copy2", "start", "doc_id", "n", "seen"])

        for rows, buf, offs in text_blocks(batches, "text"):
            raw, at = units(buf, offs)
            copy = digests(buf, offs)
            ids = rows.column(0).to_numpy()
            for values, here, lo in _stretches(raw, at, window):
                key, first, count, times = least_runs(values, here, window, gram)
                doc = np.searchsorted(here, first, "right") - 1
                held.append([key, copy[doc, 0], copy[doc, 1], first - here[doc] + lo, ids[doc], count, times])
                n += len(key)
                if n >= 1 << 18:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(find, RUNS)


def _hot_keys(docs: DataFrame, units: Units, window: int, gram: int, hot_runs: int) -> DataFrame:
    """Keys of very many runs, told from one row in SHARE: tasks count the keys of each 2**18 runs and report those met twice."""

    @lean
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, often = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys[often > 1].view(np.int64)), pa.array(often[often > 1])], names=["key", "c"])

        for _, buf, offs in text_blocks(batches, "text"):
            raw, at = units(buf, offs)
            for values, here, _ in _stretches(raw, at, window):
                held.append(least_runs(values, here, window, gram)[0])
                if sum(map(len, held)) >= 1 << 18:
                    yield flush()
                    held = []
        if held:
            yield flush()

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0).select("text").mapInArrow(find, "key long, c long")
    counted = some.groupBy("key").agg(F.sum("c").alias("c")).where(F.col("c") >= max(2, hot_runs // SHARE))
    return written(counted.orderBy(F.desc("c"), "key").limit(MOST_HOT).select("key", F.lit(True).alias("many")), "hot-keys")


def spans(docs: DataFrame, units: Units, window: int, gram: int, index: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], unit_bytes: int, shard_units: int, hot_units: int, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, lo, hi): unit ranges that `index` marks.  docs: doc_id (distinct) and text.

    index(bodies, times, doc_id and start of each) -> (body, lo, hi) ranges, counted from the body's start, for the least place of
    each distinct body; times says whether it occurs once (1) or more (2).  Of texts that occur several times only the smallest
    doc_id's is indexed and marked.
    """
    known = F.broadcast(_hot_keys(docs, units, window, gram, hot_runs))  # at most MOST_HOT rows
    runs = _segments(docs, units, window, gram).join(known, "key", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    runs = runs.withColumn("salt", F.when(F.col("many"), F.pmod(F.xxhash64("copy", "start"), F.lit(SALTS))).otherwise(0)).repartition("key", "salt")
    once = runs.groupBy("key", "salt", "copy", "copy2", "start").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("seen").alias("seen"), F.first("many").alias("many"))
    same = Window.partitionBy("key", "salt")
    totals = once.withColumn("all", F.sum("seen").over(same)).withColumn("units", F.sum(F.col("n") + (window - 1)).over(same))
    twice = totals.where("many or all > 1").withColumn("hot", F.col("many") | (F.col("units") > hot_units))
    places = twice.select("doc_id", F.struct("start", "n", "key", "hot").alias("place"), (F.col("n") + (window - 1)).alias("u"))
    places = written(places.groupBy("doc_id").agg(F.collect_list("place").alias("places"), F.sum("u").alias("units")), "places")
    total = places.agg(F.sum("units")).first()[0] or 0
    shards = max(1, -(-total // shard_units))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, list] = {}  # a hot body: how often it was passed on, and the least place of those
        names = [x.split()[0] for x in SEGMENTS.split(", ")]

        def batch_of(raw: np.ndarray, hot: np.ndarray, key: np.ndarray, ids: np.ndarray, start: np.ndarray, begin: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            size = (n + window - 1) * raw.itemsize
            data = np.ascontiguousarray(raw[ragged(begin, n + window - 1)])
            ends = np.cumsum(size)
            keep = np.ones(len(key), bool)
            view = memoryview(data).cast("B") if len(data) else memoryview(b"")
            for k in np.flatnonzero(hot).tolist():
                name = hashlib.blake2b(view[ends[k] - size[k] : ends[k]], digest_size=16).digest()
                place = (int(ids[k]), int(start[k]))
                if (was := met.get(name)) is None:
                    if len(met) >= 1 << 16:
                        met.clear()
                    met[name] = [1, place]
                elif was[0] < 2 or place <= was[1]:
                    was[:] = [2, min(was[1], place)]
                else:
                    keep[k] = False
            offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
            bodies = pa.Array.from_buffers(pa.binary(), len(key), [None, offsets, pa.py_buffer(data)])
            shard = (mix(np.where(keep, key.view(np.uint64), ids.view(np.uint64))) % np.uint64(shards)).astype(np.int64)
            bodies = bodies if keep.all() else pc.if_else(pa.array(keep), bodies, pa.scalar(None, pa.binary()))
            cols = [pa.array(shard), pa.array(key), pa.array(ids), pa.array(start.astype(np.int32)), pa.array((n + window - 1).astype(np.int32)), bodies]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for rows, buf, offs in text_blocks(batches, "text"):
            raw, at = units(buf, offs)
            lists = rows.column(2)
            ptr, flat = np.asarray(lists.offsets), lists.values
            start, n, key, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            ptr = ptr.astype(np.int64)
            sel = slice(int(ptr[0]), int(ptr[-1]))
            doc = np.repeat(np.arange(rows.num_rows), np.diff(ptr))
            start, n, key, hot = start[sel].astype(np.int64), n[sel].astype(np.int64), key[sel], hot[sel]
            inside = start + n + window - 1 <= np.diff(at)[doc]  # all, but where an id has several texts
            doc, start, n, key, hot = doc[inside], start[inside], n[inside], key[inside], hot[inside]
            begin = at[doc] + start
            out_key, out_doc, out_begin, out_n = [key[~hot]], [doc[~hot]], [begin[~hot]], [n[~hot]]
            spots = np.flatnonzero(hot)
            sizes = n[spots] + window - 1
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(spots):  # the same windows, cut finer, about a block's units at a time
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
                part, size = spots[lo:hi], sizes[lo:hi]
                edges = np.concatenate([[0], np.cumsum(size)])
                k2, first, count, _ = least_runs(values_of(raw[ragged(begin[part], size)]), edges, window, gram, levels=3)
                owner = np.searchsorted(edges, first, "right") - 1
                out_key.append(k2.view(np.int64))
                out_doc.append(doc[part][owner])
                out_begin.append(begin[part][owner] + first - edges[owner])
                out_n.append(count)
                lo = hi
            fine = np.arange(sum(map(len, out_key))) >= len(out_key[0])
            key, doc, begin, n = (np.concatenate(x) for x in (out_key, out_doc, out_begin, out_n))
            ids = rows.column(0).to_numpy()[doc]
            size = np.cumsum((n + window - 1) * raw.itemsize)
            lo = 0
            while lo < len(key):  # 1 MB of bodies at most, or one
                hi = max(lo + 1, min(lo + 8192, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + (1 << 20), "right"))))
                part = slice(lo, hi)
                yield batch_of(raw, fine[part], key[part], ids[part], (begin - at[doc])[part], begin[part], n[part])
                lo = hi

    @lean
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, list[int]] = {}  # each body of the shard: its least place, and whether it has others
        size, now = 0, None

        def rows_of(cols: list[list[int]] | list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "lo", "hi"])

        def flush() -> pa.RecordBatch:
            doc, start, times = (np.array([m[k] for m in met.values()], np.int64) for k in range(3))
            body, lo, hi = index(list(met), times, doc, start)
            return rows_of([doc[body], start[body] + lo, start[body] + hi])

        for batch in batches:
            shard_k, keys, doc, start, sizes = (batch.column(k).to_numpy() for k in range(5))
            bodies = batch.column(5).to_pylist()
            docs_l, starts, lengths = doc.tolist(), start.tolist(), sizes.tolist()
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (shard_k[1:] != shard_k[:-1])
            edges = np.flatnonzero(new).tolist()
            whole: list[tuple[int, int, int]] = []
            for lo, hi in zip(edges, [*edges[1:], len(keys)], strict=True):
                key = (int(shard_k[lo]), int(keys[lo]))
                # a shard is indexed whole, and an outsized one in parts that keep each key together
                if met and key != now and (key[0] != now[0] or size > 2 * shard_units * unit_bytes):
                    yield flush()
                    met, size = {}, 0
                now = key
                for k in range(lo, hi):
                    b, d, s = bodies[k], docs_l[k], starts[k]
                    if b is None:
                        whole.append((d, s, s + lengths[k]))
                    elif (was := met.get(b)) is None:
                        met[b] = [d, s, 1]
                        size += len(b)
                    else:
                        if (d, s) < (was[0], was[1]):
                            d, s, was[0], was[1] = was[0], was[1], d, s
                        was[2] = 2
                        if (d, s) != (was[0], was[1]):
                            whole.append((d, s, s + lengths[k]))
            if whole:
                yield rows_of(list(zip(*whole, strict=True)))
        if met:
            yield flush()

    joined = docs.select("doc_id", "text").join(places.select("doc_id", "places").hint("shuffle_hash"), "doc_id")
    segments = joined.mapInArrow(cut, SEGMENTS).repartition(max(1, int(shards) // 4), "shard").sortWithinPartitions("shard", "key")
    return segments.mapInArrow(mark, SPANS)


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, first) of each document whose text other documents have too; first: the smallest such id.

    The repeated texts' digests are written first, so that the join back is a broadcast or one whose skew Spark can split.
    """
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    groups = keyed.groupBy("h", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = small_side(written(groups, "copies"), BROADCAST_BYTES)
    return keyed.join(groups, ["h", "n"]).groupBy("doc_id").agg(F.min("first").alias("first"))


def with_spans(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """docs with columns `_first` (smallest doc_id of the same text, null if there is no other) and `_spans`.

    What was found is written first; it is broadcast if its files hold at most 16 MB, and shuffled beyond.
    """
    per = marked.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    found = written(per.join(copies(docs), "doc_id", "full").select("doc_id", F.col("first").alias("_first"), "_spans"), "spans")
    return docs.join(small_side(found, BROADCAST_BYTES), "doc_id", "left")


def union_spans(lo: np.ndarray, hi: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges joined where they touch, none beyond `size`."""
    lo, hi = np.minimum(lo, size), np.minimum(hi, size)
    order = np.argsort(lo, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(lo[order].tolist(), hi[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def marked_ranges(flags: np.ndarray, owner: np.ndarray, base: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [lo, hi) of units that flagged window starts cover: owner of each, counted from base[owner].  flags, owner by position."""
    apart = owner[1:] != owner[:-1]
    new, end = flags.copy(), flags.copy()
    new[1:] &= ~flags[:-1] | apart
    end[:-1] &= ~flags[1:] | apart
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    who = owner[first]
    return who, first - base[who], last - base[who] + window
