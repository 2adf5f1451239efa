"""Long exact repeats by a run-length index: run-compressed Burrows-Wheeler transform with samples at run ends.

For a text position p let near(p) be how far its suffix agrees with its neighbour in suffix order.  Inside a run of the
transform, near(p) = near(p - 1) - 1; only at run ends does it start anew.  So the index keeps, for each run, the text
positions of its two ends and their agreement with the neighbour beyond; the positions stream past these samples in
text order, and each gets its matching statistic: the longest match of the text from p that occurs anywhere else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import repeats
from pairforge.llm.common import lean, text_blocks

WINDOW, GRAM, SHARD_UNITS, HOT_UNITS = 200, 32, 1 << 19, 4 << 20
END = 0xFF  # never a byte of UTF-8
CHUNK = 1 << 16  # positions that are worked on together


def _borders(head: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about CHUNK slots that each begin with a group; a larger group comes whole."""
    lo, n = 0, len(head)
    while lo < n:
        hi = lo + CHUNK
        while hi < n and not head[hi : hi + CHUNK].any():
            hi += CHUNK
        hi = hi + int(head[hi : hi + CHUNK].argmax()) if hi < n else n
        yield lo, hi
        lo = hi


def suffix_order(symbols: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, rank of each position, ranks after each round), sorted to `depth` symbols or until all differ; rounds only with `depth`.

    Prefix tripling: a round joins the ranks of three adjacent prefixes; only groups that are still tied are sorted again, some at a
    time, so that beside the first sort's keys little more than the order and the ranks are held.
    """
    n = len(symbols)
    number = np.int32 if n < 1 << 31 else np.int64
    above = symbols.astype(np.uint16 if symbols.dtype == np.uint8 else np.uint64)
    above += 1  # 0 stands beyond the end
    width = int(above.max()).bit_length()
    per = max(1, 63 // width)
    key = np.zeros(n, np.uint64)
    for k in range(per):
        key <<= np.uint64(width)
        key[: max(0, n - k)] |= above[k:]
    del above
    order = np.argsort(key, kind="stable").astype(number)
    head = np.ones(n, bool)
    for lo in range(1, n, CHUNK):
        sorted_key = key[order[lo - 1 : lo + CHUNK]]
        head[lo : lo + CHUNK] = sorted_key[1:] != sorted_key[:-1]
    del key
    have, rounds = per, []
    rank = np.empty(n, number)
    while True:
        first = 0
        for lo in range(0, n, CHUNK):
            slots = np.arange(lo, min(lo + CHUNK, n))
            slots = np.maximum.accumulate(np.where(head[slots], slots, first))
            rank[order[lo : lo + CHUNK]] = slots
            first = slots[-1]
        if depth:
            rounds.append(rank.copy())
        if (depth and have >= depth) or head.all():
            return order, rank, rounds
        for lo, hi in _borders(head):
            tied = ~head[lo:hi]
            tied[:-1] |= tied[1:]
            at = np.flatnonzero(tied) + lo
            if not len(at):
                continue
            pos = order[at].astype(np.int64)
            group = rank[pos]
            one, two = (np.where(pos + k * have < n, rank[np.minimum(pos + k * have, n - 1)] + number(1), number(0)) for k in (1, 2))
            if n < 1 << 21:
                keys = [(group.astype(np.uint64) << np.uint64(42)) | (one.astype(np.uint64) << np.uint64(21)) | two.astype(np.uint64)]
                del group, one, two
                deal = np.argsort(keys[0], kind="stable")
            else:
                keys = [group, one, two]
                deal = np.lexsort(keys[::-1])
            order[at] = pos[deal]
            differ = np.zeros(len(at), bool)
            differ[0] = True
            for x in keys:
                x = x[deal]
                differ[1:] |= x[1:] != x[:-1]
            head[at] = differ
        have *= 3


def agreement(text: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the common prefix of text[a:] and text[b:], at most room."""
    wide = 32
    pad = np.concatenate([text, np.zeros(2 * wide, np.uint8)])
    words = np.lib.stride_tricks.as_strided(pad, (len(text) + wide, wide), (1, 1))
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(room > 0)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        inside = np.maximum(x, y) < len(text)
        live, x, y = live[inside], x[inside], y[inside]
        differ = words[x] != words[y]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        out[live] += first
        live = live[(first == wide) & (out[live] < room[live])]
    return np.minimum(out, room)


class RunLengthIndex:
    """Over the concatenation of texts, each followed by END.

    heads and tails hold the text positions at which runs begin and end (sampled, sorted by position), and head_near and
    tail_near how far each agrees with its neighbour above or below; starts of texts are samples too.
    """

    def __init__(self, text: np.ndarray, base: np.ndarray, stop: np.ndarray) -> None:
        order, rank, _ = suffix_order(text)
        before = text[order - 1]
        first = np.ones(len(text), bool)
        first[1:] = before[1:] != before[:-1]
        edges = np.flatnonzero(first)
        self.run_lengths = np.diff(edges, append=len(text))
        self.runs = before[edges]
        del before, edges
        last = np.append(first[1:], True)
        at = rank[base]
        first[at] = last[at] = True
        del rank, at
        self.heads, self.head_near = self._samples(text, order, first, -1, base, stop)
        self.tails, self.tail_near = self._samples(text, order, last, 1, base, stop)

    @staticmethod
    def _samples(text: np.ndarray, order: np.ndarray, sampled: np.ndarray, step: int, base: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near_at = np.full(len(order), -1, order.dtype)
        for lo in range(0, len(order), CHUNK):
            slots = np.flatnonzero(sampled[lo : lo + CHUNK]) + lo
            pos, other = order[slots], slots + step
            real = (other >= 0) & (other < len(order))
            room = stop[np.searchsorted(base, pos, "right") - 1] - pos  # to its own text's end; END belongs to the text before it
            near_at[pos[~real]] = 0
            near_at[pos[real]] = agreement(text, pos[real], order[other[real]], room[real])
        at = np.flatnonzero(near_at >= 0).astype(order.dtype)
        return at, near_at[at]

    def matching_statistics(self, lo: int, hi: int) -> np.ndarray:
        """For each text position of [lo, hi), the longest match that also starts elsewhere."""
        p = np.arange(lo, hi)
        best = np.zeros(hi - lo, np.int64)
        for pos, near in ((self.heads, self.head_near), (self.tails, self.tail_near)):
            k = np.searchsorted(pos, p, "right") - 1
            np.maximum(best, near[k] - (p - pos[k]), out=best)
        return best


def mark(bodies: list[bytes], times: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each body covered by windows that also start elsewhere.  A body that occurs more than once is indexed twice:
    that others equal it is all that more copies could tell."""
    twice = np.repeat(np.arange(len(bodies)), np.minimum(times, 2))
    lead = np.searchsorted(twice, np.arange(len(bodies)))  # the first entry of each body
    text = np.frombuffer(b"".join(bodies[k] + b"\xff" for k in twice), np.uint8)
    size = np.array([len(b) for b in bodies], np.int64)[twice]
    base = np.cumsum(size + 1) - size - 1
    index = RunLengthIndex(text, base, base + size)
    flags = np.concatenate([index.matching_statistics(lo, min(lo + CHUNK, len(text))) >= window for lo in range(0, len(text), CHUNK)])
    del index
    owner = np.repeat(np.arange(len(twice), dtype=np.int32 if len(twice) < 1 << 31 else np.int64), size + 1)
    who, lo, hi = repeats.marked_ranges(flags, owner, base, window)
    own = lead[twice[who]] == who
    return twice[who][own], lo[own], hi[own]


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_units: int = SHARD_UNITS, hot_units: int = HOT_UNITS, hot_runs: int = repeats.HOT_RUNS) -> DataFrame:
    """docs (distinct, not null doc_id; text) with `_first` and `_spans`; see repeats.with_spans.  Spans are in UTF-8 bytes."""

    def index(bodies: list[bytes], times: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple:
        return mark(bodies, times, window)

    marked = repeats.spans(docs.select("doc_id", "text"), repeats.byte_units, window, gram, index, 1, shard_units, hot_units, hot_runs)
    return repeats.with_spans(docs, marked)


def _pieces(rows: pa.RecordBatch, offs: np.ndarray, window: int) -> Iterator[list[tuple[int, int]]]:
    first, lists = rows.column(rows.num_columns - 2).to_pylist(), rows.column(rows.num_columns - 1)
    ptr, lo, hi = np.asarray(lists.offsets), *(lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    for k in range(rows.num_rows):
        n = int(offs[k + 1] - offs[k])
        if first[k] is not None:
            yield [(0, n)] if n >= window else []
        else:
            yield repeats.union_spans(lo[ptr[k] : ptr[k + 1]], hi[ptr[k] : ptr[k + 1]], n)


def report(docs: DataFrame, window: int = WINDOW, **options: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): every byte covered by a `window`-byte string that starts elsewhere too goes.

    Matches never cross documents.  Null texts are empty; rows with a null id are left out; rows that repeat an id are
    documents of their own that share their spans, and repeated texts are copies; other columns are ignored; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")

    @lean
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_blocks(batches, "text"):
            view, out = memoryview(np.ascontiguousarray(buf)), []
            for k, spans in enumerate(_pieces(rows, offs, window)):
                sha, at = hashlib.sha256(), int(offs[k])
                for lo, hi in spans:
                    sha.update(view[at : offs[k] + lo])
                    at = int(offs[k]) + hi
                sha.update(view[at : offs[k + 1]])
                out.append((sum(b - a for a, b in spans), len(spans), sha.hexdigest()))
            removed, n, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated(rows, window, **options).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, **options: int) -> DataFrame:
    """docs with the repeated bytes taken out of text and n_chars set anew; all other columns unchanged.

    A character that a span covers only in part stays.  Texts that are left empty are kept as empty texts.  Rows with a null id pass
    unchanged.
    """
    columns, schema = docs.columns, docs.schema
    aliases = {c: f"_c{k}" for k, c in enumerate(c for c in columns if c not in ("doc_id", "text"))}
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(a) for c, a in aliases.items()))
    found = repeated(rows, window, **options).select("doc_id", "text", *aliases.values(), "_first", "_spans")
    out = found.drop("_first", "_spans").schema

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_blocks(batches, "text"):
            cont = np.concatenate([(buf & 0xC0) == 0x80, [False]])
            texts = []
            old = rows.column(1)
            for k, spans in enumerate(_pieces(rows, offs, window)):
                if not spans:
                    texts.append(old[k].as_py())
                    continue
                raw, keep, at = buf[offs[k] : offs[k + 1]].tobytes(), [], 0
                for lo, hi in spans:
                    while lo < hi and cont[offs[k] + lo]:
                        lo += 1
                    while hi > lo and hi < len(raw) and cont[offs[k] + hi]:
                        hi -= 1
                    keep.append(raw[at:lo])
                    at = hi
                texts.append(b"".join([*keep, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string()), *rows.columns[2:-2]], names=rows.schema.names[:-2])

    done = found.mapInArrow(cut, out)
    cols = {"doc_id": F.col("doc_id").cast(schema["doc_id"].dataType).alias("doc_id"), "text": F.col("text")} | {c: F.col(a).alias(c) for c, a in aliases.items()}
    if "n_chars" in aliases:
        cols["n_chars"] = F.length("text").cast(schema["n_chars"].dataType).alias("n_chars")
    return done.select(*(cols[c] for c in columns)).union(docs.where("doc_id is null"))
