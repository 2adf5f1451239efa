"""Repeated word windows by a compressed FM-index per shard: backward search over a wavelet matrix.

A shard's segments stream backward through the index of their own shard, all at once: each step extends every stream's
match by the word before it and gives the interval of suffixes that begin with the match, capped at the window's
length.  Where the match is a whole window, the least place in its interval tells whether it occurs earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import repeats
from pairforge.llm.common import SPACED, lean, text_blocks, words
from pairforge.llm.runlength_index import suffix_order

WINDOW, GRAM, SHARD_UNITS, HOT_UNITS = 20, 3, 1 << 18, 1 << 20


class WaveletMatrix:
    """rank(symbol, i): how often a symbol stands in the first i places.  One bit vector a bit of the symbols, with counts for every 64 bits."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.bits = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.levels = []
        for level in range(self.bits - 1, -1, -1):
            ones = (symbols >> level) & 1
            packed = np.packbits(np.concatenate([ones.astype(np.uint8), np.zeros(-len(ones) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.uint32)
            self.levels.append((packed, counts, int((ones == 0).sum())))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])
        # where each symbol's places begin on the last level: subtracted to give a count

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(i), np.int64)
        both = np.concatenate([begin, i])
        symbol = np.concatenate([symbol, symbol])
        for k, (packed, counts, zeros) in enumerate(self.levels):
            word = both >> 6
            ones = counts[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            both = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, zeros + ones, both - ones)
        return both[len(i) :] - both[: len(i)]


class FMIndex:
    """Over words as dense numbers from 1, each text followed by 0; suffixes sorted to at least `depth` words."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.order, _, rounds = suffix_order(symbols, depth)
        self.n = len(symbols)
        counts = np.bincount(symbols, minlength=int(symbols.max()) + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.matrix = WaveletMatrix(symbols[self.order - 1])
        # the longest agreement that the rounds tell of is built up from two ranks of one round
        width = int(symbols.max() + 1).bit_length()
        have, ranks = max(1, 63 // width), rounds[0]
        for r in rounds[1:]:
            if have >= depth:
                break
            if have * 3 > depth:
                break
            have, ranks = have * 3, r
        same = np.ones(self.n - 1, bool)
        steps = [0] if have >= depth else [*range(0, depth - have, have), depth - have]
        pad = np.concatenate([ranks, np.full(depth + 1, -1)])
        if have > depth:  # a round reaches beyond the window: compare symbols
            ranks, steps = symbols, list(range(depth))
            pad = np.concatenate([symbols, np.full(depth + 1, -1)])
        for s in steps:
            x = pad[self.order + s]
            same &= x[1:] == x[:-1]
        self.group = np.concatenate([[0], np.cumsum(~same)])  # number of the suffix's group of equal first `depth` words
        self.edge = np.append(np.flatnonzero(np.concatenate([[True], ~same])), self.n)
        self.depth = depth

    def statistics(self, streams: np.ndarray, base: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(stream, place in it, match length, first suffix of the interval), place by place from the streams' ends.

        The match at a place is the longest that starts there and occurs in the index, at most `depth` long.  The
        streams must consist of texts of the index, so that a match never breaks off.
        """
        order = np.argsort(-size, kind="stable")
        lo, hi, length = np.zeros(len(size), np.int64), np.full(len(size), self.n), np.zeros(len(size), np.int64)
        for step in range(int(size.max(initial=0))):
            live = order[: np.searchsorted(-size[order], -step, "left")]
            c = streams[base[live] + size[live] - 1 - step]
            ranks = self.matrix.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            a, b = self.first[c] + ranks[: len(live)], self.first[c] + ranks[len(live) :]
            if (a >= b).any():
                raise ValueError("a stream holds words that the index does not")
            grown = length[live] + 1
            full = grown > self.depth  # one word too long: widen to all that share the first `depth` words
            g = self.group[a[full]]
            a[full], b[full] = self.edge[g], self.edge[g + 1]
            lo[live], hi[live], length[live] = a, b, np.minimum(grown, self.depth)
            yield live, size[live] - 1 - step, length[live], a


def mark(bodies: list[bytes], doc: np.ndarray, start: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each body, at its least place (doc, start), covered by windows that also start earlier."""
    size = np.array([len(b) >> 3 for b in bodies], np.int64)
    base = np.cumsum(size + 1) - size - 1
    raw = np.frombuffer(b"".join(bodies), np.uint64)
    _, dense = np.unique(raw, return_inverse=True)
    symbols = np.zeros(len(raw) + len(bodies), np.int64)
    own = np.repeat(np.arange(len(bodies)), size)
    symbols[np.arange(len(raw)) + own] = dense + 1
    # places comparable as one number
    _, doc_k = np.unique(doc, return_inverse=True)
    place = (doc_k.astype(np.int64) << 36) + start
    index = FMIndex(symbols, window)
    owner = np.repeat(np.arange(len(bodies)), size + 1)
    at = place[owner] + (np.arange(len(symbols)) - base[owner])
    earliest = np.minimum.reduceat(at[index.order], index.edge[:-1])
    later = np.zeros(len(symbols), bool)
    for stream, k, length, lo in index.statistics(symbols, base, size):
        whole = length == window
        spot = base[stream[whole]] + k[whole]
        later[spot] = at[spot] > earliest[index.group[lo[whole]]]
    return repeats.marked_ranges(later, owner, base, window)


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_units: int = SHARD_UNITS, hot_units: int = HOT_UNITS, hot_runs: int = repeats.HOT_RUNS) -> DataFrame:
    """docs (distinct, not null doc_id; text) with `_first` and `_spans`; spans are in words."""

    def index(bodies: list[bytes], times: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple:
        return mark(bodies, doc, start, window)

    marked = repeats.spans(docs.select("doc_id", "text"), repeats.word_units, window, gram, index, 8, shard_units, hot_units, hot_runs)
    return repeats.with_spans(docs, marked)


def report(docs: DataFrame, window: int = WINDOW, **options: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): every word in a window of `window` words that starts earlier too goes.

    Windows never cross documents.  Null texts have no words; rows with a null id are left out; rows that repeat an id are
    documents of their own that share their spans; other columns are ignored; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")

    @lean
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_blocks(batches, "text"):
            _, _, _, at = words(buf, offs, SPACED, False)
            counts = np.diff(at)
            ids = rows.column(0).to_numpy()
            first, lists = rows.column(rows.num_columns - 2).to_pylist(), rows.column(rows.num_columns - 1)
            ptr, lo, hi = np.asarray(lists.offsets), *(lists.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            removed, shas = [], []
            for k, n in enumerate(counts.tolist()):
                kept = buf[offs[k] : offs[k + 1]].tobytes().split()
                spans = repeats.union_spans(lo[ptr[k] : ptr[k + 1]], hi[ptr[k] : ptr[k + 1]], n)
                if first[k] is not None and first[k] != ids[k] and n >= window:
                    spans = [(0, n)]
                for a, b in reversed(spans):
                    del kept[a:b]
                removed.append(n - len(kept))
                shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts), pa.array(removed, pa.int64()), pa.array(shas)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated(rows, window, **options).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
