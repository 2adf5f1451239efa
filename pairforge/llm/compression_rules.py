"""Quality rules with compression bands: zstandard ratios of whole documents and of fixed chunks.

Text that repeats itself compresses too well, text without structure (keys, encoded binaries) too badly.  How well prose
compresses depends on how long it is, so the limits do too: a document's ratio is held against the band of its length, and each of its
chunks of `CHUNK` bytes (a rest below LEAST_CHUNK is part of the last) against the band of the chunk's.  A document is rejected outside its own band, or
where at least one chunk in `SHARE` is outside.  Words, lines and windows of words are compared by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import SPACED, exact_ids, lean, text_blocks, unused, within, word_bounds

LEVEL, CHUNK, LEAST_CHUNK, SHARE = 3, 4096, 1024, 4
LEAST_WORDS, MOST_REPEATED = 50, 50
#: (bytes from which on it holds, least ratio, most ratio) of raw to compressed bytes.  Prose in alphabets and in larger scripts lies well
#: within; base64 is 1.3 whatever its length, a phrase written twice in a row doubles what its text had.
BANDS = [(0, 0.8, 3.0), (256, 1.1, 2.6), (512, 1.25, 2.6), (1024, 1.35, 2.9), (4096, 1.5, 3.3), (16384, 1.6, 3.7), (65536, 1.7, 4.5)]
EDGES, LEAST, MOST = (np.array(x) for x in zip(*BANDS, strict=True))
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["n_bytes", "n_packed", "n_chunks", "n_chunks_low", "n_chunks_high"]
MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS + RATIOS])


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def duplicate_lines(buf: np.ndarray, offs: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line of it."""
    starts = np.unique(np.concatenate([offs[:-1], np.flatnonzero(buf == 10) + 1]))
    starts = starts[starts < len(buf)]
    ends = np.append(starts[1:], len(buf))
    ends = ends - ((ends > starts) & (buf[np.maximum(ends - 1, 0)] == 10))
    filled = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[filled], ends[filled]
    text = np.searchsorted(offs, starts, "right") - 1
    ids = exact_ids(buf, starts, ends)
    first = np.unique(text * (int(ids.max(initial=0)) + 1) + ids, return_index=True)[1]
    again = np.ones(len(starts), bool)
    again[first] = False
    return np.bincount(text[again], minlength=len(offs) - 1)


def repeated_words(ids: np.ndarray, at: np.ndarray, width: int = 3) -> np.ndarray:
    """Which words lie in a window of `width` words that their text holds twice or more."""
    starts = np.flatnonzero(within(at, width, len(ids)))
    hit = np.zeros(len(ids) + 1, np.int32)
    if len(starts):
        key = np.searchsorted(at, starts, "right") - 1
        for k in range(width):
            key = np.unique(key * (int(ids.max()) + 1) + ids[starts + k], return_inverse=True)[1]
        twice = starts[np.bincount(key)[key] > 1]
        hit[twice] += 1  # starts and ends are distinct
        hit[twice + width] -= 1
    return np.cumsum(hit[:-1]) > 0


def band(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most ratio for so many bytes."""
    k = np.searchsorted(EDGES, sizes, "right") - 1
    return LEAST[k], MOST[k]


def packed_sizes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    coder = zstandard.ZstdCompressor(level=LEVEL)
    view = memoryview(np.ascontiguousarray(buf))
    return np.fromiter((len(coder.compress(view[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))


def measures(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a block."""
    starts, ends, at = word_bounds(buf, offs, SPACED)
    letters = SPACED[buf] & ((buf & 0xC0) != 0x80)
    sizes = np.diff(offs)
    n_chunks = np.maximum((sizes + CHUNK - LEAST_CHUNK) // CHUNK, sizes > 0)
    owner = np.repeat(np.arange(len(sizes)), n_chunks)
    lo = offs[owner] + CHUNK * (np.arange(len(owner)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks))
    hi = np.where(np.append(owner[1:] != owner[:-1], len(owner) > 0)[: len(owner)], offs[owner + 1], lo + CHUNK)
    packed = packed_sizes(buf, offs[:-1], offs[1:])
    chunk_packed = packed[owner]  # a text of one chunk is that chunk
    many = n_chunks[owner] > 1
    chunk_packed[many] = packed_sizes(buf, lo[many], hi[many])
    low, high = band(hi - lo)
    ratio = (hi - lo) / chunk_packed
    return {
        "n_words": np.diff(at), "word_chars": per_text(letters, offs), "n_symbols": per_text(SYMBOL[buf], offs), "n_dup_lines": duplicate_lines(buf, offs, starts),
        "n_repeat_words": per_text(repeated_words(exact_ids(buf, starts, ends), at), at), "n_bytes": sizes, "n_packed": packed, "n_chunks": n_chunks,
        "n_chunks_low": np.bincount(owner[ratio < low], minlength=len(sizes)), "n_chunks_high": np.bincount(owner[ratio > high], minlength=len(sizes)),
    }


def scan(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """docs with a column `out` of the measures of each text.

    No shuffle, and memory follows a block of texts or the longest of them.  A null text counts as an empty one; repeated rows
    and other columns pass; an empty table gives none.
    """
    if out in docs.columns:
        raise ValueError(f"the documents have a column {out}")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, MEASURES)])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_blocks(batches, text):
            found = measures(buf, offs)
            cols = [pa.array(found[c].astype(np.int64)) for c in COUNTS + RATIOS]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.StructArray.from_arrays(cols, names=COUNTS + RATIOS)], names=[*rows.schema.names, out])

    return docs.mapInArrow(run, schema)


def base_failed(found: str) -> Column:
    """Too few words, or too many of them in windows of three that come again."""
    x = lambda c: F.col(f"{found}.{c}")
    return (x("n_words") < LEAST_WORDS) | (100 * x("n_repeat_words") > MOST_REPEATED * x("n_words"))


def out_of_band(found: str) -> Column:
    """The whole text, or at least one chunk in SHARE, compresses too well or too badly for its length; an empty text is within."""
    x = lambda c: F.col(f"{found}.{c}")
    ratio = x("n_bytes") / F.greatest(x("n_packed"), F.lit(1))
    whole = F.lit(False)
    for (least, low, high), beyond in zip(BANDS, [*(b[0] for b in BANDS[1:]), None], strict=True):
        here = (x("n_bytes") >= max(least, 1)) & ((x("n_bytes") < beyond) if beyond else F.lit(True))
        whole = whole | (here & ((ratio < low) | (ratio > high)))
    chunks = SHARE * (x("n_chunks_low") + x("n_chunks_high"))
    return whole | ((chunks > 0) & (chunks >= x("n_chunks")))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) and the ratios' parts of each document.

    Every row gives one, null and repeated ids included; null and empty texts have no words and are not kept; other columns are ignored.
    """
    found = scan(docs.select("doc_id", "text"), "_found")
    failed = base_failed("_found")
    return found.select("doc_id", *(f"_found.{c}" for c in COUNTS), failed.alias("base_failed"), (~failed & ~out_of_band("_found")).alias("kept"), *(f"_found.{c}" for c in RATIOS))


def without_rejected(docs: DataFrame) -> DataFrame:
    """The documents that pass, unchanged: texts without words go; repeated rows and other columns, whatever their names, pass."""
    (name,) = unused(docs, "found")
    return scan(docs, name).where(~base_failed(name) & ~out_of_band(name)).drop(name)
