"""Benchmark decontamination with a broadcast hash set of normalised test windows.

The windows of the test items (`width` consecutive words; a shorter item is one window) are hashed on the driver and
broadcast under the run's own key, in blocks of a checked size: a larger benchmark makes several narrow passes over the documents, never a
larger broadcast.  Every hit is verified byte by byte against the item before it counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.llm.common import ALNUM, LOWER, lean, ragged, text_blocks, unused, window_hash, within, words, written

MOST_BYTES = 32 << 20
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))), T.StructField("items", T.ArrayType(T.LongType()))])


class Windows:
    """Distinct windows of a block of items: their hashes by width, their words' bytes, and the items that hold each."""

    def __init__(self, item_ids: list[int], texts: list[str], width: int) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        hashes, starts, ends, at = words(buf, offs, ALNUM, True)
        self.bytes, self.starts, self.ends = LOWER[buf], starts, ends
        counts = np.diff(at)
        self.tables = []
        for n in sorted({min(int(c), width) for c in counts if c}):
            takes = (counts >= width) if n == width else counts == n
            per = np.where(takes, counts - n + 1, 0)
            first, owner = ragged(at[:-1], per), np.repeat(np.arange(len(counts)), per)
            found = window_hash(hashes, n)
            while len(first):  # once, unless different windows have one hash: then each is kept, table by table
                keys, rep, back = np.unique(found[first], return_index=True, return_inverse=True)
                same = self.equal(first[rep][back], self.bytes, starts, ends, first, n)
                pairs = np.unique(np.stack([back[same], owner[same]]), axis=1)
                self.tables.append((n, keys, first[rep], np.searchsorted(pairs[0], np.arange(len(keys) + 1)), np.asarray(item_ids, np.int64)[pairs[1]]))
                first, owner = first[~same], owner[~same]

    def equal(self, mine: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, theirs: np.ndarray, n: int) -> np.ndarray:
        """Whether n words from each of `mine` are, byte by byte, those of another text from each of `theirs`."""
        a, b = ragged(theirs, np.full(len(theirs), n)), ragged(mine, np.full(len(mine), n))
        same = (ends - starts)[a] == (self.ends - self.starts)[b]
        size = np.where(same, (ends - starts)[a], 0)
        alike = low[ragged(starts[a], size)] == self.bytes[ragged(self.starts[b], size)]
        wrong = np.zeros(len(a), np.int64)
        np.add.at(wrong, np.repeat(np.arange(len(a)), size)[~alike], 1)
        return (same & (wrong == 0)).reshape(-1, n).all(axis=1)

    def hits(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text as offsets, hit words, text of each found item, found items)."""
        hashes, starts, ends, at = words(buf, offs, ALNUM, True)
        low = LOWER[buf]
        hit = np.zeros(len(hashes) + 1, np.int32)
        docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, keys, rep, ptr, ids in self.tables:
            found = window_hash(hashes, n)
            k = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            pos = np.flatnonzero((keys[k] == found) & within(at, n, len(hashes)))
            if not len(pos):
                continue
            good = self.equal(rep[k[pos]], low, starts, ends, pos, n)
            pos, k = pos[good], k[pos][good]
            np.add.at(hit, pos, 1)
            np.add.at(hit, pos + n, -1)
            doc = np.searchsorted(at, pos, "right") - 1
            seen = np.unique(np.stack([doc, k]), axis=1)
            per = ptr[seen[1] + 1] - ptr[seen[1]]
            docs.append(np.repeat(seen[0], per))
            items.append(ids[ragged(ptr[seen[1]], per)])
        return at, np.cumsum(hit[:-1]) > 0, np.concatenate(docs), np.concatenate(items)


def scan(docs: DataFrame, benchmark: DataFrame, out: str, width: int = 13, item_id: str = "item_id", item_text: str = "text", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs with a column `out`: struct(n_words, spans of hit words as [lo, hi), sorted distinct items).

    No shuffle: the documents stream through.  After each pass but the last they are written, and its broadcast is destroyed, so that
    one block of windows is held at a time.  Null texts have no words; null items and items without words hit
    nothing; an empty benchmark gives empty spans; other columns pass through unchanged.
    """
    if out in docs.columns:
        raise ValueError(f"the documents have a column {out}")
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / most_bytes))
    spark = docs.sparkSession
    none = F.lit(None).cast(HITS)
    docs = docs.withColumn(out, none)
    schema = docs.schema
    where = docs.columns.index(text)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).orderBy("i", "t").collect()
        shared = spark.sparkContext.broadcast(Windows([r.i for r in part], [r.t for r in part], width))

        @lean
        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for rows, buf, offs in text_blocks(batches, schema[where].name):
                at, hit, docs_k, items = shared.value.hits(buf, offs)
                edge = np.zeros(len(hit) + 1, bool)
                edge[:-1] = hit
                begins = edge[:-1].copy()
                begins[1:] &= ~hit[:-1]
                cut = at[1:-1][at[1:-1] < len(hit)]
                begins[cut] = hit[cut]
                lo = np.flatnonzero(begins)
                stops = ~edge[1:] & hit
                stops[cut[cut > 0] - 1] = hit[cut[cut > 0] - 1]
                hi = np.flatnonzero(stops) + 1
                doc = np.searchsorted(at, lo, "right") - 1
                spans = [[] for _ in range(rows.num_rows)]
                for d, x, y in zip(doc.tolist(), (lo - at[doc]).tolist(), (hi - at[doc]).tolist(), strict=True):
                    spans[d].append((x, y))
                found: list[set] = [set() for _ in spans]
                for d, i in zip(docs_k.tolist(), items.tolist(), strict=True):
                    found[d].add(i)
                old = rows.column(rows.num_columns - 1).to_pylist()
                new = []
                for k, (n, s, i, was) in enumerate(zip(np.diff(at).tolist(), spans, found, old, strict=True)):
                    if was:
                        s, i = merged(s + [(x["lo"], x["hi"]) for x in was["spans"]]), i | set(was["items"])
                    new.append({"n_words": n, "spans": [{"lo": x, "hi": y} for x, y in s], "items": sorted(i)})
                kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("items", pa.list_(pa.int64()))])
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(new, kind)], names=rows.schema.names)

        docs = docs.mapInArrow(mark, schema)
        if block < blocks - 1:
            docs = written(docs, "scanned")
            shared.destroy()
    return docs


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def n_hit(found: str) -> "F.Column":
    return F.aggregate(F.col(found + ".spans"), F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])


def contaminated(found: str, share: int = 20) -> "F.Column":
    """Hit at all, and in at least one word of `share`."""
    return (n_hit(found) > 0) & (share * n_hit(found) >= F.col(found + ".n_words"))


def report(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document.

    Every row gives one, null and repeated ids included; null and empty texts have no words and are not contaminated; other columns
    are ignored; an empty table gives none.
    """
    found = scan(docs.select("doc_id", "text"), benchmark, "_found", width)
    items = F.array_join(F.array_sort(F.transform("_found.items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", F.col("_found.n_words").alias("n_words"), n_hit("_found").alias("n_hit"), F.size("_found.items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), contaminated("_found", share).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, unchanged: null and empty texts, repeated rows and other columns, whatever their names, pass.

    An empty table gives none; an empty benchmark leaves all.
    """
    (name,) = unused(docs, "found")
    return scan(docs, benchmark, name, width).where(~contaminated(name, share)).drop(name)


def without_spans(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The documents with their hit words taken out; bytes between two hit words of one span go too.

    Every row stays, repeated ones too; null texts stay null; other columns pass, whatever their names; an empty table gives none.
    """
    (name,) = unused(docs, "found")
    found = scan(docs, benchmark, name, width)
    schema = found.drop(name).schema
    where = docs.columns.index("text")

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in text_blocks(batches, "text"):
            _, starts, ends, at = words(buf, offs, ALNUM, True)
            out = []
            for k, (text, hit) in enumerate(zip(rows.column(where).to_pylist(), rows.column(rows.num_columns - 1).to_pylist(), strict=True)):
                if hit and hit["spans"]:
                    raw, keep, pos = text.encode(), [], 0
                    for s in hit["spans"]:
                        keep.append(raw[pos : starts[at[k] + s["lo"]] - offs[k]])
                        pos = ends[at[k] + s["hi"] - 1] - offs[k]
                    text = b"".join([*keep, raw[pos:]]).decode()
                out.append(text)
            cols = list(rows.columns[:-1])
            cols[where] = pa.array(out, rows.schema.field(where).type)
            yield pa.RecordBatch.from_arrays(cols, names=rows.schema.names[:-1])

    return found.mapInArrow(cut, schema)
