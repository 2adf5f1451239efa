"""Packing documents into fixed-length sequences with a grouping genetic algorithm on islands.

Pieces are dealt at random to blocks of bounded size, and each block starts from best fit by falling length.  Where that misses the lower
bound, several islands evolve the block's packing; a gene is a whole bin.  Crossover injects well-filled bins of one parent into the
other, dissolves the bins of the other that would hold a document twice, lets displaced documents replace smaller ones that
fill a bin worse, and puts the rest back by best fit.  Between epochs each island's best packing migrates to the next
island.  Bins that stay loose are opened again, together with those of all other blocks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import lean, text_blocks, written
from pairforge.llm.encoding import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
EVOLVED = "block long, island int, epoch int, bins long, least long, fill double, lengths binary, assigned binary"
BLOCK_PIECES, ISLANDS, EPOCHS, POPULATION, GENERATIONS, LOOSE = 4096, 3, 2, 6, 40, 0.97


def pieces(docs: DataFrame, vocabulary: str, size: int, skip_blanks: bool, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of `size` only where longer: (doc_id, piece, start, length, ids_crc32)."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, skip_blanks)
        for rows, buf, offs in text_blocks(batches, "text"):
            ids, ends = coder.block(buf, offs)
            ids = np.insert(ids, ends[1:], np.uint32(end_id)).astype("<u4")
            counts = np.diff(ends) + 1
            begins = np.cumsum(counts) - counts
            n = -(-counts // size)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = piece * size
            length = np.minimum(size, np.repeat(counts, n) - start)
            at = np.repeat(begins, n) + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows.column(0).to_numpy(), n)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(cut, PIECES)


class Packing:
    """Bins of item numbers, and the room left in each."""

    def __init__(self, lengths: list[int], size: int) -> None:
        self.lengths, self.size, self.bins, self.left = lengths, size, [], []

    def add_bins(self, bins: list[list[int]]) -> None:
        for b in bins:
            self.bins.append(list(b))
            self.left.append(self.size - sum(self.lengths[i] for i in b))

    def best_fit(self, items: list[int]) -> "Packing":
        """Each item into the bin that it leaves least room in, else into a new one."""
        free = sorted((room, k) for k, room in enumerate(self.left) if room)
        for i in items:
            need = self.lengths[i]
            at = bisect_left(free, (need, -1))
            if at < len(free):
                room, k = free.pop(at)
                self.bins[k].append(i)
            else:
                room, k = self.size, len(self.bins)
                self.bins.append([i])
                self.left.append(room)
            self.left[k] = room - need
            if room > need:
                insort(free, (room - need, k))
        return self

    def score(self) -> tuple[int, float]:
        return -len(self.bins), sum((1 - r / self.size) ** 2 for r in self.left)

    def assigned(self) -> np.ndarray:
        out = np.zeros(len(self.lengths), np.int32)
        for k, b in enumerate(self.bins):
            out[b] = k
        return out


def from_assigned(lengths: list[int], assigned: np.ndarray, size: int) -> Packing:
    p = Packing(lengths, size)
    bins: list[list[int]] = [[] for _ in range(int(assigned.max()) + 1 if len(assigned) else 0)]
    for i, k in enumerate(assigned.tolist()):
        bins[k].append(i)
    p.add_bins(bins)
    return p


def least_bins(lengths: list[int], size: int) -> int:
    """A lower bound: for each length a, items beyond size - a fill a bin alone, and those of at least a need the room beside the larger half."""
    x = np.sort(np.asarray(lengths, np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    a = np.concatenate([[0], np.unique(x[x <= size // 2])])
    from_, half, alone = np.searchsorted(x, a), np.searchsorted(x, size // 2, "right"), np.searchsorted(x, size - a, "right")
    beside = (alone - half) * size - (total[alone] - total[half])
    return int((len(x) - half - (len(x) - alone) + (len(x) - alone) + np.maximum(0, -(-(total[half] - total[np.minimum(from_, half)] - beside) // size))).max(initial=0))


def replaced(p: Packing, items: list[int]) -> list[int]:
    """Puts displaced items in the place of one or two smaller ones where that fills a bin better; returns what is displaced then."""
    lengths = p.lengths
    free = sorted((lengths[i], i) for i in items)
    for k in range(len(p.bins)):
        if not p.left[k] or not free:
            continue
        b, room = p.bins[k], p.left[k]
        best: tuple[int, list[int], list[int]] = (0, [], [])  # gain, places in free, items of the bin
        outs = [[i] for i in b] + [[i, j] for at, i in enumerate(b) for j in b[at + 1 :]] if len(b) <= 12 else [[i] for i in b]
        for out in outs:
            gone = sum(lengths[i] for i in out)
            most = gone + room
            at = bisect_left(free, (most + 1, -1)) - 1
            if at >= 0 and free[at][0] - gone > best[0]:
                best = (free[at][0] - gone, [at], out)
            lo, hi = 0, min(at, len(free) - 1)
            while lo < hi and best[0] < room:  # the two whose sum comes nearest
                two = free[lo][0] + free[hi][0]
                if two > most:
                    hi -= 1
                else:
                    if two - gone > best[0]:
                        best = (two - gone, [lo, hi], out)
                    lo += 1
            if best[0] == room:
                break
        if best[0]:
            new = [free[j][1] for j in best[1]]
            for j in sorted(best[1], reverse=True):
                del free[j]
            p.bins[k] = [i for i in b if i not in best[2]] + new
            p.left[k] = room - best[0]
            for i in best[2]:
                insort(free, (lengths[i], i))
    return [i for _, i in free]


def crossover(giver: Packing, taker: Packing, rng: np.random.Generator) -> Packing:
    order = np.argsort(giver.left, kind="stable")
    share = order[: max(1, len(order) // 2)]
    injected = [giver.bins[k] for k in share[rng.random(len(share)) < 0.5]]
    inside = np.zeros(len(giver.lengths), bool)
    for b in injected:
        inside[b] = True
    kept, displaced = [], []
    for b in taker.bins:
        if inside[b].any():
            displaced += [i for i in b if not inside[i]]
        else:
            kept.append(b)
    # the loosest of what is left are opened too, and a few others, so that their documents can move
    child = Packing(giver.lengths, giver.size)
    child.add_bins(injected + kept)
    loose = sorted(range(len(child.bins)), key=lambda k: -child.left[k])[: max(1, len(child.bins) // 50)]
    gone = {k for k in loose if child.left[k] > 0} | set(rng.integers(0, len(child.bins), max(1, len(child.bins) // 50)).tolist())
    displaced += [i for k in gone for i in child.bins[k]]
    child.bins, child.left = [b for k, b in enumerate(child.bins) if k not in gone], [r for k, r in enumerate(child.left) if k not in gone]
    return child.best_fit(sorted(replaced(child, displaced), key=lambda i: -child.lengths[i]))


def evolve(lengths: list[int], size: int, given: list[Packing], seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
    """The best packing found; stops at the lower bound.  lengths: descending."""
    rng = np.random.default_rng(seed)
    least = least_bins(lengths, size)
    group = list(given) or [Packing(lengths, size).best_fit(list(range(len(lengths))))]
    while len(group) < population and -max(p.score() for p in group)[0] > least:
        noise = np.array(lengths) * rng.uniform(0.8, 1.0, len(lengths))
        group.append(Packing(lengths, size).best_fit(np.argsort(-noise, kind="stable").tolist()))
    for _ in range(generations):
        group.sort(key=Packing.score, reverse=True)
        if len(group[0].bins) <= least or len(group) < 2:
            break
        a, b = rng.choice(len(group), 2, replace=False)
        group[-1] = max(group[-1], crossover(group[min(a, b)], group[max(a, b)], rng), key=Packing.score)
    return max(group, key=Packing.score)


def _round(items: DataFrame, size: int, number: int, block_pieces: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """Packs one round's pieces: their columns, sequence_id, offset and the sequence's fill."""
    n = items.count()
    blocks = max(1, -(-n // block_pieces))
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(number)), F.lit(blocks)))

    names = [x.split()[0] for x in EVOLVED.split(", ")]

    def row(block: int, island: int, epoch: int, lengths: list[int], best: Packing) -> pd.DataFrame:
        return pd.DataFrame([(block, island, epoch, len(best.bins), least_bins(lengths, size), best.score()[1], np.array(lengths, np.int32).tobytes(), best.assigned().tobytes())], columns=names)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = sorted(pdf.length.tolist(), reverse=True)
        return row(int(pdf.block.iloc[0]), 0, 0, lengths, Packing(lengths, size).best_fit(list(range(len(lengths)))))

    def later(epoch: int):
        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            block, island = int(pdf.block.iloc[0]), int(pdf.island.iloc[0])
            lengths = np.frombuffer(pdf.lengths.iloc[0], np.int32).tolist()
            given = [from_assigned(lengths, np.frombuffer(a, np.int32), size) for a in pdf.assigned]
            return row(block, island, epoch, lengths, evolve(lengths, size, given, (block * 31 + island) * 31 + epoch, generations=generations))

        return step

    start = written(items.select("block", "length").groupBy("block").applyInPandas(first, EVOLVED), "best-fit")
    found, open_ = start, start.where("bins > least")
    if open_.limit(1).count():
        elite = open_.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        for epoch in range(epochs):
            migrants = elite.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
            group = elite.union(migrants) if epoch else elite
            elite = written(group.groupBy("block", "island").applyInPandas(later(epoch + 1), EVOLVED), "elite")
        found = start.union(elite)
    best = found.groupBy("block").agg(F.max_by("assigned", F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("assigned"))

    def place(key: tuple, pdf: pd.DataFrame, sol: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins = np.frombuffer(sol.assigned.iloc[0], np.int32).astype(np.int64)
        length = pdf.length.to_numpy()
        order = np.argsort(bins, kind="stable")
        running = np.cumsum(length[order]) - length[order]
        fill = np.bincount(bins, length).astype(np.int64)
        begins = np.cumsum(fill) - fill
        offset = np.empty(len(pdf), np.int64)
        offset[order] = running - begins[bins[order]]
        return pdf.drop(columns="block").assign(sequence_id=((int(key[0]) * 8 + number) << 20) + bins, offset=offset, fill=fill[bins])

    return items.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, PIECES + ", sequence_id long, offset long, fill long")


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, skip_blanks: bool = True, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, loose: float = LOOSE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Null texts are empty ones: the end id alone.  Rows with a null id are left out, repeated ids are packed once a row,
    other columns are ignored, an empty table gives none.  Pieces of full length are sequences of their own; the
    pieces of sequences filled less than `loose` are packed once more, across blocks.
    """
    rows = written(pieces(docs, vocabulary, size, skip_blanks, end_id, doc_id, text), "pieces")
    whole = rows.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    once = written(_round(rows.where(F.col("length") < size), size, 0, block_pieces, islands, epochs, generations), "packed")
    again = _round(once.where(F.col("fill") < loose * size).select(*rows.columns), size, 1, block_pieces, islands, epochs, generations)
    cols = [*rows.columns, "sequence_id", "offset"]
    return once.where(F.col("fill") >= loose * size).select(*cols).union(again.select(*cols)).union(whole.select(*cols))
