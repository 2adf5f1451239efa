"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact rerank.

Vectors are unit vectors here, so a cosine of at least c is a distance of at most r = sqrt(2 - 2c).  The probes and the
distance test use bounds instead of guesses, so that no pair is lost: a list is probed unless the query lies farther than r
behind the plane that separates the list's centroid from the nearest one; a code is passed on to the exact cosine
unless its table distance exceeds r by more than that vector's own quantisation error.  A list that grew long is cut
once more, by centroids of its own and the same bound, so lists need not grow where the first centroids are too few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.shared import positions
from pairforge.llm.common import components, discard, forest, lean, small_side, written

COSINE, LIST_ROWS, MOST_LISTS, SAMPLE, PARTS, WORDS, BLOCK_ROWS = 0.98, 1000, 4096, 16384, 8, 256, 2048
SALT_ROWS = 1 << 16  # of a long list, rows and queries that one task deals out
SENT = 4096  # rows of a batch that queries make
ROWS = "label long, list int, sub int, block int, kind int, id long, copies long, error double, codes binary, vector binary"
ROWS_CUT = ROWS.replace("label long, list int, sub int, block int,", "sub int, label long, list int,")
OUT = "kind int, a long, b long"
BROADCAST_BYTES, SAMPLE_BYTES = 16 << 20, 64 << 20


def k_means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k centres of x, from evenly spread rows; empty ones keep their place."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norm, step = (centres**2).sum(1), max(1, (1 << 22) // len(centres))
    return np.concatenate([np.argmin(norm - 2 * (x[lo : lo + step] @ centres.T), axis=1) for lo in range(0, max(1, len(x)), step)])


class Cells:
    """Centroids, the list of each vector, and the lists that it must visit."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids

    def gaps(self, lists: np.ndarray) -> np.ndarray:
        """Distances of the given lists' centroids from all; worked out as they are needed, so that no table of all pairs is kept or sent."""
        some, norm = self.centroids[lists], (self.centroids**2).sum(1)
        return np.sqrt(np.maximum(norm[lists][:, None] + norm[None] - 2 * (some @ self.centroids.T), 0))

    def probes(self, x: np.ndarray, radius: float) -> np.ndarray:
        """Which lists each unit vector must visit to meet every vector within the radius."""
        square = (self.centroids**2).sum(1) - 2 * (x @ self.centroids.T)
        best = square.argmin(1)
        lists, back = np.unique(best, return_inverse=True)
        return square - square[np.arange(len(x)), best][:, None] <= 2 * radius * self.gaps(lists)[back] + 1e-6


class Quantiser(Cells):
    """Coarse centroids and, for residuals, a codebook for each subspace.  Fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int = PARTS, words: int = WORDS) -> None:
        super().__init__(k_means(sample, min(lists, len(sample))))
        residual = sample - self.centroids[nearest(sample, self.centroids)]
        self.edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.books = [k_means(residual[:, a:b], min(words, len(sample))) for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, quantisation error) of unit vectors."""
        at = nearest(x, self.centroids)
        residual = x - self.centroids[at]
        codes = np.stack([nearest(residual[:, a:b], book) for a, b, book in self._parts()], axis=1).astype(np.uint8)
        back = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return at, codes, np.sqrt(((residual - back) ** 2).sum(1))

    def _parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        return zip(self.edges, self.edges[1:], self.books, strict=False)

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Distance of each unit vector x to each code of list `at`, from tables of the subspaces' distances."""
        residual = x - self.centroids[at]
        total = np.zeros((len(x), len(codes)))
        for m, (a, b, book) in enumerate(self._parts()):
            table = ((residual[:, a:b, None] - book.T[None]) ** 2).sum(1)
            total += table[:, codes[:, m]]
        return np.sqrt(total)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _vectors(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _cut(dealt: DataFrame, radius: float, list_rows: int, block_rows: int, sample: int) -> DataFrame:
    """`dealt`, whose files go if it has such lists, with a column `sub`: 0, but in lists of more than `block_rows` rows the list of a second level.

    Each such list has centroids of its own, fitted on about `sample` of its rows at most; its rows and queries are dealt out in
    parts of about SALT_ROWS, to each of which the centroids travel first.
    """
    long = dealt.where("list >= 0").groupBy("label", "list").agg(F.count_if(F.col("kind") == 0).alias("n"), F.count("*").alias("all")).where(F.col("n") > block_rows)
    subs, salts = F.least(F.ceil(F.col("n") / list_rows), F.lit(MOST_LISTS)).cast("int"), F.ceil(F.col("all") / SALT_ROWS).cast("int")
    long = written(long.select("label", "list", "n", subs.alias("subs"), salts.alias("salts")), "long-lists")
    if not long.limit(1).count():
        return dealt.withColumn("sub", F.lit(0))
    marked = dealt.join(small_side(long, BROADCAST_BYTES), ["label", "list"], "left")
    columns = ["label", "list", "kind", "id", "copies", "error", "codes", "vector"]
    rest = marked.where("subs is null").withColumn("sub", F.lit(0)).select("sub", *columns)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(_vectors(pdf.sort_values("id").vector.tolist()))
        return pd.DataFrame({"label": pdf.label[:1], "list": pdf.list[:1], "vector": [k_means(x, min(int(pdf.subs.iloc[0]), len(x))).tobytes()]})

    some = marked.where((F.col("kind") == 0) & (F.pmod(F.xxhash64("id", F.lit(7)), F.col("n")) < F.least(4 * F.col("subs"), F.lit(sample))))
    centres = some.select("label", "list", "id", "subs", "vector").groupBy("label", "list").applyInPandas(fit, "label long, list int, vector binary")
    first = written(centres, "centres").join(long.select("label", "list", "salts"), ["label", "list"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    first = first.select("salt", "label", "list", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("copies"), F.lit(0.0).alias("error"), F.lit(None).cast("binary").alias("codes"), "vector")
    rows = marked.where("subs is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).select("salt", *columns)
    work = rows.union(first).repartition("label", "list", "salt").sortWithinPartitions("label", "list", "salt", "kind")

    @lean
    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells = None, None

        def batch_of(sub: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sub, pa.int32()), *(part.column(c) for c in columns)], names=["sub", *columns])

        for batch in batches:
            salt, label, at, kind = (batch.column(k).to_numpy() for k in range(4))
            new = np.ones(len(salt), bool)
            new[1:] = (salt[1:] != salt[:-1]) | (label[1:] != label[:-1]) | (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])
            edges = np.flatnonzero(new).tolist()
            for lo, hi in zip(edges, [*edges[1:], len(salt)], strict=True):
                if (now := (label[lo], at[lo], salt[lo])) != key:
                    key, cells = now, None
                if kind[lo] == -1:
                    cells = np.frombuffer(batch.column(8)[lo].as_py(), np.float64)
                    continue
                for k in range(lo, hi, 256):
                    part = batch.slice(k, min(256, hi - k))
                    if cells is None:  # no row of the list was drawn
                        yield batch_of(np.zeros(part.num_rows, np.int32), part)
                        continue
                    x = _vectors(part.column(8).to_pylist())
                    if not isinstance(cells, Cells):
                        cells = Cells(cells.reshape(-1, x.shape[1]))
                    if kind[lo] == 0:
                        yield batch_of(nearest(_unit(x), cells.centroids), part)
                        continue
                    q, to = np.nonzero(cells.probes(_unit(x), radius))
                    for n in range(0, len(q), SENT):
                        yield batch_of(to[n : n + SENT], part.take(pa.array(q[n : n + SENT])))

    order = ["sub", *columns]
    out = written(rest.select(*order).union(work.mapInArrow(refine, ROWS_CUT).select(*order)), "cut-lists")
    discard(dealt)
    return out


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with labels as whole numbers, equal for equal labels only; labels of types other than whole numbers are numbered by value."""
    if isinstance(rows.schema["label"].dataType, T.IntegralType):
        return rows.withColumn("label", F.col("label").cast("long"))
    numbers = positions(rows.where("label is not null").select("label").distinct(), ["label"], name="number")
    return rows.join(small_side(written(numbers, "labels"), BROADCAST_BYTES), "label").select("id", "v", F.col("number").alias("label"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, list_rows: int = LIST_ROWS, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors of equal, not null labels and equal length are linked when their cosine in double precision is at least
    `cosine`.  Null, empty and zero vectors, and such with null or non-finite components, link with nothing.  Rows with
    a null id are left out; rows that repeat an id count as vectors and give a row each; other columns are ignored; an empty table gives none.
    `sample` bounds the rows that the quantiser is fitted on, and SAMPLE_BYTES what they take; labels are compared in their own type; every row is indexed and every row is a query.  Vectors of other
    lengths than the most common one are compared exactly, in blocks.
    """
    spark = vectors.sparkSession
    all_ids = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"))
    rows = _numbered(vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label")))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where("id is not null and label is not null and v is not null").where(fine)
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.where((squares > 0) & (squares < float("inf")))
    # equal vectors once: the smallest id stands for its copies
    keyed = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    classes = written(keyed.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    lengths = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = lengths.d if lengths else 0
    usual = classes.where(F.size("v") == width)
    fit = usual.orderBy(F.xxhash64("id"), "id").limit(max(1, min(sample, SAMPLE_BYTES // (8 * width)))).select("v").toArrow() if width else None
    quantiser = None
    if fit is not None and len(fit):
        most = usual.groupBy("label").count().agg(F.max("count")).first()[0]
        x = fit.column(0).combine_chunks().flatten().to_numpy().reshape(-1, width)
        quantiser = Quantiser(_unit(x), min(MOST_LISTS, max(1, math.ceil(most / list_rows))))
    shared = spark.sparkContext.broadcast(quantiser)
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9

    def vectors_of(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(column)
        return np.asarray(lists.offsets).astype(np.int64), lists.values.to_numpy(zero_copy_only=False)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["label", "list", "kind", "id", "copies", "error", "codes", "vector"])

    @lean
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ptr, flat = vectors_of(part, 1)
                labels, ids, copies = (part.column(k).to_numpy() for k in (0, 2, 3))
                out: list[tuple] = []
                same = np.flatnonzero(np.diff(ptr) == width)
                if len(same):
                    x = flat[(ptr[same][:, None] + np.arange(width))]
                    u = _unit(x)
                    at, codes, error = shared.value.encode(u)
                    raw = [r.tobytes() for r in x]
                    out += [(int(labels[i]), int(at[k]), 0, int(ids[i]), int(copies[i]), float(error[k]), codes[k].tobytes(), raw[k]) for k, i in enumerate(same)]
                    q, to = np.nonzero(shared.value.probes(u, radius))
                    for n in range(0, len(q), SENT):
                        yield batch_of([(int(labels[same[k]]), int(t), 1, int(ids[same[k]]), int(copies[same[k]]), 0.0, None, raw[k]) for k, t in zip(q[n : n + SENT].tolist(), to[n : n + SENT].tolist(), strict=True)])
                for i in np.flatnonzero(np.diff(ptr) != width):
                    raw = flat[ptr[i] : ptr[i + 1]].tobytes()
                    out += [(int(labels[i]), -int(ptr[i + 1] - ptr[i]), kind, int(ids[i]), int(copies[i]), 0.0, None, raw) for kind in (0, 1)]
                if out:
                    yield batch_of(out)

    dealt = written(classes.select("label", "v", "id", "copies").mapInArrow(assign, ROWS.replace("sub int, block int, ", "")), "lists")
    dealt = _cut(dealt, radius, list_rows, block_rows, sample)
    # what is longer than block_rows still is dealt out in blocks, and their queries visit each block
    cells = dealt.where("kind = 0").groupBy("label", "list", "sub").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    stored = dealt.where("kind = 0").join(cells, ["label", "list", "sub"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asked = dealt.where("kind = 1").join(cells, ["label", "list", "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    order = [x.split()[0] for x in ROWS.split(", ")]
    work = stored.select(*order).union(asked.select(*order)).repartition("label", "list", "sub", "block").sortWithinPartitions("label", "list", "sub", "block", "kind")

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple] = []
        store: tuple | None = None

        def exact(i: np.ndarray, j: np.ndarray, x: np.ndarray, xn: np.ndarray, y: np.ndarray, yn: np.ndarray) -> np.ndarray:
            ok = np.zeros(len(i), bool)
            for lo in range(0, len(i), 1 << 15):
                a, b = i[lo : lo + (1 << 15)], j[lo : lo + (1 << 15)]
                ok[lo : lo + len(a)] = np.einsum("ij,ij->i", x[a], y[b]) / (xn[a] * yn[b]) >= cosine
            return ok

        def ask(ids: np.ndarray, vectors: list[bytes]) -> Iterator[pa.RecordBatch]:
            y_ids, y_copies, y_error, y_codes, y, yn = store
            x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(ids), -1)
            xn = np.sqrt((x * x).sum(1))
            if key[1] >= 0:
                far = shared.value.distances(x / xn[:, None], key[1], y_codes)
                i, j = np.nonzero(far <= radius + y_error + 1e-9)
            else:
                i, j = np.nonzero(np.ones((len(ids), len(y_ids)), bool))
            ok = exact(i, j, x, xn, y, yn)
            i, j = i[ok], j[ok]
            other = ids[i] != y_ids[j]
            i, j = i[other], j[other]
            if len(i):
                n = np.bincount(i, y_copies[j], len(ids)).astype(np.int64)
                some = np.flatnonzero(n)
                node, root = forest(ids[i], y_ids[j])
                link = node != root
                kinds = np.concatenate([np.zeros(len(some), np.int32), np.ones(int(link.sum()), np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([ids[some], node[link]])), pa.array(np.concatenate([n[some], root[link]]))], names=["kind", "a", "b"])

        for batch in batches:
            cols = [batch.column(k) for k in range(batch.num_columns)]
            labels, lists, subs, blocks, kinds, ids = (cols[k].to_numpy() for k in range(6))
            edges = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (lists[1:] != lists[:-1]) | (subs[1:] != subs[:-1]) | (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])]))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows], strict=True):
                now = (int(labels[lo]), int(lists[lo]), int(subs[lo]), int(blocks[lo]))
                if now != key:
                    key, held, store = now, [], None
                if kinds[lo] == 0:
                    held.append((ids[lo:hi], cols[6].to_numpy()[lo:hi], cols[7].to_numpy()[lo:hi], cols[8].to_pylist()[lo:hi], cols[9].to_pylist()[lo:hi]))
                    continue
                if store is None and held:
                    y_ids, copies, error = (np.concatenate([h[k] for h in held]) for k in range(3))
                    y = np.frombuffer(b"".join(v for h in held for v in h[4]), np.float64).reshape(len(y_ids), -1)
                    codes = np.frombuffer(b"".join(c for h in held for c in h[3]), np.uint8).reshape(len(y_ids), -1) if now[1] >= 0 else None
                    store, held = (y_ids, copies, error, codes, y, np.sqrt((y * y).sum(1))), []
                if store is not None:
                    vectors = cols[9].to_pylist()[lo:hi]
                    for k in range(0, hi - lo, 256):
                        yield from ask(ids[lo + k : min(lo + k + 256, hi)], vectors[k : k + 256])

    found = written(work.mapInArrow(search, OUT), "vector-links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("links"))
    member = written(keyed.join(classes.withColumnRenamed("id", "class"), ["label", "v"]).groupBy(F.col("id").alias("vec_id")).agg(F.min_by(F.struct("class", "copies"), "class").alias("m")).select("vec_id", "m.class", "m.copies"), "members")
    edges = found.where("kind = 1").select("a", "b").union(member.where("vec_id <> class").select("vec_id", "class"))
    roots = components(edges, "a", "b").withColumnRenamed("node", "vec_id")
    counted = member.join(links, "class", "left").select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    out = all_ids.join(counted, "vec_id", "left").join(roots, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
