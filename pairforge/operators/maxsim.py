"""Late-interaction scores: the mean of each token's best match on the other side, both ways.

All pairs are scored in blocks: each side is packed into blocks of bounded size, one row each and written once; a Cartesian product passes
each pair of blocks to a task, so no block is shuffled once for each partner.  A task holds one block of each side and scores them tile by
tile.  What a block yields is either its pairs, or, for measures, sums by query.  Counts and maxima need most scores only roughly: these are
worked out in single precision, and exactly where that does not settle the comparison.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairforge.functions.shared import settled
from pairforge.functions.vectors import dot, norm

BLOCK, MOST_BUCKETS = 512, 1 << 18  # items of a block; bucket sizes that are broadcast, at most 16 bytes each
EMPTY = -1e4
TILE = 64, 128  # items of both sides whose token products are held together: a MB or so
WIDE = 2048  # items of a block where scores are rough
ROUGH_TILE = 128, 256
NEAR_PAIRS = 1 << 14  # exact scores of chosen pairs at once: a few MB
FILE_BLOCKS, FILES = 4, 16  # blocks that a task packs at most, and files of a side that there should be before it packs more than one
ALL_BLOCKS, TURNS = 32, 8  # blocks of a file that is read as a whole by every task, and tasks for each core that there should be before one takes more
ROW_BYTES = 256 << 20  # of whole rows of scores that a task holds; one row at least
UNITS, WITHIN = 1e9, 1.05  # scores of 9 decimals are whole numbers of 32 bits where tokens are no longer than this (as the product of the longest)


def nested(a: Column, b: Column) -> Column:
    """The score of one pair of token arrays, inside the JVM."""

    def side(x: Column, y: Column) -> Column:
        best = F.transform(x, lambda u: F.coalesce(F.array_max(F.transform(y, lambda v: dot(u, v))), F.lit(EMPTY)))
        return F.aggregate(best, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(x), F.lit(1))

    return 0.5 * (side(a, b) + side(b, a))


def block_matrix(left: list, right: list) -> np.ndarray:
    """Scores of every item of left with every item of right; items are lists of token vectors."""
    flat = lambda items: np.concatenate([np.stack(x) for x in items if len(x)]).astype(float, copy=False) if any(map(len, items)) else np.zeros((0, 1))
    return _matrix(*((flat(items), np.array([len(x) for x in items], np.int64)) for items in (left, right)))


def _matrix(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Scores of items given as (all token vectors, tokens of each item)."""
    (x, n), (y, m) = left, right
    if _alike(n) and _alike(m):
        return _even(x, y, int(n[0]), int(m[0]))
    out = np.where((n[:, None] > 0) != (m[None, :] > 0), EMPTY / 2, 0.0)
    a, b = np.flatnonzero(n), np.flatnonzero(m)
    if len(a) and len(b):
        s = x @ y.T
        xs, ys = np.cumsum(n[a]) - n[a], np.cumsum(m[b]) - m[b]
        one = np.add.reduceat(np.maximum.reduceat(s, ys, axis=1), xs, axis=0) / n[a][:, None]
        two = np.add.reduceat(np.maximum.reduceat(s, xs, axis=0), ys, axis=1) / m[b][None, :]
        out[np.ix_(a, b)] = 0.5 * (one + two)
    return out


def _alike(n: np.ndarray) -> bool:
    return bool(len(n) and n[0] > 0 and (n == n[0]).all())


def _planes(z: np.ndarray, k: int, wide: int) -> list[tuple[int, np.ndarray]]:
    """(first item, its tokens as (k, items, dimensions)) of each `wide` items: first tokens first."""
    z = z.reshape(len(z) // k, k, -1)
    return [(i, np.ascontiguousarray(z[i : i + wide].transpose(1, 0, 2))) for i in range(0, len(z), wide)]


class _Tiles:
    """Scores where all items of a side have as many tokens, tile by tile: a plane of products for each pair of tokens, so that maxima run over
    whole planes that stay in a core's own cache."""

    def __init__(self, p: int, r: int, tile: tuple[int, int], dtype: np.dtype):
        self.p, self.r = p, r
        self.room = [np.empty(k * tile[0] * tile[1], dtype) for k in (p * r, p, r)]
        self.cut: dict[tuple[int, int], tuple] = {}

    def _cut(self, a: int, b: int) -> tuple:
        """Room for a tile of a by b items: all products, and what `_most` needs for either side."""
        p, r = self.p, self.r
        s, one, two = (v[: k * a * b] for v, k in zip(self.room, (p * r, p, r), strict=True))
        planes, one, two = s.reshape(r, p, a * b), one.reshape(p, a * b), two.reshape(r, a * b)
        return s.reshape(r, p * a, b), ((list(planes), one, list(one)), (list(planes.transpose(1, 0, 2)), two, list(two))), one[0].reshape(a, b)

    def score(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Of one tile; good until the next call."""
        a, b = row.shape[1], column.shape[2]
        if (a, b) not in self.cut:
            self.cut[a, b] = self._cut(a, b)
        s, sides, out = self.cut[a, b]
        np.matmul(row.reshape(self.p * a, -1), column, out=s)
        for planes, most, tokens in sides:
            if len(planes) > 1:
                np.maximum(planes[0], planes[1], out=most)
            else:
                np.copyto(most, planes[0])
            for v in planes[2:]:
                np.maximum(most, v, out=most)
            for v in tokens[1:]:
                tokens[0] += v
            if (n := len(tokens)) & (n - 1):
                tokens[0] /= n
            else:
                tokens[0] *= 1 / n
        out += sides[1][2][0].reshape(a, b)
        out *= 0.5
        return out


def _even(x: np.ndarray, y: np.ndarray, p: int, r: int, tile: tuple[int, int] = TILE) -> np.ndarray:
    """The same where all items of a side have as many tokens."""
    out = np.empty((len(x) // p, len(y) // r), x.dtype)
    tiles, columns = _Tiles(p, r, tile, x.dtype), [(j, v.transpose(0, 2, 1)) for j, v in _planes(y, r, tile[1])]
    for i, row in _planes(x, p, tile[0]):
        for j, column in columns:
            out[i : i + row.shape[1], j : j + column.shape[2]] = tiles.score(row, column)
    return out


class Rough:
    """Scores of two blocks: `s` lies within `slack` of the exact scores of 9 decimals, `exact` gives these for chosen pairs.

    Single precision errs by at most (dimensions + tokens + 8) / 2^24 of the product of the longest vectors; twice that is allowed for.  Where
    token counts differ, or vectors are longer than 10^6 or not finite, all scores are exact from the start; so they are once too many are asked for.
    """

    def __init__(self, left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]):
        self.left, self.right, self.slack = left, right, 2e-9
        self._s: np.ndarray | None = None
        self.plain = _alike(left[1]) and _alike(right[1])
        if self.plain:
            longest = [float(np.sqrt(np.einsum("ij,ij->i", v, v).max())) for v, _ in (left, right)]
            self.plain = all(k <= 1e6 for k in longest)
        if self.plain:
            self.p, self.r = int(left[1][0]), int(right[1][0])
            self.rough = 2 * (left[0].shape[1] + self.p + self.r + 8) * 2.0**-24 * longest[0] * longest[1]

    @property
    def s(self) -> np.ndarray:
        if self._s is None:
            if self.plain:
                self._s = _even(self.left[0].astype(np.float32), self.right[0].astype(np.float32), self.p, self.r, ROUGH_TILE)
                self.slack += self.rough
            else:
                self._s = np.round(_matrix(self.left, self.right), 9)
        return self._s

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The scores of the pairs (i, j), each from its own tokens alone: the same wherever the two meet."""
        if not self.plain:
            return self.s[i, j]
        out = np.empty(len(i))
        x, y = (v.reshape(len(n), -1, v.shape[1]) for v, n in (self.left, self.right))
        for lo in range(0, len(i), NEAR_PAIRS):
            one, two = x[i[lo : lo + NEAR_PAIRS]], y[j[lo : lo + NEAR_PAIRS]]
            s = np.matmul(one, two.transpose(0, 2, 1))
            out[lo : lo + NEAR_PAIRS] = np.round(0.5 * (s.max(2).sum(1) / self.p + s.max(1).sum(1) / self.r), 9)
        return out

    def beyond(self, limit: np.ndarray, axis: int, reached: bool, skip: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """How many scores of each row (axis 1) or column (axis 0) are above its limit or, if `reached`, at it.

        skip(i, j): pairs that do not count; they must not lie above the limit, so that it is asked only where a score is near it.
        """
        s, at = self.s, (slice(None), None) if axis == 1 else (None, slice(None))
        low, high = (np.nextafter((limit + k * self.slack).astype(s.dtype), s.dtype.type(k * np.inf))[at] for k in (-1, 1))
        sure, maybe = s > high, s >= low
        count = _true_by(sure, axis)
        i, j = np.nonzero(np.greater(maybe, sure, out=maybe))
        if len(i):
            v, mine = self.exact(i, j), (j, i)[axis]
            yes = (v >= limit[mine] if reached else v > limit[mine]) & ~skip(i, j)
            count += np.bincount(mine[yes], minlength=len(limit))
        return count

    def best(self, mask: np.ndarray, axis: int) -> np.ndarray:
        """The best score of each row (axis 1) or column (axis 0) among the pairs of mask; -inf without any."""
        s = np.where(mask, self.s, self.s.dtype.type(-np.inf))
        top = s.max(axis).astype(float)
        out = np.full(len(top), -np.inf)
        low = np.nextafter((top - 2 * self.slack).astype(s.dtype), s.dtype.type(-np.inf))
        i, j = np.nonzero((s >= (low[:, None] if axis == 1 else low[None, :])) & mask)
        np.maximum.at(out, (j, i)[axis], self.exact(i, j))
        return out


def _true_by(m: np.ndarray, axis: int) -> np.ndarray:
    """How many of each row (axis 1) or column (axis 0) are true, in sums of bytes for columns."""
    if axis == 1:
        return np.fromiter(map(np.count_nonzero, m), np.int64, len(m))
    out = np.zeros(m.shape[1], np.int64)
    for lo in range(0, len(m), 255):
        out += np.add.reduce(m[lo : lo + 255].view(np.uint8), axis=0, dtype=np.uint8)
    return out


def codes(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the values of a and of b, equal where these are; null equals nothing."""
    both = pd.factorize(pd.concat([a, b], ignore_index=True))[0].astype(np.int32)
    return np.where(both[: len(a)] < 0, -2, both[: len(a)]), both[len(a) :]


def matches(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Which values of a equal which of b."""
    one, two = codes(a, b)
    return one[:, None] == two[None, :]


def _packed(df: DataFrame, block: int, rows: int, keys: list[str], most: int = FILE_BLOCKS, files: int = FILES) -> DataFrame:
    """(key, no, items): blocks of at most `block` rows as Arrow bytes, written once; with `keys` only rows of equal keys share one, and key is the first key."""
    blocks = -(-rows // block)
    parts = max(1, -(-blocks // max(1, min(most, blocks // files))))
    dealt = df.repartition(parts, *keys).sortWithinPartitions(*keys) if keys else df.repartition(parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0

        def packed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            whole = whole.sort_by(whole.column_names[0]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as out:
                out.write_table(whole)
            return pa.RecordBatch.from_arrays([pa.array([now[0] if now else 0], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["key", "items"])

        for batch in batches:
            at = [batch.column(k).to_numpy() for k in keys]
            rest, cuts = batch.drop_columns(keys) if keys else batch, np.zeros(max(0, batch.num_rows - 1), bool)
            for v in at:
                cuts |= v[1:] != v[:-1]
            edges = [0, *(np.flatnonzero(cuts) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                key = tuple(int(v[lo]) for v in at)
                if held and key != now:
                    yield packed()
                    held, n = [], 0
                now = key
                while lo < hi:
                    held.append(rest.slice(lo, block - n))
                    n += held[-1].num_rows
                    lo += held[-1].num_rows
                    if n == block:
                        yield packed()
                        held, n = [], 0
        if held:
            yield packed()

    blocks = dealt.mapInArrow(pack, "key long, items binary").select("key", F.monotonically_increasing_id().alias("no"), "items")
    return settled(blocks, "blocks")


def _opened(raw: bytes, columns: bool = True) -> tuple[pd.DataFrame | None, tuple[np.ndarray, np.ndarray]]:
    """A block's columns without tokens, if asked for, and its tokens."""
    rows = pa.ipc.open_stream(raw).read_all().combine_chunks()
    lists = rows.column("tokens").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.list_(pa.float64())))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = lists.flatten()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return rows.drop_columns(["tokens"]).to_pandas() if columns else None, (flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1)), count)


def _met(a: DataFrame, b: DataFrame, near: bool) -> DataFrame:
    """(no, x, y, other): each pair of blocks, with their numbers, of equal keys if near; a Cartesian product reads the written blocks again and shuffles none."""
    a, b = a.select(F.col("key").alias("_a"), "no", F.col("items").alias("x")), b.select(F.col("key").alias("_b"), F.col("no").alias("other"), F.col("items").alias("y"))
    b = b.hint("shuffle_replicate_nl")
    return (a.join(b, F.col("_a") == F.col("_b")) if near else a.crossJoin(b)).select("no", "x", "y", "other")


def _by_file(df: DataFrame) -> DataFrame:
    """df, which is read from files, with a partition for each of them: Spark puts files into one only where there are more than cores."""
    spark, files = df.sparkSession, sorted(map(unquote, df.inputFiles()))
    some = spark.sparkContext.defaultParallelism
    parts = [spark.read.schema(df.schema).parquet(*files[k : k + some]) for k in range(0, len(files), some)]
    return functools.reduce(DataFrame.union, parts, parts.pop(0)) if parts else df


def _yielded(schema: str) -> Callable[[pd.DataFrame], pa.RecordBatch]:
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    return lambda df: pa.RecordBatch.from_pandas(df, schema=kinds, preserve_index=False)


def all_pairs(left: DataFrame, right: DataFrame, reduce: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray | Rough], pd.DataFrame], schema: str, block: int | None = None, near: tuple[str, str] | None = None, *, rough: bool = False) -> DataFrame:
    """`reduce` over each pair of blocks of left and right, which have a column `tokens`; it gets their other columns and the scores, both
    ascending by the first column.

    near: a column of each side; then only blocks meet whose rows lie in one bucket of these values, so that rows of equal values meet at a
    small part of the cost.  A bucket with any share of the rows is as many blocks.
    rough: `reduce` gets the scores as a `Rough`; blocks are larger then.
    """
    block = block or (WIDE if rough else BLOCK)
    left, right = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (left, right))  # both sides may come from one table
    rows = [df.count() for df in (left, right)]
    keys: list[str] = []
    if near is not None:
        n = max(1, -(-max(rows) // block))
        keys = ["_b", "_part"]

        def dealt(df: DataFrame, c: str) -> DataFrame:
            df = df.withColumn("_b", F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(n)))
            sizes = settled(df.groupBy("_b").agg(F.ceil(F.count("*") / block).alias("_n")), "bucket-sizes")
            sizes = F.broadcast(sizes) if n <= MOST_BUCKETS else sizes
            return df.join(sizes, "_b").withColumn("_part", F.pmod(F.xxhash64(*df.columns[:1]), F.col("_n"))).select(*df.columns, "_part")

        left, right = (dealt(df, c) for df, c in zip((left, right), near, strict=True))
    a, b = (_packed(df, block, n, keys) for df, n in zip((left, right), rows, strict=True))
    batch_of = _yielded(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, mine = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                if (no := batch.column(0)[k].as_py()) != now:
                    now, (x, mine) = no, _opened(batch.column(1)[k].as_buffer())
                y, other = _opened(batch.column(2)[k].as_buffer())
                yield batch_of(reduce(x, y, Rough(mine, other) if rough else np.round(_matrix(mine, other), 9)))

    return _met(a, b, near is not None).mapInArrow(score, schema)


def _evenly(df: DataFrame) -> tuple[int, int, float]:
    """Rows, the tokens that each of them has (0: not all have as many, or none has), and the length of the longest token (inf or nan: not known)."""
    unknown = F.lit(float("inf"))
    n, longest = F.coalesce(F.size("tokens"), F.lit(0)), F.array_max(F.transform("tokens", lambda v: F.coalesce(norm(v), unknown)))
    r = df.agg(F.count("*").alias("rows"), F.min(n).alias("least"), F.max(n).alias("most"), F.max(F.coalesce(longest, unknown)).alias("longest")).first()
    return r.rows, r.most if r.rows and r.least == r.most > 0 else 0, r.longest if r.rows else 0.0


def all_rows(left: DataFrame, right: DataFrame, reduce: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """`reduce` over each block of left and all rows of right, with whole rows of scores: right passes by each block of left, block by block.

    Scores are whole numbers of 1 / UNITS, of 32 bits, where all items of a side have as many tokens and none is longer than WITHIN; else they are
    doubles.  A task holds the scores of one block of left, at most ROW_BYTES or one row: the more rows right has, the smaller these blocks.  Scores are
    never shuffled or written.
    """
    left, right = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (left, right))
    (n, p, one), (m, r, two) = (_evenly(df) for df in (left, right))
    kind = np.dtype(np.int32 if p and r and one * two <= WITHIN else float)
    high = max(1, min(block, ROW_BYTES // (kind.itemsize * max(1, m))))
    high -= high % TILE[0] if high > TILE[0] else 0  # no narrow last tile
    a = _packed(left, high, n, [], files=TURNS * left.sparkSession.sparkContext.defaultParallelism)
    b = _packed(right, BLOCK, m, [], ALL_BLOCKS, 1)
    batch_of = _yielded(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x, mine, rows, s, at = None, None, None, [], None, 0
        tiles = _Tiles(p, r, TILE, np.dtype(float)) if kind == np.int32 else None
        columns, met, whole = {}, [], ([], pd.DataFrame())  # right's columns by block; the blocks that s has; those that were last put together

        def reduced() -> pa.RecordBatch:
            nonlocal whole
            if whole[0] != met:
                whole = met, pd.concat([columns[k] for k in met], ignore_index=True)
            return batch_of(reduce(x, whole[1], s[:, :at]))

        for batch in batches:
            for k in range(batch.num_rows):
                if (no := batch.column(0)[k].as_py()) != now:
                    if now is not None:
                        yield reduced()
                    now, (x, mine), met, at = no, _opened(batch.column(1)[k].as_buffer()), [], 0
                    rows = _planes(mine[0], p, TILE[0]) if tiles else []
                    if s is None or len(s) != len(x):
                        s = np.empty((len(x), m), kind)
                other = batch.column(3)[k].as_py()
                y, theirs = _opened(batch.column(2)[k].as_buffer(), other not in columns)
                if y is not None:
                    columns[other] = y
                met.append(other)
                size = len(theirs[1])
                if tiles:
                    for j, column in _planes(theirs[0], r, TILE[1]):
                        column = column.transpose(0, 2, 1)
                        for i, row in rows:
                            v = tiles.score(row, column)
                            v *= UNITS
                            s[i : i + v.shape[0], at + j : at + j + v.shape[1]] = np.rint(v, out=v)
                else:
                    s[:, at : at + size] = np.round(_matrix(mine, theirs), 9)
                at += size
        if now is not None:
            yield reduced()

    met = _met(_by_file(a), b.coalesce(1).withColumn("no", F.monotonically_increasing_id()), False)  # numbers from 0 in the one partition
    return met.withColumn("x", F.when(F.col("other") == 0, F.col("x"))).mapInArrow(score, schema)  # x need not pass by again with each block of right


def scores(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(q, c, score) of all pairs.  left: q, tokens; right: c, tokens."""

    def pairs(x: pd.DataFrame, y: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"q": np.repeat(x.q.to_numpy(), len(y)), "c": np.tile(y.c.to_numpy(), len(x)), "score": s.ravel()})

    return all_pairs(left, right, pairs, "q long, c long, score double", block)
