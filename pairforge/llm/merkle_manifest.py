"""Merkle manifest of a dataset, its authentication paths made by fractal traversal.

Rows are leaves; eight neighbours make a node, group by group (a language, say), and the groups' roots make the dataset's.  Leaves are
numbered across the cluster and cut into aligned blocks of 8**BLOCK_LEVELS.  A block gives one digest upward; the digests of the blocks
are leaves of the next round, until a group has one.  On the way down a task streams a block behind a header with what lies
above it, and a `Traversal` gives the paths of its leaves one after the other: a stack of existing subtrees holds the nodes around the
present leaf, and one desired subtree for each is built a leaf at a time while the existing one is used up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairforge.functions.shared import positions
from pairforge.llm.common import lean, small_side, written

ARITY, BLOCK_LEVELS, SUBTREE_LEVELS = 8, 4, 2
BLOCK = ARITY**BLOCK_LEVELS
PATH = "array<struct<place int, siblings binary>>"
AT_ONCE, BROADCAST_BYTES = 256, 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def combined(digests: Sequence[bytes]) -> bytes:
    """SHA-256 of digests as hex text, one after the other."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def height(n: int) -> int:
    """Levels until n nodes are one."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * ARITY
    return levels


class Subtree:
    """Nodes of the levels [low, high) above a range of leaves, built a leaf at a time.

    Beside those nodes only the unfinished run of each lower level is held.  A range that ends early closes its last runs, so a node alone
    in its run is combined too.
    """

    def __init__(self, leaves: Sequence[bytes], first: int, low: int, high: int) -> None:
        self.leaves, self.low, self.high = leaves, low, high
        self.at, self.end = first, min(first + ARITY**high, len(leaves))
        self.runs: list[list[bytes]] = [[] for _ in range(high)]
        self.kept: list[list[bytes]] = [[] for _ in range(high - low)]
        self.root = b""

    def _add(self, level: int, node: bytes) -> None:
        while level < self.high:
            if level >= self.low:
                self.kept[level - self.low].append(node)
            run = self.runs[level]
            run.append(node)
            if len(run) < ARITY:
                return
            node, self.runs[level] = combined(run), []
            level += 1
        self.root = node

    def step(self) -> None:
        """Takes the next leaf in, if any is left."""
        if self.at >= self.end:
            return
        self._add(0, self.leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for level in range(self.high):
                if self.runs[level]:
                    run, self.runs[level] = self.runs[level], []
                    self._add(level + 1, combined(run))

    def whole(self) -> "Subtree":
        while self.at < self.end:
            self.step()
        return self

    def run_of(self, level: int, leaf: int) -> tuple[int, list[bytes]]:
        """Place of the leaf's ancestor in its run of `level`, and the run."""
        index = leaf // ARITY**level % ARITY ** (self.high - level)
        start = index // ARITY * ARITY
        return index - start, self.kept[level - self.low][start : start + ARITY]


class Traversal:
    """Successive authentication paths of a block's leaves up to `levels` above them."""

    def __init__(self, leaves: Sequence[bytes], levels: int, step: int = SUBTREE_LEVELS) -> None:
        self.leaves = leaves
        self.bounds = [(low, min(low + step, levels)) for low in range(0, levels, step)]
        self.existing = [Subtree(leaves, 0, low, high).whole() for low, high in self.bounds]
        self.desired = [Subtree(leaves, ARITY**high, low, high) for low, high in self.bounds]

    def __iter__(self) -> Iterator[list[tuple[int, bytes]]]:
        for leaf in range(len(self.leaves)):
            path = []
            for tree in self.existing:
                for level in range(tree.low, tree.high):
                    place, run = tree.run_of(level, leaf)
                    path.append((place, b"".join(run[:place] + run[place + 1 :])))
            yield path
            for k, (low, high) in enumerate(self.bounds):
                self.desired[k].step()
                if (leaf + 1) % ARITY**high == 0:
                    self.existing[k] = self.desired[k]
                    self.desired[k] = Subtree(self.leaves, leaf + 1 + ARITY**high, low, high)


def folded(node: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf's digest and its siblings give."""
    size = hashlib.sha256().digest_size
    for place, siblings in path:
        node = combined([siblings[: size * place], node, siblings[size * place :]])
    return node


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], dict | None]]:
    """Rows of each block of a sorted stream, and the header before them, if any."""
    rows: list[dict] = []
    head, key = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["key"], row["block"]) != key:
                if rows:
                    yield rows, head
                rows, head, key = [], None, (row["key"], row["block"])
            if row["position"] < 0:
                head = row
            else:
                rows.append(row)
    if rows:
        yield rows, head


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "block").sortWithinPartitions("key", "block", "position")


def headers(nodes: DataFrame) -> DataFrame:
    """(key, block, head) of each block of nodes (key, position, digest): the key's root, what leads there from the block's own, and whether the key has no other block.

    Positions count from 0 without gaps within a key.  A block of nodes is all that a task holds; a key with any share of the rows is as
    many blocks.  Blocks above 8**BLOCK_LEVELS rows are nodes of one more round.
    """

    @lean
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in blocks_of(batches):
            leaves = [r["digest"] for r in rows]
            tops = [Subtree(leaves, 0, 0, h).whole().root if h else leaves[0] for h in (BLOCK_LEVELS, height(len(leaves)))]
            yield pa.RecordBatch.from_pylist([{"key": rows[0]["key"], "position": rows[0]["block"], "digest": tops[0], "alone": tops[1]}], pa.schema([("key", pa.string()), ("position", pa.int64()), ("digest", pa.binary()), ("alone", pa.binary())]))

    narrow = _dealt(nodes.select("key", F.floor(F.col("position") / BLOCK).cast("long").alias("block"), "position", "digest"))
    closed = written(narrow.mapInArrow(close, "key string, position long, digest binary, alone binary"), "blocks")
    spread = written(closed.groupBy("key").agg(F.max("position").alias("last")).where("last > 0").select("key"), "spread")
    head = lambda root, path, single: F.struct(F.col(root).alias("root"), F.lit(None).cast("binary").alias("top"), path.cast(PATH).alias("path"), F.lit(single).alias("single")).alias("head")
    done = closed.join(spread, "key", "left_anti").select("key", F.col("position").alias("block"), head("alone", F.array(), True))
    if spread.isEmpty():
        return done
    above = authenticated(closed.join(spread, "key", "left_semi").select("key", "position", "digest"))
    return done.unionByName(above.select("key", F.col("position").alias("block"), head("root", F.col("path"), False)))


def descended(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """nodes with `root`, `top` and `path` from the headers of their blocks; a block streams behind its header."""
    extra = [f for f in nodes.schema.fields if f.name not in ("key", "position", "digest")]
    path = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("siblings", T.BinaryType())]))
    own = [T.StructField("key", T.StringType()), T.StructField("position", T.LongType()), T.StructField("digest", T.BinaryType())]
    out = T.StructType([*own, *extra, T.StructField("root", T.BinaryType()), T.StructField("top", T.BinaryType()), T.StructField("path", path)])
    schema = to_arrow_schema(out)

    @lean
    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, row in blocks_of(batches):
            head, done = row["head"], []
            levels = height(len(rows)) if head["single"] else BLOCK_LEVELS
            for row, path in zip(rows, Traversal([r["digest"] for r in rows], levels), strict=True):
                done.append({**row, "root": head["root"], "top": head["top"], "path": [{"place": p, "siblings": s} for p, s in path] + head["path"]})
                if len(done) == AT_ONCE:
                    yield pa.RecordBatch.from_pylist(done, schema)
                    done = []
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)

    names = [f.name for f in extra]
    rows = nodes.select("key", F.floor(F.col("position") / BLOCK).cast("long").alias("block"), "position", "digest", *names, F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
    first = heads.select("key", "block", F.lit(-1).cast("long").alias("position"), F.lit(None).cast("binary").alias("digest"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in extra), "head")
    return _dealt(rows.unionByName(first)).mapInArrow(descend, out)


def authenticated(nodes: DataFrame) -> DataFrame:
    """nodes (key, position, digest, ...) with `root`, that of all nodes of their key, and `path`, what leads there; other columns pass.

    A single node is its own root, with an empty path; an empty table gives none.
    """
    return descended(nodes, headers(nodes)).drop("top")


def field(value: Column) -> Column:
    """`-` for null, else bytes of the text, `:` and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, other, subroot, root, path) of each document, digests as binary; `other` is the leaf with the text `tampered`, null where that is null.

    Leaves of a language ascend by doc_id, null ids first, equal ids by their digests; a null language is one of its own, before all others.
    Every row gives one; repeated rows are leaves of their own; other columns are ignored; an empty table gives none.
    """
    whole = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    other = F.when(tampered.isNotNull(), leaf(*whole, tampered)) if tampered is not None else F.lit(None).cast("binary")
    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    leaves = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*whole, F.col("text")).alias("digest"), other.alias("other"))
    placed = written(positions(leaves, ["key", "doc_id", "digest"], ["key"]).select("key", "position", "digest", "doc_id", "other"), "leaves")
    heads = written(headers(placed), "headers")
    tops = positions(heads.where("block = 0").select("key", F.col("head.root").alias("digest")), ["key"])
    above = written(authenticated(tops.select(F.lit("").alias("key"), "position", "digest", F.col("key").alias("group"))).select(F.col("group").alias("key"), F.col("root").alias("_top"), F.col("path").alias("_rest")), "roots")
    full = F.struct("head.root", F.col("_top").alias("top"), F.concat("head.path", "_rest").alias("path"), "head.single").alias("head")
    found = descended(placed, heads.join(small_side(above, BROADCAST_BYTES), "key").select("key", "block", full))
    return found.select("doc_id", F.col("digest").alias("leaf"), "other", F.col("root").alias("subroot"), F.col("top").alias("root"), "path")


def verified(paths: DataFrame) -> DataFrame:
    """What `manifest` gives, with `proof` (digest of all siblings) and `fold` (the root that `other`, else the leaf, gives)."""
    schema = T.StructType([f for f in paths.schema.fields if f.name != "path"] + [T.StructField("proof", T.BinaryType()), T.StructField("fold", T.BinaryType())])

    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, folds = [], []
            for path, mine, other in zip(*(batch.column(c).to_pylist() for c in ("path", "leaf", "other")), strict=True):
                steps = [(x["place"], x["siblings"]) for x in path]
                proofs.append(combined([s for _, s in steps]))
                folds.append(folded(other or mine, steps))
            rest = batch.drop_columns(["path"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(proofs, pa.binary()), pa.array(folds, pa.binary())], names=[*rest.schema.names, "proof", "fold"])

    return paths.mapInArrow(check, schema)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): where 3 divides crc32 of the id in decimals, the text is tampered with
    by lower-casing A-Z.  Null ids and null texts are left as they are."""
    lowered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER))
    found = verified(manifest(docs.select("doc_id", "source", "lang", "n_chars", "text"), lowered))
    hexed = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"), hexed("proof").alias("proof_sha256"), hexed("fold").alias("folded_root"), (F.col("fold") == F.col("root")).alias("verified"))
