"""Packed token files: the vectors of all items one after the other, and where each item's begin, as a Spark data source.

A store is a folder of parts, each a range of items: `part-*.val` holds flat values (bf16 or f32), `part-*.off` one 64-bit offset more than
items.  `manifest.json`, written last, names the parts of the whole store; files that it does not name do not count.  A reader
splits parts by items, and filters on item_id become byte ranges.  A store is written by one job, whose commit checks that the parts of all tasks
tile the items, or by `world` jobs of a range each (a shard), which `merge` puts together once all are there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from pairforge.functions.scalar import round_bf16
from pairforge.functions.shared import positions
from pairforge.operators.splits import shard_range
from pairforge.operators.stores import clear_shards, shard_order

NAME = "packed_tokens"
FLAT = "item_id long, pos int, v array<float>"
NESTED = "item_id long, tokens array<array<float>>"
KINDS = {"bf16": np.dtype("<u2"), "f32": np.dtype("<f4")}
SLICE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
MANIFEST = "manifest.json"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _read_json(fs: pafs.FileSystem, path: str) -> dict:
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _write_json(fs: pafs.FileSystem, path: str, value: dict) -> None:
    """Written beside and moved, so that no reader sees half of it."""
    mine = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(mine) as f:
        f.write(json.dumps(value).encode())
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(mine, path)


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: items [start, start + length) with so many tokens."""

    name: str
    start: int
    length: int
    tokens: int
    width: int


@dataclass
class Slice(InputPartition):
    name: str
    start: int  # the part's first item
    lo: int
    hi: int
    kind: str
    width: int


def tiling(parts: Sequence[Part], first: int = 0) -> list[Part]:
    """The parts by start, if each begins where the one before ends and all have one width; raises otherwise."""
    out = sorted((p for p in parts if p.length), key=lambda p: p.start)
    for p in out:
        if p.start != first:
            raise ValueError(f"items {first} to {p.start} are {'missing' if p.start > first else 'written twice'}")
        first += p.length
    if len({p.width for p in out if p.tokens}) > 1:
        raise ValueError("parts of several widths")
    return out


class PackedReader(DataSourceReader):
    """Reads slices of parts; `bytes_read` counts what one reader object has asked of the files."""

    def __init__(self, path: str, nested: bool, slice_bytes: int) -> None:
        self.path, self.nested, self.slice_bytes = path, nested, slice_bytes
        self.wanted: list[tuple[int, int]] | None = None
        self.bytes_read = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        lo, hi, some = 0, 1 << 62, None
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("item_id",) or value is None:
                yield f
            elif isinstance(f, EqualTo):
                lo, hi = max(lo, value), min(hi, value + 1)
            elif isinstance(f, In):
                some = {x for x in value if x is not None and (some is None or x in some)}
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                lo = max(lo, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                hi = min(hi, value + isinstance(f, LessThanOrEqual))
            else:
                yield f
        runs: list[tuple[int, int]] = []
        for x in sorted(x for x in some if lo <= x < hi) if some is not None else []:
            if runs and runs[-1][1] == x:
                runs[-1] = (runs[-1][0], x + 1)
            else:
                runs.append((x, x + 1))
        self.wanted = runs if some is not None else [(lo, hi)]

    def partitions(self) -> list[Slice]:
        fs, base = _fs(self.path)
        manifest = _read_json(fs, f"{base}/{MANIFEST}")
        size = KINDS[manifest["kind"]].itemsize * manifest["width"]
        out = []
        for p in manifest["parts"]:
            step = max(1, p["length"] if not p["tokens"] else int(p["length"] * self.slice_bytes / (p["tokens"] * size)))
            for lo, hi in self.wanted if self.wanted is not None else [(0, 1 << 62)]:
                lo, hi = max(lo, p["start"]), min(hi, p["start"] + p["length"])
                out += [Slice(p["name"], p["start"], k, min(k + step, hi), manifest["kind"], manifest["width"]) for k in range(lo, hi, step)]
        return out or [Slice("", 0, 0, 0, manifest["kind"], 0)]

    def _at(self, source: pa.NativeFile, start: int, size: int) -> bytes:
        self.bytes_read += size
        source.seek(start)
        return source.read(size)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition.lo >= partition.hi:
            return
        fs, base = _fs(self.path)
        kind, width = KINDS[partition.kind], partition.width
        with fs.open_input_file(f"{base}/{partition.name}.off") as source:
            offs = np.frombuffer(self._at(source, 8 * (partition.lo - partition.start), 8 * (partition.hi - partition.lo + 1)), "<i8")
        per = max(1, BATCH_BYTES // max(1, 4 * width))  # tokens a batch
        with fs.open_input_file(f"{base}/{partition.name}.val") as source:
            k = 0
            while k < len(offs) - 1:
                end = max(k + 1, int(np.searchsorted(offs, offs[k] + per, "right")) - 1)
                n = int(offs[end] - offs[k])
                raw = np.frombuffer(self._at(source, int(offs[k]) * width * kind.itemsize, n * width * kind.itemsize), kind) if n else np.zeros(0, kind)
                values = (raw.astype(np.uint32) << np.uint32(16)).view(np.float32) if partition.kind == "bf16" else raw
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values))
                counts = np.diff(offs[k : end + 1])
                items = np.arange(partition.lo + k, partition.lo + end)
                if self.nested:
                    tokens = pa.ListArray.from_arrays(pa.array((offs[k : end + 1] - offs[k]).astype(np.int32)), vectors)
                    yield pa.RecordBatch.from_arrays([pa.array(items), tokens], names=["item_id", "tokens"])
                else:
                    pos = np.arange(n) - np.repeat(offs[k:end] - offs[k], counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(items, counts)), pa.array(pos.astype(np.int32)), vectors], names=["item_id", "pos", "v"])
                k = end


class PackedWriter(DataSourceArrowWriter):
    """Writes (item_id, tokens), ascending within each task; the commit publishes the store, or one shard of it, as a whole."""

    def __init__(self, path: str, kind: str, shard: tuple[int, int] | None) -> None:
        self.path, self.kind, self.shard, self.run = path, kind, shard, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        name = f"part-{self.run}-{TaskContext.get().taskAttemptId()}"
        start, offs, width = 0, [0], 0
        with fs.open_output_stream(f"{base}/{name}.val") as out:
            for batch in iterator:
                items = batch.column(0).to_numpy()
                if not len(items):
                    continue
                start = int(items[0]) if len(offs) == 1 else start
                if (items != np.arange(start + len(offs) - 1, start + len(offs) - 1 + len(items))).any():
                    raise ValueError("a task's item_ids must follow one another without gaps")
                tokens = batch.column(1)
                counts = np.diff(np.asarray(tokens.offsets)) if not tokens.null_count else np.array([0 if x is None else x for x in tokens.value_lengths().to_pylist()])
                vectors = tokens.flatten()
                widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                if len(widths):
                    width = width or int(widths[0])
                    if (widths != width).any():
                        raise ValueError("vectors of several widths")
                values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                out.write((round_bf16(values).view(np.uint32) >> np.uint32(16)).astype("<u2").tobytes() if self.kind == "bf16" else values.astype("<f4").tobytes())
                offs += (offs[-1] + np.cumsum(counts)).tolist()
        with fs.open_output_stream(f"{base}/{name}.off") as out:
            out.write(np.array(offs, "<i8").tobytes())
        return Part(name, start, len(offs) - 1, offs[-1], width)

    def _drop(self, keep: set[str]) -> None:
        """Deletes this run's files but those of the parts to keep."""
        fs, base = _fs(self.path)
        for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if x.base_name.startswith(f"part-{self.run}-") and x.base_name.rsplit(".", 1)[0] not in keep:
                fs.delete_file(x.path)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        try:
            first = min((p.start for p in parts if p.length), default=0) if self.shard else 0
            whole = tiling(parts, first)
        except ValueError:
            self._drop(set())
            raise
        self._drop({p.name for p in whole})
        fs, base = _fs(self.path)
        if self.shard:
            rank, world = self.shard
            _write_json(fs, f"{base}/shard-{rank:05d}.json", {"rank": rank, "world": world, "start": first, "length": sum(p.length for p in whole), "kind": self.kind, "parts": [vars(p) for p in whole]})
        else:
            publish(self.path, self.kind, whole)

    def abort(self, messages: list[Part | None]) -> None:
        self._drop(set())


def publish(path: str, kind: str, parts: list[Part]) -> None:
    """Makes the parts the store: the manifest first, then files that it does not name go."""
    fs, base = _fs(path)
    fs.create_dir(base, recursive=True)
    width = max((p.width for p in parts), default=0)
    _write_json(fs, f"{base}/{MANIFEST}", {"kind": kind, "width": width, "items": sum(p.length for p in parts), "tokens": sum(p.tokens for p in parts), "parts": [vars(p) for p in parts]})
    named = {p.name for p in parts}
    for x in fs.get_file_info(pafs.FileSelector(base)):
        if x.is_file and (x.base_name.startswith("shard-") or x.base_name.startswith("part-") and x.base_name.rsplit(".", 1)[0] not in named):
            fs.delete_file(x.path)


class PackedTokens(DataSource):
    """Options: path; nested (one row an item); slice_bytes; kind (bf16 or f32); shard (rank/world)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return NESTED if self.options.get("nested") == "true" else FLAT

    def reader(self, schema: T.StructType) -> PackedReader:
        return PackedReader(self.options["path"], self.options.get("nested") == "true", int(self.options.get("slice_bytes", SLICE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> PackedWriter:
        kind, shard = self.options.get("kind", "bf16"), self.options.get("shard")
        if kind not in KINDS or schema.names != ["item_id", "tokens"]:
            raise ValueError(f"a packed store takes item_id and tokens, as one of {sorted(KINDS)}")
        return PackedWriter(self.options["path"], kind, tuple(int(x) for x in shard.split("/")) if shard else None)


def read(spark: SparkSession, path: str, nested: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, pos, v), or (item_id, tokens) if nested; filters on item_id read only the bytes of those items."""
    spark.dataSource.register(PackedTokens)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("nested", str(nested).lower()).option("slice_bytes", slice_bytes).load(path)


def write(items: DataFrame, path: str, kind: str = "bf16", shard: tuple[int, int] | None = None) -> None:
    """Writes (item_id, tokens), item_ids dense, as a store or as the shard (rank, world) of one; null tokens are none."""
    items.sparkSession.dataSource.register(PackedTokens)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("tokens").cast("array<array<float>>"), F.array().cast("array<array<float>>")).alias("tokens"))
    out = rows.repartitionByRange("item_id").sortWithinPartitions("item_id").write.format(NAME).option("path", path).option("kind", kind)
    (out.option("shard", f"{shard[0]}/{shard[1]}") if shard else out).mode("append" if shard else "overwrite").save()


def of_rank(n: int, rank: int, world: int) -> Column:
    """Whether an item belongs to the rank's range of n items."""
    start, length = shard_range(F.lit(n), world, F.lit(rank))
    return (F.col("item_id") >= start) & (F.col("item_id") < start + length)


def _shards(path: str) -> list[dict]:
    fs, base = _fs(path)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return [_read_json(fs, x.path) for x in found if x.base_name.startswith("shard-") and x.base_name.endswith(".json")]


def missing(path: str, world: int) -> list[int]:
    """Ranks of a run of `world` shards that are still to be written; raises where shards of another run lie."""
    there = _shards(path)
    if other := sorted({s["world"] for s in there} - {world}):
        raise ValueError(f"{path} holds shards of runs of {other}, this is one of {world}: clear it first")
    return sorted(set(range(world)) - {s["rank"] for s in there})


def merge(spark: SparkSession, path: str) -> None:
    """Makes one store of the shards, if they are one run's, each there once, and tile the items; raises otherwise and leaves all as it is."""
    there = _shards(path)
    rows = [(s["rank"], s["world"], s["start"], s["length"]) for s in there]
    shard_order(spark.createDataFrame(rows, "rank int, world int, start long, length long"))
    if len({s["kind"] for s in there}) != 1:
        raise ValueError(f"{path} holds shards of several kinds")
    publish(path, there[0]["kind"], tiling([Part(**p) for s in there for p in s["parts"]]))


def clear(spark: SparkSession, path: str) -> int:
    """Deletes shards that were never merged, and parts that no store names: what a run of another size has left.  Returns how many files went."""
    fs, base = _fs(path)
    there = fs.get_file_info(f"{base}/{MANIFEST}").type != pafs.FileType.NotFound
    named = {p["name"] for p in _read_json(fs, f"{base}/{MANIFEST}")["parts"]} if there else set()
    gone = clear_shards(spark, path, "shard-*")
    stray = {x.base_name.rsplit(".", 1)[0] for x in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if x.base_name.startswith("part-")} - named
    for name in stray:
        gone += clear_shards(spark, path, f"{name}.*")
    return len(gone)


def dense(items: DataFrame, order: str) -> DataFrame:
    """items with item_id, from 0 in `order` without gaps."""
    return positions(items, [order], name="item_id")
