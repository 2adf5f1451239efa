"""Token files: ids ranked by frequency, in byte-aligned variable-length code with separate control bytes.

A file is a sequence of blocks of whole documents.  A block has its own table of ids, the most frequent first, so
that common ids take one byte; two bits in the control bytes give each rank's length, and a lookup of each control byte
in a table of four lengths places every rank, without a loop over tokens.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import lean, publish, shared_dir, text_blocks
from pairforge.llm.encoding import encoder

HEAD = struct.Struct("<4sIQIQ")
MAGIC = b"RKV1"
BLOCK_TOKENS = 1 << 20
#: Lengths of the four ranks that a control byte tells of.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
INDEX = "part int, file string, n_docs long, n_tokens long"


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        has = size > k
        data[at[has] + k] = (ranks[has] >> np.uint32(8 * k)).astype(np.uint8)
    return control, data


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = size > k
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    seen, back, often = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((seen, -often))
    rank = np.empty(len(seen), np.uint32)
    rank[order] = np.arange(len(seen), dtype=np.uint32)
    control, data = encode_ranks(rank[back] if len(ids) else np.zeros(0, np.uint32))
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(seen), len(data))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), seen[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def unpack_blocks(source: "pa.NativeFile") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, token counts, ids) of each block of a file."""
    while head := source.read(HEAD.size):
        magic, docs, tokens, ranks, size = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token file")
        doc_ids, counts = (np.frombuffer(source.read(8 * docs), "<i8") for _ in range(2))
        table = np.frombuffer(source.read(4 * ranks), "<u4")
        control, data = (np.frombuffer(source.read(k), np.uint8) for k in (-(-tokens // 4), size))
        yield doc_ids, counts, table[decode_ranks(control, data, tokens)] if tokens else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, skip_blanks: bool = False, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One token file a range of doc ids, ids ascending across and within files; returns (part, file, n_docs, n_tokens), lazily.

    Files are moved to their place when whole, so repeated attempts of a task leave one.
    """

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        final, mine = f"{base}/part-{part:06d}.ids", f"{base}/.{part}-{task.taskAttemptId()}.tmp"
        coder = encoder(vocabulary, skip_blanks)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        out, docs_n, tokens_n = None, 0, 0
        for rows, buf, offs in text_blocks(batches, "text"):
            ids, ends = coder.block(buf, offs)
            ids = np.insert(ids, ends[1:], np.uint32(end_id))
            counts = np.diff(ends) + 1
            held.append((rows.column(0).to_numpy(), counts, ids))
            docs_n, tokens_n = docs_n + len(counts), tokens_n + len(ids)
            if sum(len(x[2]) for x in held) >= BLOCK_TOKENS:
                out = out or fs.open_output_stream(mine)
                out.write(pack_block(*(np.concatenate(x) for x in zip(*held, strict=True))))
                held = []
        if held:
            out = out or fs.open_output_stream(mine)
            out.write(pack_block(*(np.concatenate(x) for x in zip(*held, strict=True))))
        if out:
            out.close()
            publish(fs, mine, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [final], "n_docs": [docs_n], "n_tokens": [tokens_n]})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(pack, INDEX)


def token_digests(docs: DataFrame, vocabulary: str, skip_blanks: bool = False, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the token files, reads them back and returns (doc_id, start, n_tokens, ids_crc32) from what was read.

    Null texts are empty ones: the end id alone.  Rows with a null id are left out; repeated ids keep a row each, in no
    set order; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    folder = "file://" + folder if folder.startswith("/") else folder
    write_tokens(docs, folder, vocabulary, skip_blanks, end_id, doc_id, text).write.parquet(folder + "-index")
    index = spark.read.schema(INDEX).parquet(folder + "-index")
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = index.select("file", before.alias("start"), F.lit(folder).alias("folder")).repartition(max(1, index.count()))

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with pafs.FileSystem.from_uri(uri)[0].open_input_stream(path) as source:
                    for doc_ids, counts, ids in unpack_blocks(source):
                        ends = np.cumsum(counts)
                        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, start + ends - counts, counts, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        start += int(counts.sum())

    return places.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
