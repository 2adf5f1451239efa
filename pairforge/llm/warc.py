"""WARC archives from a chunked record table.

The scan cuts each payload into rows (record, row, chunk number, bytes), each with the SHA-1 and the byte count of the payload up to its
end; after that no payload travels or is held as one value.  The writer streams such rows, sorted by record and chunk, into
gzip members and checks the digests as it goes; the reader gives back the rows that it meets, in the same form.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.common import lean, publish, shared_dir, small_side, utf8_bytes, written

CHUNK, BROADCAST_BYTES = 1 << 16, 16 << 20
CHUNKS = "record_id long, row long, url string, chunk_no int, last boolean, data binary, digest string, bytes_so_far long, total long, payload_digest string, identity binary"
PLACES = "archive string, bytes long, records long"
READ = "record_id long, record_type string, refers_to long, url string, chunk_no int, last boolean, data binary, chunk_bytes long, bytes_so_far long, digest string, stated_digest string, stated_bytes long"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_table(pages: DataFrame, record: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK, last_only: bool = False) -> DataFrame:
    """One row for each chunk of each payload (null: one empty chunk); with last_only each record's last row, without bytes.

    row numbers the records of a run; digest and bytes_so_far tell of the payload up to the chunk's end, payload_digest (SHA-1), total and
    identity (SHA-256) of all of it.  Bytes are slices of the Arrow buffer; rows go out in batches of 4 MB.
    """

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        schema = pa.schema([(x.split()[0], t) for x, t in zip(CHUNKS.split(", "), types, strict=True)])
        rows: list[tuple] = []
        held, number = 0, TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            buf, offs = utf8_bytes(batch.column(2))
            view = memoryview(buf)
            for k, (rid, link) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                begin, end = int(offs[k]), int(offs[k + 1])
                whole, identity = hashlib.sha1(view[begin:end]).hexdigest(), hashlib.sha256(view[begin:end]).digest()
                number += 1
                sha, at, n = hashlib.sha1(), begin, 0
                while True:
                    piece = view[at : min(at + chunk, end)] if not last_only else view[end:end]
                    at = end if last_only else at + len(piece)
                    sha.update(piece)
                    rows.append((rid, number, link, n, at >= end, None if last_only else bytes(piece), whole if at >= end else sha.hexdigest(), at - begin, end - begin, whole, identity))
                    held += len(piece)
                    n += 1
                    if held >= 1 << 22 or len(rows) >= 4096:
                        yield flush()
                        rows, held = [], 0
                    if at >= end:
                        break
        if rows:
            yield flush()

    return pages.select(F.col(record).cast("long"), F.col(url).cast("string"), F.col(payload)).mapInArrow(cut, CHUNKS)


def repeated_payloads(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(identity, owner) of the payloads of at least `least_bytes` that several ids have; owner: the smallest.

    `chunks` needs last rows only.  They are grouped with partial sums, so copies of one payload are never gathered.
    """
    whole = chunks.where(F.col("last") & (F.col("total") >= least_bytes))
    return written(whole.groupBy("identity").agg(F.min("record_id").alias("owner"), F.max("record_id").alias("most")).where("owner < most").drop("most"), "owners")


def _head(rid: int, url: str | None, owner: int, total: int, digest: str) -> tuple[bytes, bytes]:
    """The record's header and its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {total}\r\n\r\n".encode()
    kind = "response" if owner == rid else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{rid}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c > " "))
    lines.append(f"WARC-Payload-Digest: sha1:{b32(bytes.fromhex(digest))}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{owner}>"]
    size = len(http) + (total if kind == "response" else 0)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_archives(pages: DataFrame, folder: str, record: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, level: int = 3) -> DataFrame:
    """Writes one .warc.gz a partition (a gzip member a record) below `folder` and returns (archive, bytes, records).

    Lazy; each run of a task writes under its attempt's own name and then moves the file to its place, so repeated
    or speculative attempts leave one whole archive.
    """
    owners = repeated_payloads(chunk_table(pages, record, url, payload, last_only=True), least_bytes)
    chunks = chunk_table(pages, record, url, payload).join(small_side(owners, BROADCAST_BYTES), "identity", "left")
    rows = chunks.withColumn("owner", F.coalesce("owner", "record_id")).where("owner = record_id or chunk_no = 0")
    rows = rows.withColumn("data", F.when(F.col("owner") == F.col("record_id"), F.col("data")))
    rows = rows.select("record_id", "row", "chunk_no", "url", "data", "digest", "bytes_so_far", "total", "payload_digest", "owner").repartition("record_id", "row").sortWithinPartitions("record_id", "row", "chunk_no")

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        final, mine = f"{base}/part-{task.partitionId():06d}.warc.gz", f"{base}/.{task.partitionId()}-{task.taskAttemptId()}.tmp"
        out, gz, sha, records, size, so_far, due = None, None, None, 0, 0, 0, 0
        for batch in batches:
            rest = [batch.column(k).to_pylist() for k in (0, 2, 3, 5, 6, 7, 8, 9)]
            for k, (rid, number, link, digest, until, total, whole, owner) in enumerate(zip(*rest, strict=True)):
                if number == 0:
                    if so_far != due:
                        raise ValueError("a record lacks chunks")
                    out = out or fs.open_output_stream(mine)
                    gz, sha, so_far, due = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1(), 0, total if owner == rid else 0
                    head, http = _head(rid, link, owner, total, whole)
                    size += out.write(gz.compress(head + http))
                    records += 1
                if owner == rid:
                    data = batch.column(4)[k].as_buffer()
                    sha.update(data)
                    so_far += len(data)
                    if so_far != until or sha.hexdigest() != digest:
                        raise ValueError(f"chunk {number} of record {rid} is not the next one")
                    size += out.write(gz.compress(data))
                if so_far == due:
                    size += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if so_far != due:
            raise ValueError("a record lacks chunks")
        if out:
            out.close()
            publish(fs, mine, final)
            yield pa.RecordBatch.from_pydict({"archive": [final], "bytes": [size], "records": [records]})

    return rows.mapInArrow(pack, PLACES)


class _Stream:
    """The decompressed bytes of a file of gzip members, read forward in small pieces."""

    def __init__(self, source: "pa.NativeFile") -> None:
        self.source, self.gz, self.raw, self.buf = source, zlib.decompressobj(31), b"", bytearray()

    def fill(self) -> bool:
        if self.gz.eof:
            self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
        self.raw = self.raw or self.source.read(CHUNK)
        if not self.raw:
            return False
        got, self.raw = self.gz.decompress(self.raw, CHUNK), b""
        self.raw = self.gz.unconsumed_tail
        self.buf += got
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buf.find(mark)) < 0:
            if not self.fill():
                return None
        got = bytes(self.buf[: at + len(mark)])
        del self.buf[: at + len(mark)]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buf and not self.fill():
                raise ValueError("the archive ends inside a record")
            got = bytes(self.buf[: min(n, CHUNK)])
            del self.buf[: len(got)]
            n -= len(got)
            if got:
                yield got


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:] if x)}


def read_archives(places: DataFrame, data: bool = True) -> DataFrame:
    """Chunk rows of every record in the archives that `places` (from write_archives) lists; digest is that of what was read.

    A revisit has one row: its payload lies elsewhere, its header states digest and length.  With data=False rows come without bytes.
    """

    def rows_of(path: str, fs: pafs.FileSystem) -> Iterator[tuple]:
        with fs.open_input_stream(path, compression=None) as source:
            stream = _Stream(source)
            while (head := stream.until(b"\r\n\r\n")) is not None:
                f = _fields(head)
                rid, kind, left = int(f["warc-record-id"][12:-1]), f["warc-type"], int(f["content-length"])
                http = stream.until(b"\r\n\r\n") or b""
                left -= len(http)
                stated, size = f["warc-payload-digest"][5:], int(_fields(http)["content-length"])
                refers = int(f["warc-refers-to"][12:-1]) if kind == "revisit" else None
                sha, so_far, n = hashlib.sha1(), 0, 0
                base = (rid, kind, refers, f.get("warc-target-uri"))
                for piece in stream.take(left):
                    sha.update(piece)
                    so_far += len(piece)
                    yield (*base, n, so_far == left, piece if data else None, len(piece), so_far, b32(sha.digest()), stated, size)
                    n += 1
                if not left:
                    yield (*base, 0, True, b"" if data and kind == "response" else None, 0, 0, b32(sha.digest()) if kind == "response" else None, stated, size)
                stream.until(b"\r\n\r\n")

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for batch in batches:
            for path, folder in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for row in rows_of(path, pafs.FileSystem.from_uri(folder)[0]):
                    rows.append(row)
                    if len(rows) == (64 if data else 4096):
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)

    return places.mapInArrow(read, READ)


def archive_round_trip(pages: DataFrame, record: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archives, reads them back, and returns one row a record from what was read.

    (page_id, payload_bytes, payload_digest, record_type, refers_to).  Null payloads are empty ones;
    records with a null id are left out; rows that repeat an id are records of their own, responses if no smaller id has the
    payload; other columns are ignored; an empty table gives none.
    A response's digest and length are those of the bytes read and must equal its header's; a revisit's are its header's.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    if folder.startswith("/"):
        folder = "file://" + folder
    pages = pages.where(F.col(record).isNotNull())
    places = folder + "-places"
    write_archives(pages, folder, record, url, payload, least_bytes).write.parquet(places)
    listed = spark.read.schema(PLACES).parquet(places).select("archive", F.lit(folder).alias("folder"))
    chunks = read_archives(listed.repartition(max(1, listed.count())), data=False)
    good = F.when((F.col("record_type") == "revisit") | ((F.col("digest") == F.col("stated_digest")) & (F.col("bytes_so_far") == F.col("stated_bytes"))), F.col("stated_digest"))
    bad = F.raise_error(F.concat(F.lit("payload differs from its header in record "), F.col("record_id").cast("string")))
    return chunks.where("last").select(
        F.col("record_id").alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.coalesce(good, bad.cast("string")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
