"""A CSV with line ends inside quoted cells, read from every byte range at once.

Spark's text source gives the physical lines of each range.  Whether a range begins inside a quoted cell depends on all before it, but only
through one bit, so a first pass notes for either answer how the range ends, how many records begin in it, and the pieces of the records
that its borders cut.  These notes, one a range, are folded from left to right; a second pass then cuts the records of every range, and
the notes' pieces give those that lie across borders.  A quote counts as a csv reader takes it: it opens a cell only as its first character, and two of
them inside are one.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairforge.functions.shared import positions, settled

MOST_PIECE = 1 << 20  # characters of a piece that a note holds; longer ones are read once more, if they count
MOST_RANGES = 1 << 18  # notes that are broadcast; more are joined and their lines sorted again
BATCH_CHARS = 1 << 21

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_WHOLE = re.compile(rf'(?:(?:{_QUOTED}|[^",][^,]*+|),)*+')
_LAST = re.compile(_QUOTED)
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"[^,]*+')
_LONE_RETURN = re.compile(r"(?<=\r)(?!\Z)")

READ = "struct<ends_inside: boolean, n: bigint, first: string, head: string, tail: string, cut: boolean>"
NOTES = f"file string, block long, a {READ}, b {READ}"


def ends_inside(piece: str, inside: bool) -> bool:
    """Whether a quoted cell is open after the piece."""
    if '"' not in piece:
        return inside
    at = 0
    if inside:
        closing = _CLOSING.match(piece)
        if closing is None:
            return True
        at = closing.end() + 1
        if at > len(piece):
            return False
    at = _WHOLE.match(piece, at).end()
    return piece[at : at + 1] == '"' and _LAST.match(piece, at) is None


def pieces(line: str) -> list[str]:
    """The line with its end, cut after each carriage return within it, which ends a line too."""
    if "\r" not in line[:-1]:
        return [line + "\n"]
    *some, last = _LONE_RETURN.split(line)
    return [*some, last + "\n"]


class Reading:
    """Cuts one range's lines into records, given whether it begins inside a quoted cell.

    head: what completes a record of an earlier range, or all of the range if it does not; tail: what has begun of the last
    record.  A head or tail of more than `most` characters is left out, and `cut` says so.
    """

    def __init__(self, inside: bool, most: int | None = None) -> None:
        self.inside = self.from_before = inside
        self.most, self.n, self.cut = most, 0, False
        self.head, self.first = None, None
        self.held, self.size = [], 0

    def _hold(self, piece: str) -> None:
        self.size += len(piece)
        if self.most is None or self.size <= self.most:
            self.held.append(piece)

    def _taken(self) -> str | None:
        out = "".join(self.held) if self.most is None or self.size <= self.most else None
        self.held, self.size = [], 0
        return out

    def add(self, piece: str) -> str | None:
        """Takes a piece of text in; the record that it completes, if that began in this range."""
        before, self.inside = self.inside, ends_inside(piece, self.inside)
        if not before and not self.inside:
            if piece in ("\n", "\r", "\r\n"):
                return None
            self.n += 1
            record = piece
        else:
            self.n += not before
            self._hold(piece)
            if self.inside:
                return None
            record = self._taken()
            if self.from_before:
                self.from_before, self.head, self.cut = False, record, record is None
                return None
        if self.n == 1:
            self.first = record
        return record

    def note(self, block: int) -> dict:
        rest = self._taken() if self.inside else None
        cut = self.cut or (self.inside and rest is None)
        head, tail = (rest, None) if self.from_before else (self.head, rest)
        return {"ends_inside": self.inside, "n": self.n, "first": self.first if block == 0 else None, "head": head, "tail": tail, "cut": cut}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    at = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), "value")


def _notes(lines: DataFrame, most: int) -> DataFrame:
    """A row a range: how it reads if it begins outside (a) and inside (b) a quoted cell."""
    schema = to_arrow_schema(T._parse_datatype_string(NOTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, both = None, []
        flush = lambda: pa.RecordBatch.from_pylist([{"file": now[0], "block": now[1], "a": both[0].note(now[1]), "b": both[1].note(now[1])}], schema)
        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != now:
                    if now:
                        yield flush()
                    now, both = (file, block), [Reading(False, most), Reading(True, most)]
                for piece in pieces(line):
                    both[0].add(piece)
                    both[1].add(piece)
        if now:
            yield flush()

    return lines.mapInArrow(run, NOTES)


def _folded(notes: DataFrame) -> DataFrame:
    """(file, block, entry, first_in_file, and how the range reads), entry: whether it begins inside a quoted cell.

    A range keeps the bit, turns it, or sets it whatever it was: the bit after it is that of the last range that sets it, turned as often as
    ranges since then turn it.
    """
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    a, b = F.col("a.ends_inside"), F.col("b.ends_inside")
    turned = notes.withColumn("_turns", F.sum((a & ~b).cast("int")).over(upto))
    turned = turned.withColumn("_set", F.when(a == b, (a.cast("int") + F.col("_turns")) % 2))
    entry = (F.coalesce(F.last("_set", ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.last("_turns").over(before), F.lit(0))) % 2 == 1
    known = turned.withColumn("entry", entry).withColumn("note", F.when(F.col("entry"), F.col("b")).otherwise(F.col("a")))
    return known.select("file", "block", "entry", (F.col("block") == 0).cast("long").alias("heads"), "note.*")


def _whole_pieces(lines: DataFrame, folded: DataFrame) -> DataFrame:
    """The folded notes with all pieces in full, by one more pass over the ranges where some were left out."""
    lacking = folded.where("cut")
    again = _notes(lines.join(F.broadcast(lacking.select("file", "block")), ["file", "block"]).select("file", "block", "value"), 1 << 60)
    full = again.join(lacking.select("file", "block", "entry", "heads"), ["file", "block"])
    note = F.when(F.col("entry"), F.col("b")).otherwise(F.col("a")).alias("note")
    return folded.where("not cut").unionByName(full.select("file", "block", "entry", "heads", note).select("file", "block", "entry", "heads", "note.*"))


def read_records(spark: SparkSession, path: str, columns: list[str], optional: tuple[str, ...] = (), most_chars: int = 10 << 20, most_piece: int = MOST_PIECE) -> DataFrame:
    """(row_idx, and a string for each of `columns` and `optional`) of CSV files whose first record is a header; files follow one another by name.

    A missing column raises, an optional one is null, and so are cells that a short record lacks; a cell of more than most_chars characters
    raises; blank lines are no records.  Files are read by ranges of spark.sql.files.maxPartitionBytes; one header a file passes the driver.
    """
    lines = _lines(spark, path)
    folded = settled(_folded(settled(_notes(lines, most_piece), "csv-notes")), "csv-ranges")
    wanted, places = [*columns, *optional], []
    for r in folded.where("heads = 1").select("file", "first").collect():
        if r["first"] is None:
            raise ValueError(f"the header of {r.file} does not end within its first range, or has more than {most_piece} characters")
        names = next(csv.reader([r["first"]]))
        if missing := [c for c in columns if c not in names]:
            raise ValueError(f"{r.file} lacks the columns {missing}; it has {names}")
        places.append((r.file, [names.index(c) if c in names else -1 for c in wanted]))
    out = T.StructType([T.StructField("row_idx", T.LongType()), *(T.StructField(c, T.StringType()) for c in wanted)])
    if not places:
        return spark.createDataFrame([], out)
    schema = to_arrow_schema(out)

    def parsed(records: list[tuple[int, str]], where: list[int]) -> pa.RecordBatch:
        csv.field_size_limit(most_chars)
        rows = [next(csv.reader([text])) for _, text in records]
        cells = [[r[k] if 0 <= k < len(r) else None for r in rows] for k in where]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in records], pa.int64()), *(pa.array(c, pa.string()) for c in cells)], schema=schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records that lie in one range."""
        now, reading, records, size, where, base, before = None, None, [], 0, [], 0, 0
        for batch in batches:
            for k, (file, block, line) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if (file, block) != now:
                    if records:
                        yield parsed(records, where)
                    entry, base, heads, where = (batch.column(c)[k].as_py() for c in range(3, 7))
                    now, reading, records, size, before = (file, block), Reading(entry), [], 0, base - heads
                for piece in pieces(line):
                    record = reading.add(piece)
                    place = before + reading.n - 1  # a header's is one before its file's rows
                    if record is not None and place >= base:
                        records.append((place, record))
                        size += len(record)
                        if size > BATCH_CHARS:
                            yield parsed(records, where)
                            records, size = [], 0
        if records:
            yield parsed(records, where)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records that borders cut, from their pieces in order."""
        for batch in batches:
            for row_idx, where, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield parsed([(row_idx, "".join(texts))], where)

    based = positions(folded.select("file", "block", "entry", "heads", "n"), ["file", "block"], name="base", step=F.col("n") - F.col("heads"))
    ranges = settled(based.join(F.broadcast(spark.createDataFrame(places, "file string, places array<int>")), "file"), "csv-places")
    some = ranges.select("file", "block", "entry", "base", "heads", "places")
    picked = ["file", "block", "value", "entry", "base", "heads", "places"]
    if ranges.count() <= MOST_RANGES:
        dealt = lines.join(F.broadcast(some), ["file", "block"]).select(*picked)
    else:
        dealt = lines.withColumn("_at", F.monotonically_increasing_id()).join(some, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "_at").select(*picked)
    rows = dealt.mapInArrow(whole, out)

    notes = folded if folded.where("cut").isEmpty() else _whole_pieces(lines, folded)
    known = notes.join(some.select("file", "block", "base", "places"), ["file", "block"]).where("head is not null or tail is not null")
    begun = F.when(F.col("tail").isNotNull(), F.col("base") - F.col("heads") + F.col("n") - 1)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = known.withColumn("begun", begun).withColumn("earlier", F.last("begun", ignorenulls=True).over(earlier))
    parts = held.where("tail is not null").select(F.col("begun").alias("row_idx"), "places", "block", F.col("tail").alias("text")).unionByName(held.where("head is not null").select(F.col("earlier").alias("row_idx"), "places", "block", F.col("head").alias("text")))
    met = parts.groupBy("row_idx").agg(F.first("places").alias("places"), F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]).alias("texts"))
    return rows.unionByName(met.mapInArrow(across, out))
