"""Three-way merge of branches of a document table by operational transformation.

A branch holds, for each document of the base, whether it drops the row, new values of columns, and a sequence of operations over the lines of the
base text: ("retain", n, None), ("delete", n, None), ("replace", n, lines), ("insert", n, lines).  `transform` walks two concurrent
sequences once and gives the right one as it applies after the left one, so that the left, then that, is the merge; where the two
conflict it brings the base's state back.  `compose` joins both to one sequence, which `apply` runs on the base.  Everything about one document lies in
its row, so base rows never move; only added rows meet by id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairforge.llm.common import lean

Ops = list[tuple[str, int, "list[str] | None"]]
OPS = "array<struct<kind: string, n: int, lines: array<string>>>"
BRANCH = f"struct<dropped: boolean, lang: string, source: string, ops: {OPS}>"
COLUMNS = ["lang", "source"]
COUNTS = ["n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert"]
BRANCHES, CODES = ("L", "R"), 11
MERGED = "doc_id long, lang string, source string, text string, " + ", ".join(f"{c} long" for c in COUNTS)
BATCH_BYTES = 1 << 21


def put(ops: Ops, kind: str, n: int, lines: list[str] | None = None) -> None:
    """Adds an operation; neighbours of one kind become one."""
    if not n:
        return
    if ops and ops[-1][0] == kind:
        ops[-1] = (kind, ops[-1][1] + n, ops[-1][2] + lines if lines is not None else None)
    else:
        ops.append((kind, n, list(lines) if lines is not None else None))


class Walk:
    """Takes a sequence apart from the front; beyond its end all is retained."""

    def __init__(self, ops: Ops) -> None:
        self.ops, self.k, self.used = ops, 0, 0

    def inserted(self) -> list[str]:
        """The lines inserted here, taken."""
        if self.k < len(self.ops) and self.ops[self.k][0] == "insert":
            self.k += 1
            return self.ops[self.k - 1][2]
        return []

    def kind(self) -> str:
        return self.ops[self.k][0] if self.k < len(self.ops) else "retain"

    def left(self, most: int) -> int:
        """Lines that the present operation still covers."""
        return self.ops[self.k][1] - self.used if self.k < len(self.ops) else most

    def take(self, n: int) -> list[str] | None:
        """Moves on by n lines; what they become if they are replaced."""
        if self.k >= len(self.ops):
            return None
        _, size, lines = self.ops[self.k]
        out = lines[self.used : self.used + n] if lines is not None else None
        self.used += n
        if self.used == size:
            self.k, self.used = self.k + 1, 0
        return out


def transform(left: Ops, right: Ops, base: list[str]) -> tuple[Ops, list[int]]:
    """The right operations as they apply after the left ones, and how many changes are clean, edit-edit, edit-delete and insert-insert.

    A change of one side, or one both made, is clean; others are conflicts and take the base's state.  Lines and the gaps between them are judged apart.
    """
    a, b, out, counts, at = Walk(left), Walk(right), [], [0, 0, 0, 0], 0
    while True:
        x, y = a.inserted(), b.inserted()
        if x and y and x != y:
            counts[3] += 1
            put(out, "delete", len(x))
        elif x or y:
            counts[0] += 1
            put(out, "retain", len(x)) if x else put(out, "insert", len(y), y)
        if at == len(base):
            return out, counts
        here, there = a.kind(), b.kind()
        n = min(len(base) - at, a.left(len(base) - at), b.left(len(base) - at))
        p, q, old = a.take(n), b.take(n), base[at : at + n]
        at += n
        if here == "retain":
            counts[0] += n * (there != "retain")
            put(out, there, n, q)
        elif there == "retain":
            counts[0] += n
            put(out, "retain", n if here == "replace" else 0)
        elif here == "delete" and there == "delete":
            counts[0] += n
        elif here == "delete":
            counts[2] += n
            put(out, "insert", n, old)
        elif there == "delete":
            counts[2] += n
            put(out, "replace", n, old)
        else:
            for was, mine, yours in zip(old, p, q, strict=True):
                counts[0 if mine == yours else 1] += 1
                put(out, "retain", 1) if mine == yours else put(out, "replace", 1, [was])


def compose(first: Ops, second: Ops, n_base: int) -> Ops:
    """One sequence over the base's n_base lines that does what the first and then the second one do."""
    a, b, out, at = Walk(first), Walk(second), [], 0
    fresh: list[str] = []  # lines that the first one inserted and the second one has not seen
    while True:
        if lines := b.inserted():
            put(out, "insert", len(lines), lines)
            continue
        fresh = fresh or a.inserted()
        if fresh:
            n = min(len(fresh), b.left(len(fresh)))
            kind, new = b.kind(), b.take(n)
            if kind != "delete":
                put(out, "insert", n, new if kind == "replace" else fresh[:n])
            fresh = fresh[n:]
            continue
        if at == n_base:
            return out
        kind = a.kind()
        n = min(n_base - at, a.left(n_base - at))
        if kind == "delete":
            a.take(n)
            put(out, "delete", n)
        else:
            n = min(n, b.left(n))
            mine, then = a.take(n), b.kind()
            yours = b.take(n)
            put(out, then if then != "retain" else kind, n, yours if then != "retain" else mine)
        at += n


def apply(ops: Ops, base: list[str]) -> list[str]:
    out, at = [], 0
    for kind, n, lines in ops:
        out += lines if lines is not None else base[at : at + n] if kind == "retain" else []
        at += n if kind != "insert" else 0
    return out + base[at:]


def merged_row(row: dict, left: dict, right: dict) -> tuple:
    """(lang, source, text, counts) of a base row that two branches changed; null values for a row that goes."""
    base = [row[c] or "" for c in COLUMNS] + [row["text"] or ""]
    gone = (None, None, None, [1, 0, 0, 0])
    if left["dropped"] and right["dropped"]:
        return gone
    if left["dropped"] or right["dropped"]:
        other = right if left["dropped"] else left
        touched = bool(other["ops"]) or any(other[c] is not None and other[c] != was for c, was in zip(COLUMNS, base, strict=False))
        return (*base, [0, 0, 1, 0]) if touched else gone
    values, counts = [], [0, 0, 0, 0]
    for c, was in zip(COLUMNS, base, strict=False):
        x, y = (was if side[c] is None else side[c] for side in (left, right))
        conflict = x != was and y != was and x != y
        counts[1] += conflict
        counts[0] += not conflict and (x != was or y != was)
        values.append(was if conflict or x == y == was else x if x != was else y)
    text = base[-1]
    if left["ops"] or right["ops"]:
        lines = text.split("\n")
        after, found = transform(left["ops"], right["ops"], lines)
        counts = [x + y for x, y in zip(counts, found, strict=True)]
        text = "\n".join(apply(compose(left["ops"], after, len(lines)), lines))
    return (*values, text, counts)


def _tuples(side: dict) -> dict:
    return {**side, "ops": [(o["kind"], o["n"], o["lines"]) for o in side["ops"]]}


def merge_rows(rows: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Base rows (doc_id, lang, source, text) with two columns of type BRANCH to (doc_id, lang, source, text, n_clean, n_edit_edit, n_edit_delete,
    n_insert_insert).  Nothing is shuffled.

    Nulls of the base become empty first; rows that go keep their id, with nulls; repeated rows are merged each on its own.
    """
    schema = to_arrow_schema(T._parse_datatype_string(MERGED))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, held = [], 0
            for row in (r for k in range(0, batch.num_rows, 64) for r in batch.slice(k, 64).to_pylist()):
                *values, counts = merged_row(row, _tuples(row["left"]), _tuples(row["right"]))
                done.append((row["doc_id"], *values, *counts))
                held += len(values[-1] or "")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                    done, held = [], 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    picked = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS, "text", F.col(left).alias("left"), F.col(right).alias("right"))
    return picked.where("doc_id is not null").mapInArrow(run, MERGED)


def merge_added(added: DataFrame, base: DataFrame) -> DataFrame:
    """Rows (branch, doc_id, lang, source, text) that branches L and R add, merged by id into the form of `merge_rows`.

    One side's row, or one both add, is clean; two different ones are a conflict that leaves none.  A branch that adds one id more than once adds its
    least row by (text, lang, source); an id that the base holds is not added.  Partial aggregates meet, whatever share of the rows an id has.
    """
    whole = F.struct("text", "lang", "source")
    side = lambda b: F.min(F.when(F.col("branch") == b, whole)).alias(b)
    both = added.select("branch", F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in (*COLUMNS, "text"))).unionByName(base.select(F.col("doc_id").cast("long").alias("doc_id")), allowMissingColumns=True)
    met = both.where("doc_id is not null").groupBy("doc_id").agg(side("L"), side("R"), F.max(F.col("branch").isNull()).alias("held")).where("not held")
    conflict = (F.col("L") != F.col("R")) & F.col("L").isNotNull() & F.col("R").isNotNull()
    row = F.when(~F.coalesce(conflict, F.lit(False)), F.coalesce("L", "R"))
    clash = F.coalesce(conflict, F.lit(False)).cast("long")
    return met.select("doc_id", row["lang"].alias("lang"), row["source"].alias("source"), row["text"].alias("text"), (1 - clash).alias("n_clean"), F.lit(0).cast("long").alias("n_edit_edit"), F.lit(0).cast("long").alias("n_edit_delete"), clash.alias("n_insert_insert"))


def merge(rows: DataFrame, added: DataFrame) -> DataFrame:
    """Every id ever present, once for each base row and once for each added id."""
    return merge_rows(rows).unionByName(merge_added(added, rows.select("doc_id")))


def code(branch: str, name: str, doc_id: str = "doc_id") -> Column:
    return F.crc32(F.concat(F.lit(f"{branch}:"), F.col(doc_id).cast("string"), F.lit(f":{name}")).cast("binary")) % CODES


def line_operations(prefix: bytes, n_lines: int, lines: list[str]) -> Ops:
    """The operations of the contract's branch on the lines of one text, by the code of each line's number."""
    seed, ops, last = zlib.crc32(prefix), [], 0
    for k in range(n_lines):
        c = zlib.crc32(b"%d" % k, seed) % CODES
        if c > 4:
            continue
        if c < 3:
            put(ops, "retain", k - last)
            put(ops, "delete", 1) if c == 0 else put(ops, "replace", 1, [lines[k] + " !?"[c]])
        else:
            put(ops, "retain", k + 1 - last)
            put(ops, "insert", 1, ["!" if c == 3 else "?"])
        last = k + 1
    return ops


def coded_branches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's two branches of the documents: base rows with columns `left` and `right`, and the rows that the branches add."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in (*COLUMNS, "text"))).where("doc_id is not null")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("n", pa.int32()), ("lines", pa.list_(pa.string()))]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found: list[list] = [[], []]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(3).to_pylist(), strict=True):
                    lines = text.split("\n")
                    for out, branch in zip(found, BRANCHES, strict=True):
                        ops = line_operations(b"%s:%d:" % (branch.encode(), doc_id), len(lines), lines)
                        out.append([{"kind": o, "n": n, "lines": new} for o, n, new in ops])
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, kind) for x in found)], names=[*part.schema.names, "ops_l", "ops_r"])

    rows = base.mapInArrow(run, f"doc_id long, lang string, source string, text string, ops_l {OPS}, ops_r {OPS}")

    def changed(branch: str, column: str) -> Column:
        c = code(branch, column)
        return F.when(c == 0, F.lit("")).when(c == 1, F.concat(column, F.lit("!"))).when(c == 2, F.concat(column, F.lit("?")))

    side = lambda branch, ops: F.struct((code(branch, "row") == 0).alias("dropped"), *(changed(branch, c).alias(c) for c in COLUMNS), F.col(ops).alias("ops"))
    news = [
        base.where(code(branch, "row").isin(3, 4)).select(F.lit(branch).alias("branch"), (F.lit(-1 - k) - F.col("doc_id")).alias("doc_id"), *COLUMNS, F.when(code(branch, "row") == 3, "!").otherwise("?").alias("text"))
        for k, branch in enumerate(BRANCHES)
    ]
    return rows.select("doc_id", *COLUMNS, "text", side("L", "ops_l").alias("left"), side("R", "ops_r").alias("right")), news[0].unionByName(news[1])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text_sha256, n_clean, n_edit_edit, n_edit_delete, n_insert_insert) of the merge of the two coded branches.

    Rows with a null id are left out; other columns are ignored, whatever their names; an empty table gives none.
    """
    found = merge(*coded_branches(docs.select("doc_id", *COLUMNS, "text")))
    return found.select("doc_id", *COLUMNS, F.sha2("text", 256).alias("text_sha256"), *COUNTS)
