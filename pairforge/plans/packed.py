"""Queries over files that are read and written by ranges: the quoted CSV, packed token stores, sharded exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairforge.functions.shared import shared_base
from pairforge.plans.base import TOK, query, table, with_
from pairforge.sources import packed, readers

T = with_(TOK)


def folder(spark, name):
    """A new folder of the cluster's shared one."""
    base = shared_base(spark)
    return f"{base}/{name}-{uuid.uuid4().hex}"


CELL = "replace(coalesce(text, ''), '.', '.\"' || chr(10) || ',')"


FILE_CHARS = 32 << 20  # of text in a CSV file, about: the files grow in number, not in size


@query(f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, CAST(doc_id AS VARCHAR) AS uid, coalesce(source, '') AS protein, md5({CELL}) AS digest, length({CELL}) AS n_chars, nullif(lang, '') AS pfam FROM documents")
def csv_ranges(spark, sf):
    """A CSV of all documents, written by Spark and read by byte ranges; every full stop is followed by a quote, a line end and a comma inside its cell."""
    path = folder(spark, "csv")
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", F.col("doc_id").cast("string").alias("primary_Accession"), F.coalesce("source", F.lit("")).alias("protein_sequence"), F.replace(F.coalesce("text", F.lit("")), F.lit("."), F.lit('."\n,')).alias("[final]text_caption"), F.col("lang").alias("pfam_label"))
    chars = d.agg(F.sum(F.length("text"))).first()[0] or 0
    rows.repartitionByRange(max(3, -(-chars // FILE_CHARS)), "doc_id").sortWithinPartitions("doc_id").drop("doc_id").write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n")
    got = readers.read_pairs(spark, path)
    return got.select("row_idx", "uid", "protein", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"), "pfam")


def raw_tokens(spark, sf):
    """(item_id, label, tokens): each vector of the table as 4 tokens, item ids dense by vec_id."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.slice("embedding", p * 16 + 1, 16)).alias("tokens"))
    return packed.dense(e, "vec_id")


ITEM = "placed AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS item_id, vec_id FROM embeddings), raw AS (SELECT item_id, pos, r FROM slices JOIN placed USING (vec_id))"


@query(with_(TOK, ITEM) + "SELECT item_id, pos, r[1] AS v_first, r[16] AS v_last, CAST(len(r) AS BIGINT) AS width FROM raw")
def packed_tokens(spark, sf):
    path = folder(spark, "packed")
    packed.write(raw_tokens(spark, sf), path, "f32")
    t = packed.read(spark, path, slice_bytes=1 << 16)
    return t.select("item_id", "pos", F.element_at("v", 1).cast("double").alias("v_first"), F.element_at("v", 16).cast("double").alias("v_last"), F.size("v").cast("long").alias("width"))


@query(with_(TOK, ITEM) + "SELECT item_id, pos, r[2] AS second FROM raw WHERE item_id % 37 = 0 AND item_id < 800 UNION ALL SELECT item_id, pos, r[2] FROM raw WHERE item_id >= (SELECT max(item_id) - 20 FROM raw)")
def packed_lookup(spark, sf):
    """Some items by id, and a range of them: only their bytes are read."""
    path = folder(spark, "packed")
    items = raw_tokens(spark, sf)
    packed.write(items, path, "f32")
    last = items.agg(F.max("item_id")).first()[0]
    some = packed.read(spark, path).where(F.col("item_id").isin(list(range(0, 800, 37))))
    rest = packed.read(spark, path).where(F.col("item_id") >= last - 20)
    return some.union(rest).select("item_id", "pos", F.element_at("v", 2).cast("double").alias("second"))


RANKS = 5


@query(with_(TOK, ITEM) + "SELECT item_id, count(*) AS n_tokens, max(r[1]) AS most FROM raw GROUP BY item_id")
def sharded_export(spark, sf):
    """An export by five jobs of a range of items each, of which the second was lost and written again, merged and read back."""
    path = folder(spark, "export")
    items = raw_tokens(spark, sf)
    n = items.count()
    for rank in range(RANKS):
        if rank != 1:
            packed.write(items.where(packed.of_rank(n, rank, RANKS)), path, "f32", (rank, RANKS))
    for rank in packed.missing(path, RANKS):
        packed.write(items.where(packed.of_rank(n, rank, RANKS)), path, "f32", (rank, RANKS))
    packed.merge(spark, path)
    t = packed.read(spark, path, nested=True)
    return t.select("item_id", F.size("tokens").cast("long").alias("n_tokens"), F.array_max(F.transform("tokens", lambda v: v[0])).cast("double").alias("most"))
