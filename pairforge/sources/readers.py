"""Readers: the pair CSV, id files, JSON sidecars and token stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.shared import positions
from pairforge.sources.quoted_csv import read_records

DEFAULT_COLUMNS = {"uid": "primary_Accession", "protein": "protein_sequence", "text": "[final]text_caption", "pfam": "pfam_label"}
MOST_CHARS = 10 << 20


def read_pairs(spark: SparkSession, path: str, columns: dict[str, str] | None = None, subset: int = 0, most_chars: int = MOST_CHARS) -> DataFrame:
    """(row_idx, uid, protein, text, pfam) of a CSV with quoted commas, quotes and line ends.

    Missing required columns raise, and so do cells of more than `most_chars` characters; pfam is optional, null where absent or empty; other empty cells are empty strings; subset > 0 keeps the
    first rows in file order.  Files are read by byte ranges, line ends inside cells or not; they follow one another by name.
    """
    names = {**DEFAULT_COLUMNS, **(columns or {})}
    raw = read_records(spark, path, [names[k] for k in ("uid", "protein", "text")], (names["pfam"],), most_chars)
    col = lambda k: F.coalesce(F.col(f"`{names[k]}`"), F.lit("")).alias(k)
    out = raw.select("row_idx", col("uid"), col("protein"), col("text"), F.nullif(F.col(f"`{names['pfam']}`"), F.lit("")).alias("pfam"))
    return out.where(F.col("row_idx") < subset) if subset > 0 else out


def read_captions(spark: SparkSession, path: str, columns: dict[str, str] | None = None, subset: int = 0) -> DataFrame:
    return read_pairs(spark, path, columns, subset).select("row_idx", "uid", "text")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id): one key a line, stripped; blank lines and repeats are left out."""
    lines = spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("_at"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("id")).where("id <> ''")
    firsts = lines.groupBy("id").agg(F.min("_at").alias("_at"))
    return positions(firsts, ["_at"], name="ord").select("ord", "id")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON sidecar under a stated schema; a missing file is an empty table."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read_tokens(spark: SparkSession, path: str, modality: str, item: int | None = None) -> DataFrame:
    """A token store's rows; the modality prunes folders and an item prunes row groups."""
    rows = spark.read.parquet(path).where(F.col("modality") == modality)
    return rows if item is None else rows.where(F.col("item_id") == item)
