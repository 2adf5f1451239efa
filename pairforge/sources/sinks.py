"""Writers: token stores, reports and logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tokens(tokens: DataFrame, path: str, modality: str) -> None:
    """(item_id, pos, v, valid?) as a token store: invalid tokens dropped, ranges of items together, committed as a whole."""
    rows = tokens.where("valid").drop("valid") if "valid" in tokens.columns else tokens
    rows.withColumn("modality", F.lit(modality)).repartitionByRange("item_id").sortWithinPartitions("item_id", "pos").write.mode("append").partitionBy("modality").parquet(path)


def fasta(df: DataFrame, key: str, sequences: dict[str, str], order: str | None = None) -> DataFrame:
    """(key or order, n, line): a header and a sequence line for each of a row's sequences, upper-cased and without other than A to Z."""
    lines = []
    for name, col in sequences.items():
        lines += [F.concat(F.lit(f">{name}|"), F.col(key).cast("string")), F.regexp_replace(F.upper(col), "[^A-Z]", "")]
    return df.select(order or key, F.posexplode(F.array(*lines)).alias("n", "line"))


def write_fasta(df: DataFrame, path: str, key: str, sequences: dict[str, str], order: str | None = None) -> None:
    """`order` names the column that keeps the lines of a row together where rows repeat the key."""
    fasta(df, key, sequences, order).sortWithinPartitions(order or key, "n").select("line").write.text(path)


def write_report(df: DataFrame, path: str, sep: str = "\t") -> None:
    """A table with a header; white space inside cells becomes single blanks."""
    flat = [F.trim(F.regexp_replace(c, r"\s+", " ")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.csv(path, sep=sep, header=True, quote='"', escape='"')


def append_log(df: DataFrame, path: str) -> None:
    """One JSON line a row, added to what is there."""
    df.write.mode("append").json(path)


def write_sidecar(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_matrix(cells: DataFrame, path: str, row: str, column: str, value: str, most: int = 1024) -> np.ndarray:
    """A matrix of at most `most` rows and columns (the first ones), to be looked at, as an .npy file of the driver; absent cells are NaN."""
    some = cells.where(F.col(row).between(0, most - 1) & F.col(column).between(0, most - 1)).select(F.col(row).cast("long").alias("i"), F.col(column).cast("long").alias("j"), F.col(value).cast("float").alias("x")).toPandas()
    out = np.full((int(some.i.max()) + 1, int(some.j.max()) + 1) if len(some) else (0, 0), np.nan, np.float32)
    out[some.i, some.j] = some.x
    np.save(path, out)
    return out
