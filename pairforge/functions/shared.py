"""Keyed hashes, fixed-precision rounding and settled intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Only a session on one machine may do without: it gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/pairforge-shared"
    return base.rstrip("/")


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """The rows of df, written once below the session's shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_hash(*parts) -> Column:
    """A 32-bit number from the parts, equal in every engine and for every partitioning: the head of md5 over the parts joined by |."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in cols))), 1, 8), 16, 10).cast("long")


def sql_hash(*parts: str) -> str:
    """The same in plain SQL; parts are expressions."""
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8)) AS BIGINT)"


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, and without negative zero."""
    return F.round(x.cast("double"), digits) + F.lit(0.0)


def number_text(x: Column) -> Column:
    """A double as DuckDB casts it to text: plain from 1e-4 up to below 1e16, else with an exponent of at least two digits."""
    text = x.cast("double").cast("string")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    sign, lead, rest = (F.regexp_extract(text, r"^(-?)(\d)\.(\d+)E", k) for k in (1, 2, 3))
    rest = F.when(rest == "0", "").otherwise(rest)
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), lead, rest)
    whole = F.rpad(F.concat(lead, rest), F.greatest(exponent + 1, F.length(rest) + 1), "0")
    large = F.concat(sign, F.substr(whole, F.lit(1), exponent + 1), F.lit("."), F.when(F.length(whole) > exponent + 1, F.substr(whole, exponent + 2)).otherwise("0"))
    far = F.concat(sign, lead, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), "0"))
    return F.when(~text.contains("E"), text).when(exponent.between(-4, -1), small).when(exponent.between(0, 15), large).otherwise(far)


def positions(df: DataFrame, order: list, keys: list[str] = [], name: str = "position", step: Column | None = None, ranged: bool = False) -> DataFrame:  # noqa: B006
    """df with the 0-based place of each row in `order` (within its keys), or the sum of `step` over the rows before it.

    Rows are range-partitioned once; each partition is numbered on its own and shifted by the totals of those before, of which
    there is one row a partition and key.  No task sees a whole group.  ranged: the partitions of df are such ranges already.
    """
    step = F.lit(1).cast("long") if step is None else step
    df = df.withColumn("_step", step)
    dealt = settled((df if ranged else df.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part", *keys).agg(F.sum("_step").alias("_n"))
    shift = totals.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_own", F.coalesce(F.sum("_step").over(own), F.lit(0)))
    return local.join(shift, ["_part", *keys]).withColumn(name, (F.col("_own") + F.col("_shift")).cast("long")).drop("_part", "_own", "_shift", "_step")
