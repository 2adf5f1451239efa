"""An extension: pair rows that arrive over time, appended once each to a token store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairforge.operators.encode import Encoder, encode


def ingest(stream: DataFrame, path: str, checkpoint: str, factory: Callable[[], Encoder], late: str = "1 day") -> StreamingQuery:
    """Encodes new (row_idx, text, at) rows; repeats of a row within `late` are dropped.  A batch that is run again replaces its own folder."""
    fresh = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["row_idx"])

    def add(batch: DataFrame, epoch: int) -> None:
        tokens = encode(batch, "text", factory).select("row_idx", F.posexplode("tokens").alias("pos", "v"))
        tokens.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
