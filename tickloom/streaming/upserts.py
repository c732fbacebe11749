"""Bars that arrive as files: a stream merged into a kept panel.

A micro-batch brings the panel up to date in the commit that takes its bars in: late
corrections win over the stored bar, only their symbols are computed again, and only the
months that change are read and written. The stream's batch number goes with the commit, so a
batch that is sent again after a lost executor or driver changes nothing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schema import BARS
from ..sources.panels import PanelStore


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(BARS).parquet(path)


def start_upserts(stream: DataFrame, store: PanelStore, checkpoint: str, writer: str = "stream") -> StreamingQuery:
    """Merge everything that has arrived, then stop; run again for more. ``writer`` names the
    stream in the store: a new checkpoint folder counts its batches anew and needs a new name."""
    return (stream.writeStream
            .foreachBatch(lambda batch, i: store.extend(batch, writer, i) and None)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
