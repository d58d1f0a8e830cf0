"""How far a stream has come, by its checkpoint.

A stream's last ticks stay inside it, since nothing later moves the watermark past them. Where a stream is finite, a closing
step takes over from the last committed watermark: it works out in batch what the rows past it amount to. Do so once, when no
more rows will come; a stream that goes on would give these ticks out again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watermark_of(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """The watermark of a batch, in Unix milliseconds; known from its start on. 0 before any."""
    lines = spark.read.text(f"{checkpoint}/offsets/{batch_id}")
    found = lines.select(F.get_json_object("value", "$.batchWatermarkMs").cast("bigint").alias("ms")).agg(F.max("ms")).first()[0]
    return found or 0


def committed_watermark(spark: SparkSession, checkpoint: str) -> int:
    """The watermark of the last batch that was committed: every second that ended by then has come out."""
    commits = spark.read.text(f"{checkpoint}/commits").select(F.col("_metadata.file_name").try_cast("bigint").alias("batch"))
    last = commits.agg(F.max("batch")).first()[0]
    return 0 if last is None else watermark_of(spark, checkpoint, last)


def open_packets(packets: DataFrame, checkpoint: str) -> DataFrame:
    """The packets, read in batch, of the seconds that the stream with this checkpoint has left open.

    Of packets that came too late for the stream none is in an open second.
    """
    first = committed_watermark(packets.sparkSession, checkpoint) // 1000
    return packets.filter(F.col("ts") >= F.timestamp_seconds(F.lit(first)))
