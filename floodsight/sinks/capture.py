"""Captured packets as a table, one folder per attacked host."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.functions.addresses import ip_text


def write_capture(captured: DataFrame, path: str, mode: str = "append") -> None:
    """Store limited captures by host and day of the alarm, with its `minute`.

    A folder's rows are brought together before they are written, in files of a bounded size: else each task would write a
    file into nearly every folder. Folders by minute would be as many as a long capture has minutes, with a few rows in each.
    """
    minute = F.date_format("alarm_ts", "yyyyMMddHHmm")
    day = F.date_format("alarm_ts", "yyyyMMdd")
    named = captured.withColumns({"host": ip_text(F.col("dst_ip")), "day": day, "minute": minute.cast("bigint")})
    together = named.hint("rebalance", "host", "day").sortWithinPartitions("host", "day", "minute")
    together.write.partitionBy("host", "day").mode(mode).parquet(path)
