"""Packet tables: reading, streaming in, and storing them for pruned reads."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from floodsight.schemas import PACKETS


def with_tick(packets: DataFrame) -> DataFrame:
    """Add `tick`, the whole second of `ts`. Rates and triggers work on ticks."""
    return packets.withColumn("tick", F.unix_seconds("ts"))


def day_of(ts: Column) -> Column:
    """The day in UTC, whatever the session's time zone is."""
    return F.date_from_unix_date(F.call_function("div", F.unix_micros(ts), F.lit(86_400_000_000)).cast("int"))


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """A packet table; one that `store_packets` laid out has its `day` as a column, so that ranges of time find its folders."""
    names = PACKETS.fieldNames()
    schema = PACKETS
    if "day" in spark.read.parquet(path).columns:
        schema = StructType([*PACKETS.fields, StructField("day", DateType())])
        names = [*names, "day"]
    return with_tick(spark.read.schema(schema).parquet(path).select(names))


def packets_between(packets: DataFrame, first_us: int, last_us: int) -> DataFrame:
    """Packets of a range of time, both ends included, in Unix microseconds; of a stored table only the days' folders are read."""
    first, last = (F.timestamp_micros(F.lit(x)) for x in (first_us, last_us))
    found = packets.filter(F.col("ts").between(first, last))
    if "day" in packets.columns:
        found = found.filter(F.col("day").between(*(F.date_from_unix_date(F.lit(x // 86_400_000_000)) for x in (first_us, last_us))))
    return found


def stream_packets(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PACKETS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_tick(reader.parquet(path).select(PACKETS.fieldNames()))


def store_packets(packets: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write packets by day (UTC) and protocol, range-sorted by time so that row groups hold short spans.

    A list of rules then reads the folders of its own protocol only. The split is on (ts, pkt_id),
    never on an address, so a flooded host spreads over many files.
    """
    day = packets.select(PACKETS.fieldNames()).withColumn("day", day_of(F.col("ts")))
    order = ["day", "proto", "ts", "pkt_id"]
    spread = day.repartitionByRange(partitions, *order) if partitions else day.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.partitionBy("day", "proto").mode("append").parquet(path)
