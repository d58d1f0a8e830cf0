"""Streaming publication: one table write per micro-batch."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from floodsight.operators.counters import dst_counts
from floodsight.operators.match import match_packets
from floodsight.operators.rates import tick_rates
from floodsight.operators.timeseries import MONITOR_PERIOD, metric_points
from floodsight.operators.triggers import limits_of
from floodsight.session import broadcast_if_small
from floodsight.streaming.watermarks import committed_watermark, watermark_of


def run_to_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a parquet table, exactly once per batch."""
    writer = stream.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def publish(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    period: int | None = None,
) -> StreamingQuery:
    """Call `write(batch, batch_id)` every `period` seconds, or over all there is when None.

    A batch may come again after a failure with the same id: `write` should replace, not add.
    """
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": f"{period} seconds"} if period else {"availableNow": True}
    return writer.trigger(**trigger).start()


def batch_folder(path: str, batch_id: int) -> str:
    """Where a batch goes, so that a repeated batch overwrites itself."""
    return f"{path}/batch={batch_id}"


def batches_into(path: str, write: Callable[..., None], make: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> Callable[[DataFrame, int], None]:
    """A writer for `publish` out of one that takes (rows, path, mode): alarm logs, points, captures. Each batch has a folder of
    its own and replaces it, so a batch that comes again after a failure leaves what it left before."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        write(make(batch), batch_folder(path, batch_id), mode="overwrite")

    return write_batch


def reloading_counts(
    packets: DataFrame, read_rules: Callable[[], DataFrame], path: str, checkpoint: str, first_tick: int, period: int | None = None
) -> StreamingQuery:
    """Counts by rule, tick and destination with the rules read again for every micro-batch.

    Rules with books (`with_books`, numbered by the versions table) meet the packets of their time. Writes partial counts (ts and
    tick, rule_id, dst_ip, packets, bytes) with the limits of their rules, so that what reads them needs no rules: a tick may lie in
    two batches, so add them up when reading (`merge_partials`, `alarms_of_counts`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rules = read_rules()
        counts = dst_counts(match_packets(batch, rules)).join(broadcast_if_small(limits_of(rules, first_tick)), "rule_id")
        counts = counts.withColumn("ts", F.timestamp_seconds("tick"))
        counts.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return publish(packets, write, checkpoint, period)


def publish_rates(ticks: DataFrame, rules: DataFrame, path: str, checkpoint: str, sample: int = MONITOR_PERIOD) -> StreamingQuery:
    """Metric points of a stream of tick counts (`tick_counts`), one every `sample` seconds of traffic.

    A batch gives out the points of the seconds that ended between the watermark of the batch before and its own, so seconds
    without any packet get their zero points too, and nothing that was written is read. Points begin with the first tick.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, now = (watermark_of(spark, checkpoint, n) // 1000 if n >= 0 else 0 for n in (batch_id - 1, batch_id))
        batch.persist()
        try:
            since, until = (before, now - 1) if before else (None, now - 1 if now else None)
            points = metric_points(tick_rates(batch), rules, sample, since=since, until=until)
            points.write.mode("overwrite").parquet(batch_folder(path, batch_id))
        finally:
            batch.unpersist()

    return publish(ticks, write, checkpoint)


def closing_points(rates: DataFrame, rules: DataFrame, checkpoint: str, sample: int = MONITOR_PERIOD) -> DataFrame:
    """The points of the seconds that a finished stream has left open; `rates` are theirs."""
    return metric_points(rates, rules, sample, since=committed_watermark(rates.sparkSession, checkpoint) // 1000)
