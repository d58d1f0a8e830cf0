"""Packets to an attacked host after an alarm."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodsight.session import broadcast_if_small, settle

# A capture ends after this many packets or seconds.
CAPTURE_PACKETS = 1000
CAPTURE_SECONDS = 60


def interval_capture(packets: DataFrame, alarms: DataFrame, seconds: int = CAPTURE_SECONDS) -> DataFrame:
    """Packets of the alarm's protocol to its host within `seconds` of the alarm.

    `alarms`: (rule_id, proto, dst_ip, ts). The join key has a time bucket of `seconds` as well, so
    a host that is flooded for hours is many keys; an alarm lies in at most two buckets.
    """
    end = F.col("ts") + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    spans = alarms.select(
        F.col("rule_id").alias("alarm_rule_id"),
        F.col("ts").alias("alarm_ts"),
        end.alias("alarm_end"),
        "proto",
        "dst_ip",
        F.explode(F.sequence(bucket_of("ts", seconds), bucket_of("ts", seconds) + 1)).alias("_bucket"),
    )
    keyed = packets.withColumn("_bucket", bucket_of("ts", seconds))
    joined = keyed.join(spans, ["proto", "dst_ip", "_bucket"])
    joined = joined.filter(F.col("ts").between(F.col("alarm_ts"), F.col("alarm_end")))
    return joined.select("alarm_rule_id", "alarm_ts", *packets.columns)


def bucket_of(column: str, seconds: int):
    return F.call_function("div", F.unix_seconds(column), F.lit(seconds))


def first_captured(packets: DataFrame, alarms: DataFrame, k: int = CAPTURE_PACKETS, seconds: int = CAPTURE_SECONDS) -> DataFrame:
    """`limit_capture(interval_capture(..))` without joining a flood to its alarms.

    Packets of attacked hosts are first cut to the first k of each protocol, host and second; no alarm can take more of a second
    than these. So at most k packets for each of its seconds meet an alarm, however large the flood is and however many alarms
    overlap. Alarms are of whole seconds (others fail the job). `alarms` is a stored table.
    """
    micros = F.unix_micros("ts")
    odd = F.raise_error(F.lit("an alarm is not at a whole second")).cast("bigint")
    second = F.when(micros % 1_000_000 == 0, F.unix_seconds("ts")).otherwise(odd)
    attacked = alarms.select("proto", "dst_ip", F.explode(F.sequence(second, second + seconds)).alias("_second")).distinct()
    busy = packets.withColumn("_second", F.unix_seconds("ts")).join(broadcast_if_small(settle(attacked, "attacked")), ["proto", "dst_ip", "_second"], "left_semi")
    order = Window.partitionBy("proto", "dst_ip", "_second").orderBy("ts", "pkt_id")
    first = busy.withColumn("_turn", F.row_number().over(order)).filter(F.col("_turn") <= k).select(*packets.columns)
    return limit_capture(interval_capture(first, broadcast_if_small(alarms), seconds), k)


def limit_capture(captured: DataFrame, k: int = CAPTURE_PACKETS) -> DataFrame:
    """The first k packets of each alarm.

    Spark cuts each map task to k rows per alarm before the shuffle (window group limit), so an
    alarm's task gets k rows per map task at most, not the flood. For k above
    ``spark.sql.optimizer.windowGroupLimitThreshold`` raise that setting as well.
    """
    order = Window.partitionBy("alarm_rule_id", "alarm_ts").orderBy("ts", "pkt_id")
    return captured.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
