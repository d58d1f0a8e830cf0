"""Captures of a stream: packets to attacked hosts, joined to the alarms as both come in."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.operators.capture import CAPTURE_SECONDS, bucket_of


def stream_captures(packets: DataFrame, alarms: DataFrame, delay: str, alarm_delay: str | None = None, seconds: int = CAPTURE_SECONDS) -> DataFrame:
    """Packets of the alarm's protocol to its host within `seconds` of the alarm, as `interval_capture` has them.

    `packets` and `alarms` (rule_id, proto, dst_ip, ts) are streams; `delay` says how late packets may come, `alarm_delay` how
    late alarms, which are found after their packets. The bounds on time let Spark drop a packet from the state once
    no alarm can reach it, and an alarm once its time is over. The key has a time bucket as well, as in `interval_capture`: an alarm
    looks through the packets of two buckets of its host, not through all of them that are in the state.
    """
    packets = packets.withWatermark("ts", delay)
    alarms = alarms.select(
        F.col("rule_id").alias("alarm_rule_id"), F.col("ts").alias("alarm_ts"), F.col("proto").alias("_proto"), F.col("dst_ip").alias("_dst_ip"),
        F.explode(F.sequence(bucket_of("ts", seconds), bucket_of("ts", seconds) + 1)).alias("_alarm_bucket"),
    ).withWatermark("alarm_ts", alarm_delay or delay)
    end = F.col("alarm_ts") + F.expr(f"INTERVAL {seconds} SECONDS")
    same = (F.col("proto") == F.col("_proto")) & (F.col("dst_ip") == F.col("_dst_ip")) & (F.col("_bucket") == F.col("_alarm_bucket"))
    keyed = packets.withColumn("_bucket", bucket_of("ts", seconds))
    met = keyed.join(alarms, same & (F.col("ts") >= F.col("alarm_ts")) & (F.col("ts") <= end))
    return met.select("alarm_rule_id", "alarm_ts", *packets.columns)
