"""Streaming counters per one-second tick.

Rows later than the watermark of the batch before are dropped by Spark, which counts them in each
batch's ``numRowsDroppedByWatermark``. A tick comes out once, when the watermark has passed it, so
give a `delay` that covers how late packets may come.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.operators.counters import busiest
from floodsight.operators.match import RuleSet, first_match

SECOND = "1 second"


def tick_dst_counts(packets: DataFrame, ruleset: RuleSet, delay: str) -> DataFrame:
    """Counts by (window, rule_id, dst_ip) of a stream of packets."""
    matched = first_match(packets.withWatermark("ts", delay), ruleset)
    return matched.groupBy(F.window("ts", SECOND), "rule_id", "dst_ip").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("frame_len").alias("bytes")
    )


def tick_counts(packets: DataFrame, ruleset: RuleSet, delay: str) -> DataFrame:
    """Counts by (tick, rule_id) of a stream of packets."""
    matched = first_match(packets.withWatermark("ts", delay), ruleset)
    counts = matched.groupBy(F.window("ts", SECOND), "rule_id").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("frame_len").alias("bytes")
    )
    return counts.select(_tick("window"), "rule_id", "packets", "bytes")


def tick_profile(packets: DataFrame, ruleset: RuleSet, delay: str) -> DataFrame:
    """(ts of the tick, tick, rule_id, pps, bps in bytes, dst_ip = busiest destination).

    Two windowed counts in a row: by destination, then over them; destinations never meet in
    one task, only their counts do.
    """
    return profile_of_counts(tick_dst_counts(packets, ruleset, delay))


def profile_of_counts(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The profile from counts by (window, rule_id, dst_ip, keys); `keys` are the same for all rows of a rule."""
    profile = counts.groupBy(F.window(F.window_time("window"), SECOND).alias("second"), "rule_id", *keys).agg(
        F.sum("packets").alias("pps"), F.sum("bytes").alias("bps"), busiest().alias("dst_ip")
    )
    return profile.select(F.window_time("second").alias("ts"), _tick("second"), "rule_id", "pps", "bps", "dst_ip", *keys)


def _tick(window: str):
    return F.unix_seconds(F.col(f"{window}.start")).alias("tick")
