"""Packet and byte counters.

The group keys hold `rule_id` (a LONG), so map-side aggregation collapses a flood before the
shuffle, however hot its rule or its destination is.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodsight.functions.addresses import ip_text
from floodsight.operators.match import with_rule_id
from floodsight.operators.segments import SEGMENT_WIDTH, running_sum
from floodsight.session import broadcast_if_small
ADDRESSES = 2**32


def count_by(matched: DataFrame, *keys: str) -> DataFrame:
    """Packets and bytes of matched packets by any keys."""
    packets, size = F.count(F.lit(1)).alias("packets"), F.sum("frame_len").alias("bytes")
    return matched.groupBy(*keys).agg(packets, size)


def rule_ticks(matched: DataFrame) -> DataFrame:
    return count_by(matched, "rule_id", "tick")


def dst_counts(matched: DataFrame) -> DataFrame:
    return count_by(matched, "rule_id", "tick", "dst_ip")


def rule_counters(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """Counters per rule, 0 for rules without traffic. `counts` holds packets and bytes by `rule_id`."""
    totals = counts.groupBy("rule_id").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    listed = with_rule_id(rules).select("rule_id")
    zero = F.lit(0).cast("bigint")
    return listed.join(totals, "rule_id", "left").select(
        "rule_id", F.coalesce("packets", zero).alias("packets"), F.coalesce("bytes", zero).alias("bytes")
    )


def merge_partials(partials: list[DataFrame], keys: list[str], rules: DataFrame) -> DataFrame:
    """Add up partial counters (packets, bytes by `keys`, one of them `rule_id`) of several sources.

    A rule that `rules` does not know fails the job.
    """
    merged = partials[0]
    for part in partials[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy(*keys).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    known = broadcast_if_small(with_rule_id(rules).select("rule_id", F.lit(True).alias("_known")))
    checked = merged.join(known, "rule_id", "left")
    unknown = F.raise_error(F.concat(F.lit("partial counters of an unknown rule: "), F.col("rule_id").cast("string")))
    # The check sits inside a result column, so that it cannot be pruned away.
    packets = F.when(F.col("_known"), F.col("packets")).otherwise(unknown.cast("bigint"))
    return checked.select(*keys, packets.alias("packets"), "bytes")


def running_totals(ticks: DataFrame, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Counters since the start, as of each tick."""
    sums = {"total_packets": "packets", "total_bytes": "bytes"}
    return running_sum(ticks, ["rule_id"], "tick", sums, width)


def tick_profile(counts: DataFrame, keys: tuple[str, ...] = ("rule_id", "tick")) -> DataFrame:
    """Per rule and tick: packets, bytes and the busiest destination, from counts by destination.

    Ties go to the lowest address. Count and address are packed into one LONG, which keeps this a hash
    aggregate with map-side combine. A destination with 2^31 packets or more at one key fails the job.
    """
    return counts.groupBy(*keys).agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), busiest().alias("dst_ip")
    )


def busiest() -> Column:
    """The aggregate that finds the destination with most `packets`."""
    beyond = F.raise_error(F.lit("2^31 packets or more to one destination at one key")).cast("bigint")
    count = F.when(F.col("packets") < 2**31, F.col("packets")).otherwise(beyond)
    packed = count * ADDRESSES + (ADDRESSES - 1 - F.col("dst_ip"))
    return ADDRESSES - 1 - F.pmod(F.max(packed), F.lit(ADDRESSES))


def top_destinations(counts: DataFrame, k: int) -> DataFrame:
    """The k busiest destinations per rule and tick, ranked from 1."""
    order = Window.partitionBy("rule_id", "tick").orderBy(F.desc("packets"), "dst_ip")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_dst_text(df: DataFrame) -> DataFrame:
    """Add `dst`, dotted; ``0.0.0.0`` where no destination was counted."""
    return df.withColumn("dst", ip_text(F.coalesce(F.col("dst_ip"), F.lit(0).cast("bigint"))))


def with_totals(per_rule: DataFrame, sums: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows per rule and a total per list (`rule_no` NULL) in one pass; `keys` (say, `book`) keep lists apart."""
    lists = [*keys, "rule_type"]
    rolled = per_rule.groupingSets([[*lists, "rule_no"], lists], *lists, "rule_no")
    return rolled.agg(*[F.sum(name).alias(name) for name in sums])
