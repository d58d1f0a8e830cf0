"""Threshold triggers over rule-tick rates.

Input `rates`: (rule_id, tick, pps, bps in bytes/s[, dst_ip]), one row per rule and tick with
traffic; an absent tick has rate 0. Rules carry thresholds and periods; rules are evaluated
from `first_tick` on, when nothing has been "good" yet. It is the second tick of the traffic, or of
the version that a rule belongs to; there is no default for it here, as rates don't tell it.

A threshold fires when its rate is above it and more than `period` ticks went by since the last
good tick or the last firing. A rule with one threshold has a closed form over its runs of
ticks above it. With both, a packet alarm hides the byte test of its tick, so the byte state is
walked, one bounded segment of ticks at a time.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.operators import byte_walk
from floodsight.operators.match import with_rule_id
from floodsight.operators.segments import SEGMENT_WIDTH, island_start, segment_of
from floodsight.session import broadcast_if_small

LIMITS = ["pps_th", "bps_th", "pps_period", "bps_period", "first_tick"]


def limits_of(rules: DataFrame, first_tick: int) -> DataFrame:
    """(rule_id, thresholds, periods, first_tick); rules that bring a `first_tick` of their own (see `with_books`) keep it."""
    own = F.col("first_tick") if "first_tick" in rules.columns else F.lit(None)
    return with_rule_id(rules).withColumn("first_tick", F.coalesce(own, F.lit(first_tick)).cast("bigint")).select("rule_id", *LIMITS)


def with_limits(rates: DataFrame, rules: DataFrame, first_tick: int) -> DataFrame:
    """Join thresholds."""
    # By rule id alone a busy rule would be one task, so the rules come to the rates.
    joined = rates.join(broadcast_if_small(limits_of(rules, first_tick)), "rule_id")
    return joined.filter(F.col("tick") >= F.col("first_tick"))


def above(rates: DataFrame, rules: DataFrame, first_tick: int) -> DataFrame:
    """Rows above a threshold, with `pps_above` and `bps_above`; both comparisons are strict."""
    df = with_limits(rates, rules, first_tick)
    df = df.withColumns(
        {
            "pps_above": (F.col("pps_th") > 0) & (F.col("pps") > F.col("pps_th")),
            "bps_above": (F.col("bps_th") > 0) & (F.col("bps") > F.col("bps_th")),
        }
    )
    return df.filter("pps_above OR bps_above")


def _due(rows: DataFrame, width: int) -> DataFrame:
    """Rows above each threshold with `kind` (pps or bps) and `due`, by the closed form.

    Runs of both kinds go through one set of windows. Bytes of rules with two thresholds are left
    out: their test depends on the packet alarms.
    """
    kinds = F.array(
        F.struct(F.lit("pps").alias("kind"), F.col("pps_above").alias("over"), F.col("pps_period").alias("period")),
        F.struct(
            F.lit("bps").alias("kind"),
            (F.col("bps_above") & (F.col("pps_th") == 0)).alias("over"),
            F.col("bps_period").alias("period"),
        ),
    )
    runs = rows.select("*", F.inline(kinds)).filter("over").drop("over")
    runs = island_start(runs, ["rule_id", "kind"], "tick", width)
    waited = F.col("tick") - F.col("island_start")
    # A run from the very first tick has no good tick before it and is due at once.
    waited = F.when(F.col("island_start") == F.col("first_tick"), waited).otherwise(waited + 1)
    return runs.withColumn("due", waited % (F.col("period") + 1) == 0).drop("island_start", "period")


_ONE = "pps_th = 0 OR bps_th = 0"
_BOTH = "pps_th > 0 AND bps_th > 0"


def single_alarms(
    rates: DataFrame, rules: DataFrame, first_tick: int, width: int = SEGMENT_WIDTH
) -> DataFrame:
    """Due ticks of rules with one threshold; `trigger` is pps or bps."""
    due = _due(above(rates, rules, first_tick).filter(_ONE), width).filter("due")
    return due.select(*rates.columns, F.col("kind").alias("trigger"))


def dual_alarms(
    rates: DataFrame, rules: DataFrame, first_tick: int, width: int = SEGMENT_WIDTH
) -> DataFrame:
    """Due ticks of rules with both thresholds; at most one alarm per rule and tick."""
    rows = above(rates, rules, first_tick).filter(_BOTH)
    counted = F.col("dst_ip").isNotNull() if "dst_ip" in rates.columns else F.lit(True)
    # Packets first: they do not depend on the byte test. A swallowed alarm hides nothing.
    packets = _due(rows, width).withColumn("pps_fired", F.col("due") & counted).drop("due", "kind")
    rest = rows.filter("NOT pps_above").withColumn("pps_fired", F.lit(False))
    both = packets.unionByName(rest).withColumn("_segment", segment_of("tick", width))
    walked = _walk_bytes(both, width)
    fired = F.when(F.col("pps_fired"), F.lit("pps")).when(F.col("bps_due"), F.lit("bps"))
    due = walked.withColumn("trigger", fired).filter("trigger IS NOT NULL")
    return due.select(*rates.columns, "trigger")


def _walk_bytes(rows: DataFrame, width: int) -> DataFrame:
    """Add `bps_due`. Segments are walked apart; what a segment needs from the one before is its
    `age`: ticks since the last good or fired one, from 0 to the period (more is the same). How a segment changes
    the age is a step function, so a first pass sums up all segments apart from each other."""
    keys = ["rule_id", "_segment"]
    needed = rows.select(*keys, "tick", "bps_above", "pps_fired", "bps_period", "first_tick")

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        return byte_walk.segment_exits(pdf.sort_values("tick"), width)

    def entries(parts):
        return byte_walk.segment_entries(parts, width)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        return byte_walk.segment_fires(pdf.sort_values("tick"))

    summary = needed.groupBy(*keys).applyInPandas(
        exits, "rule_id long, _segment long, bps_period long, first_tick long, exits array<struct<age:long,exit:long,slope:long>>"
    )
    # A short row per segment, streamed in order: a year of ticks is some 60,000 of them.
    ordered = summary.repartition("rule_id").sortWithinPartitions("rule_id", "_segment")
    started = ordered.mapInArrow(entries, "rule_id long, _segment long, age long")
    flagged = needed.join(started, keys).groupBy(*keys).applyInPandas(
        walk, "rule_id long, _segment long, tick long, bps_due boolean"
    )
    return rows.join(flagged, [*keys, "tick"])


def alarms(rates: DataFrame, rules: DataFrame, first_tick: int, width: int = SEGMENT_WIDTH) -> DataFrame:
    """All alarms. An alarm that is due without a counted destination is swallowed."""
    due = single_alarms(rates, rules, first_tick, width).unionByName(
        dual_alarms(rates, rules, first_tick, width)
    )
    return due.filter("dst_ip IS NOT NULL") if "dst_ip" in rates.columns else due


def guard(due: DataFrame, counts: DataFrame) -> DataFrame:
    """Keep due alarms of rule-ticks with a counted destination, when `due` does not carry it."""
    return due.join(counts.select("rule_id", "tick").distinct(), ["rule_id", "tick"], "left_semi")
