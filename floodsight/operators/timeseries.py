"""Time-series points of rates, and the dashboard queries over them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodsight.operators.counters import with_totals
from floodsight.operators.match import with_rule_id, with_rule_names
from floodsight.schemas import TYPE_ORDER

MONITOR_PERIOD = 60
_BLOCK_SAMPLES = 1024

# Limits of the severity bands, bits and packets per second.
BPS_BANDS = (500_000_000, 1_000_000_000)
PPS_BANDS = (1_000_000, 2_000_000)


def sample_grid(rules: DataFrame, first: int, last: int, period: int) -> DataFrame:
    """Every (rule_id, tick) with tick a multiple of `period` in first..last.

    Made in two steps with a shuffle of block starts between, so no task makes a rule's whole axis.
    """
    start = -(-first // period) * period
    if start > last:
        return with_rule_id(rules).select("rule_id", F.lit(0).cast("bigint").alias("tick")).limit(0)
    span = period * _BLOCK_SAMPLES
    starts = F.sequence(F.lit(start).cast("bigint"), F.lit(last).cast("bigint"), F.lit(span).cast("bigint"))
    blocks = with_rule_id(rules).select("rule_id", F.explode(starts).alias("_block"))
    ends = F.least(F.col("_block") + (span - period), F.lit(last).cast("bigint"))
    ticks = F.sequence("_block", ends, F.lit(period).cast("bigint"))
    return blocks.repartition("rule_id", "_block").select("rule_id", F.explode(ticks).alias("tick"))


def metric_points(
    rates: DataFrame, rules: DataFrame, period: int = MONITOR_PERIOD, epoch: int = 0, since: int | None = None, until: int | None = None
) -> DataFrame:
    """Points of every `period` seconds: the current rate of each rule (0 without traffic) and the
    total of each list; bits per second. A list without rules has a total of type ``none``. Rules with a `book`
    have points with one, and lists for each book.

    `rates` is a stored table: its first and last tick are looked up at once. `epoch` is the Unix
    time of tick 0; `since` and `until` start and end the points elsewhere than with the first and last rate.
    """
    ends = rates.agg(F.min("tick").alias("first"), F.max("tick").alias("last")).first()
    first, last = (0, -1) if ends["first"] is None else (ends["first"], ends["last"])
    first, last = first if since is None else since, last if until is None or ends["first"] is None and since is None else until
    grid = sample_grid(rules, first, last, period)
    sampled = rates.filter(F.pmod("tick", F.lit(period)) == 0).select("rule_id", "tick", "pps", "bps")
    zero = F.lit(0).cast("bigint")
    points = grid.join(sampled, ["rule_id", "tick"], "left").select(
        "rule_id", "tick", F.coalesce("pps", zero).alias("pps"), (F.coalesce("bps", zero) * 8).alias("bps")
    )
    keys = ["book"] if "book" in rules.columns else []
    points = with_rule_names(points, book=bool(keys))
    rolled = with_totals(points, ["pps", "bps"], (*keys, "tick"))
    is_total = F.col("rule_no").isNull()
    shaped = rolled.select(
        F.timestamp_seconds(F.col("tick") + epoch).alias("time"),
        F.when(is_total, F.lit("total")).otherwise(F.col("rule_type")).alias("measurement"),
        F.col("rule_no").alias("rule"),
        F.when(is_total, F.col("rule_type")).alias("type"),
        "pps",
        "bps",
        *keys,
    )
    if keys:
        return shaped
    present = {row[0] for row in rules.select("rule_type").distinct().collect()}
    times = grid.select("tick").distinct()
    for _ in range(len(TYPE_ORDER) - len(present)):
        none = times.select(
            F.timestamp_seconds(F.col("tick") + epoch).alias("time"),
            F.lit("total").alias("measurement"),
            F.lit(None).cast("int").alias("rule"),
            F.lit("none").alias("type"),
            zero.alias("pps"),
            zero.alias("bps"),
        )
        shaped = shaped.unionByName(none)
    return shaped


def _minute_means(points: DataFrame, key: str) -> DataFrame:
    grouped = points.groupBy(F.window("time", "1 minute").alias("_w"), "measurement", key)
    means = grouped.agg(F.avg("bps").alias("mean_bps"), F.avg("pps").alias("mean_pps"))
    return means.select(F.col("_w.start").alias("time"), "measurement", key, "mean_bps", "mean_pps")


def mean_1m_total(points: DataFrame) -> DataFrame:
    """Mean of the list totals per minute; minutes without points are left out."""
    means = _minute_means(points.filter("measurement = 'total'"), "type")
    return means.drop("measurement")


def mean_1m_rule(points: DataFrame, last_minutes: int | None = None) -> DataFrame:
    """Mean per rule and minute, optionally of the last minutes up to the newest point."""
    rules = points.filter("measurement <> 'total'")
    if last_minutes is not None:
        newest = rules.agg(F.max("time").alias("_newest"))
        since = F.col("_newest") - F.make_dt_interval(mins=F.lit(last_minutes))
        # One row of maxima: bounded, whatever the points are.
        rules = rules.join(F.broadcast(newest), F.col("time") >= since).drop("_newest")
    return _minute_means(rules, "rule")


def last_total(points: DataFrame) -> DataFrame:
    """The newest total in bits per second of each list."""
    totals = points.filter("measurement = 'total'")
    return totals.groupBy("type").agg(F.max_by("bps", "time").alias("bps"))


def tag_values(events: DataFrame, tag: str = "dst") -> DataFrame:
    return events.select(tag).distinct()


def severity(value: Column, bands: tuple[int, int]) -> Column:
    """0, 1 or 2: below the bands, from the first limit, from the second."""
    return F.when(value >= bands[1], F.lit(2)).when(value >= bands[0], F.lit(1)).otherwise(F.lit(0))


def event_history(events: DataFrame) -> DataFrame:
    """The alarm table of the dashboard, newest first."""
    table = events.select(
        "time",
        "dst",
        "bps",
        "pps",
        F.col("type").alias("protocol"),
        "comment",
        severity(F.col("bps"), BPS_BANDS).alias("bps_severity"),
        severity(F.col("pps"), PPS_BANDS).alias("pps_severity"),
    )
    return table.orderBy(F.desc("time"), "protocol", "dst")
