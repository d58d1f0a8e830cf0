"""Whole jobs: packets and rules to counters, alarms and the rule listing.

Packets are read once: they become counts by (rule, tick, destination), these a rule-tick table
that is stored. All later steps work on that small table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodsight.functions.rule_text import alarm_text
from floodsight.functions.sizes import size_text
from floodsight.operators.capture import CAPTURE_PACKETS, CAPTURE_SECONDS, first_captured, interval_capture
from floodsight.operators.counters import dst_counts, tick_profile, with_dst_text, with_totals
from floodsight.operators.match import match_packets, with_rule_id, with_rule_names
from floodsight.operators.rates import tick_rates
from floodsight.operators.rulesets import with_books
from floodsight.operators.triggers import alarms
from floodsight.schemas import PROTO, TYPE_ORDER
from floodsight.session import broadcast_if_small, settle
from floodsight.sources.packets import packets_between


def rule_tick_rates(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, tick, pps, bps in bytes, dst_ip = busiest destination); lazy."""
    return tick_rates(tick_profile(dst_counts(match_packets(packets, rules))))


def alarm_report(rates: DataFrame, rules: DataFrame, first_tick: int, epoch: int = 0, **options) -> DataFrame:
    """One row per alarm, with what is written about it. `bps` is in bits. `epoch` is the time of tick 0."""
    return written_alarms(alarms(rates, rules, first_tick, **options), rules, epoch)


def written_alarms(due: DataFrame, rules: DataFrame, epoch: int = 0) -> DataFrame:
    """Due alarms (rule_id, tick, pps, bps in bytes, dst_ip, trigger) with what is written about them."""
    version = F.col("version") if "version" in rules.columns else F.lit(None)
    about = with_rule_id(rules).select("rule_id", "ruleset_id", version.cast("int").alias("version"), "comment", "action_type", "action_param")
    report = with_dst_text(with_rule_names(due.join(about, "rule_id")))
    return report.select(
        "tick",
        F.timestamp_seconds(F.col("tick") + epoch).alias("time"),
        "rule_type",
        "rule_no",
        "trigger",
        "dst",
        "pps",
        (F.col("bps") * 8).alias("bps"),
        F.col("rule_type").alias("type"),
        "comment",
        "action_type",
        "action_param",
        alarm_text(F.col("rule_type"), F.col("dst"), F.col("comment")).alias("text"),
        "ruleset_id",
        "version",
    )


def traffic_alarms(
    packets: DataFrame, rules: DataFrame, first_tick: int | None = None, epoch: int = 0, versions: DataFrame | None = None
) -> DataFrame:
    """Packets to the alarm report. Without `first_tick`, rules are evaluated from the second tick of the packets on.

    Each ruleset of the table meets all packets. With `versions` (see `with_books`) a ruleset's version meets the packets of
    its time, and starts afresh: its first tick isn't evaluated.
    """
    if "book" not in rules.columns:
        rules = settle(with_books(rules, versions, epoch), "rules")
    if first_tick is None:
        earliest = packets.agg(F.min("tick")).first()[0]
        first_tick = 0 if earliest is None else earliest + 1
    rates = settle(rule_tick_rates(packets, rules), "rule-ticks")
    return alarm_report(rates, rules, first_tick, epoch)


def alarm_targets(due: DataFrame, rules: DataFrame, epoch: int = 0) -> DataFrame:
    """Alarms as captures need them: (rule_id, proto, dst_ip, ts). `due` has rule_id, tick and dst_ip."""
    proto = F.lit(None).cast("int")
    for name, number in PROTO.items():
        proto = F.when(F.col("rule_type") == name, F.lit(number)).otherwise(proto)
    about = with_rule_id(rules).select("rule_id", proto.alias("proto"))
    ts = F.timestamp_seconds(F.col("tick") + epoch).alias("ts")
    return due.join(about, "rule_id").select("rule_id", "proto", "dst_ip", ts)


def captured_packets(packets: DataFrame, targets: DataFrame, seconds: int = CAPTURE_SECONDS) -> DataFrame:
    """Packets to attacked hosts within `seconds` of their alarms.

    `targets` is a stored table: its time span is looked up and limits the packet scan, and it is
    broadcast if it is small.
    """
    return interval_capture(_near_targets(packets, targets, seconds), broadcast_if_small(targets), seconds)


def first_captured_packets(packets: DataFrame, targets: DataFrame, k: int = CAPTURE_PACKETS, seconds: int = CAPTURE_SECONDS) -> DataFrame:
    """The first k packets after each alarm, with their `position`."""
    return first_captured(_near_targets(packets, targets, seconds), targets, k, seconds)


def _near_targets(packets: DataFrame, targets: DataFrame, seconds: int) -> DataFrame:
    micros = F.unix_micros("ts")  # a collected timestamp would pass through the driver's time zone
    span = targets.agg(F.min(micros).alias("first"), F.max(micros).alias("last")).first()
    if span["first"] is None:
        return packets.limit(0)
    return packets_between(packets, span["first"], span["last"] + seconds * 1_000_000)


def list_rank(rule_type: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TYPE_ORDER)), rule_type).cast("int")


def ordered_rules(per_rule: DataFrame, sums: list[str]) -> DataFrame:
    """Rows per rule (`rule_type`, `rule_no`, sums), list by list, each list ended by its total; book by book where there are books."""
    keys = ["book"] if "book" in per_rule.columns else []
    rows = with_totals(per_rule, sums, tuple(keys))
    return rows.orderBy(*keys, list_rank(F.col("rule_type")), F.col("rule_no").asc_nulls_last())


def show_rules(counters: DataFrame, rates_now: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule listing as (list_rank, position, line): a heading, the rules and a total per list.

    `counters`: (rule_id, packets, bytes); `rates_now`: (rule_id, pps, bps in bytes) of one tick. Rules with a `book` have a
    listing for each book.
    """
    zero = F.lit(0).cast("bigint")
    keys = ["book"] if "book" in rules.columns else []
    listed = with_rule_id(rules).select("rule_id", "rule_type", "rule_no", "text_rule", *keys)
    rows = listed.join(counters, "rule_id", "left").join(rates_now.select("rule_id", "pps", "bps"), "rule_id", "left")
    rows = rows.withColumns({name: F.coalesce(name, zero) for name in ("packets", "bytes", "pps", "bps")})
    longest = listed.groupBy(*keys, "rule_type").agg(F.max(F.length("text_rule")).alias("_width"))
    rows = rows.join(longest, [*keys, "rule_type"])

    def amounts():
        return F.concat(
            size_text(F.col("pps"), bits=False), F.lit(" ("), size_text(F.col("bps"), bits=True), F.lit("), "),
            F.col("packets").cast("string"), F.lit(" packets, "), F.col("bytes").cast("string"), F.lit(" bytes"),
        )

    number = F.lpad(F.col("rule_no").cast("string"), 5, " ")
    number = F.when(F.col("rule_no") > 99999, F.col("rule_no").cast("string")).otherwise(number)
    rule_lines = rows.select(
        list_rank(F.col("rule_type")).alias("list_rank"),
        F.col("rule_no").cast("bigint").alias("position"),
        F.concat(number, F.lit(":   "), F.rpad("text_rule", F.col("_width"), " "), F.lit("  : "), amounts()).alias(
            "line"
        ),
        *keys,
    )
    lists = rules.sparkSession.createDataFrame([(name,) for name in TYPE_ORDER], "rule_type string")
    if keys:
        lists = listed.select(*keys).distinct().crossJoin(F.broadcast(lists))  # three lists a book
    sums = rows.groupBy(*keys, "rule_type").agg(*[F.sum(name).alias(name) for name in ("packets", "bytes", "pps", "bps")])
    totals = lists.join(sums, [*keys, "rule_type"], "left")
    totals = totals.withColumns({name: F.coalesce(name, zero) for name in ("packets", "bytes", "pps", "bps")})
    last = F.lit(2**31).cast("bigint")
    total_lines = totals.select(
        list_rank(F.col("rule_type")).alias("list_rank"),
        last.alias("position"),
        F.concat(F.lit("Total: "), amounts()).alias("line"),
        *keys,
    )
    headings = lists.select(
        list_rank(F.col("rule_type")).alias("list_rank"),
        F.lit(-1).cast("bigint").alias("position"),
        F.concat(F.upper("rule_type"), F.lit(" rules (num, rule, counter):")).alias("line"),
        *keys,
    )
    return headings.unionByName(rule_lines).unionByName(total_lines).orderBy(*keys, "list_rank", "position")
