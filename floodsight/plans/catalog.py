"""The registered queries: every operator run over packets derived from the `events` table.

Columns are plain numbers and texts (a time is a tick or Unix seconds), so that results compare
with SQL. Rule ids are shown as `rule_type` and `rule_no`.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodsight.functions.predicates import compare, flags_match, in_range
from floodsight.operators import counters, match, rates, rulesets, timeseries, triggers
from floodsight.operators.match import with_rule_names
from floodsight.plans import fixtures, reports
from floodsight.schemas import FRAMES, PACKETS, RULE_TEXTS, TYPE_ORDER
from floodsight.session import broadcast_if_small, scratch_path, settle
from floodsight.sinks import alarm_log, line_protocol
from floodsight.sinks.capture import write_capture
from floodsight.sources import frames
from floodsight.sources.packets import read_packets, store_packets, with_tick
from floodsight.sources.rules import load_rules
from floodsight.streaming import monitor, ticks, watermarks
from floodsight.streaming.captures import stream_captures
from floodsight.streaming.triggers import alarms_of_counts, closing_alarms, stream_alarms

Query = Callable[[SparkSession, str], DataFrame]
SAMPLE_PERIOD = 10
TOP = 3
CAPTURED = 50
BATCHES = 4

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# --- shared inputs ------------------------------------------------------------------------


def _packets(spark, sf_dir):
    return fixtures.packets(spark, sf_dir)


def _matched(spark, sf_dir):
    return match.first_match(_packets(spark, sf_dir), fixtures.ruleset(spark))


def _rates(spark, sf_dir):
    """The rule-tick table, stored: packets are read once, whatever reads it."""
    profile = counters.tick_profile(counters.dst_counts(_matched(spark, sf_dir)))
    return settle(rates.tick_rates(profile), "rule-ticks")


def _alarm_report(spark, sf_dir):
    table = _rates(spark, sf_dir)
    return reports.alarm_report(table, fixtures.rules(spark), fixtures.FIRST_TICK, fixtures.EPOCH)


def _points(spark, sf_dir):
    table = _rates(spark, sf_dir)
    return timeseries.metric_points(table, fixtures.rules(spark), SAMPLE_PERIOD, fixtures.EPOCH)


def _stream(spark, sf_dir):
    """The `events` table as a stream of packets."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _by_time(fixtures.packets_of(events))


def _seconds(column):
    return F.unix_seconds(column).alias(column)


def _tick(column):
    return (F.unix_seconds(column) - fixtures.EPOCH).alias("tick")


# --- sources and sinks --------------------------------------------------------------------

_PACKET_COLUMNS = [f.name for f in PACKETS.fields if f.name != "ts"]


@query
def src_frames(spark, sf_dir):
    packed = fixtures.frames_of(_packets(spark, sf_dir))
    return frames.frame_packets(packed).select(*_PACKET_COLUMNS, _tick("ts"))


@query
def src_packets(spark, sf_dir):
    path = scratch_path(spark, "packets")
    store_packets(_packets(spark, sf_dir), path)
    return read_packets(spark, path).select(*_PACKET_COLUMNS, (F.col("tick") - fixtures.EPOCH).alias("tick"))


def _rule_texts(spark, sf_dir, newer: bool = False):
    """A rule line for every event, several of them wrong; rulesets by user."""
    event, user = F.col("event_id"), F.col("user_id")
    host = (user % 256).cast("string")
    whole = F.floor("value").cast("bigint")
    number = 1 + whole + (F.when(F.col("event_type") == "purchase", 1).otherwise(0) if newer else 0)
    shape = event % 8

    def line(template, *values):
        return F.format_string(template, *[value.cast("string") for value in values])

    texts = (
        F.when(shape == 0, line("TCP -d 203.0.113.%s/32 --pps-th %sKp --dport %s-443 --next", host, number, user % 80))
        .when(shape == 1, line("UDP --srcip=198.51.100.%s/%s --bps-th %sMb --hlen >%s", host, 24 + user % 9, number, user))
        .when(shape == 2, line("ICMP -d10.%s.0.0/16 --pps-th %sp --type =8 --code <%s -a log:/var/log/%s.log", host, number, user % 16, user % 5))
        .when(shape == 3, line("# a comment about %s", user))
        .when(shape == 4, line("SCTP -d 203.0.113.%s --pps-th %sp", host, number))
        .when(shape == 5, line("TCP -d 203.0.113.%s --pps-th-per 7 --pps-th %sp", user % 512, number))
        .when(shape == 6, line("UDP --dst 10.0.0.0/8 --bps-th %sb", user % 16))
        .otherwise(line('TCP -d 0.0.0.0/0 --pps-th 5p --tcp-flag S:1,A:0,S:%s -c "user %s" --seq >%s', user % 2, user, event))
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.concat(F.lit("rs"), (user % 7).cast("string")).alias("ruleset_id"),
        event.alias("line_no"),
        texts.alias("line"),
    ).to(RULE_TEXTS)


_RULE_COLUMNS = [
    "ruleset_id", "rule_type", "rule_no", "text_rule", "src_lo", "src_hi", "dst_lo", "dst_hi", "dport_lo", "dport_hi",
    "seq_op", "seq_num", "hlen_op", "hlen_num", "flag_bits", "flag_mask", "type_op", "type_num", "code_op", "code_num",
    "pps_th", "bps_th", "pps_period", "bps_period", "next_rule", "action_type", "action_param", "comment",
]


@query
def src_rules(spark, sf_dir):
    accepted, _ = load_rules(_rule_texts(spark, sf_dir))
    return accepted.select(*_RULE_COLUMNS)


@query
def src_rules_rejects(spark, sf_dir):
    _, rejected = load_rules(_rule_texts(spark, sf_dir))
    return rejected


@query
def sink_alarm_log(spark, sf_dir):
    path = scratch_path(spark, "alarm-log")
    alarm_log.write_alarm_log(_alarm_report(spark, sf_dir), path)
    return alarm_log.read_alarm_log(spark, path)


def _written_lines(spark, lines, name):
    path = scratch_path(spark, name)
    line_protocol.write_lines(lines, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def sink_metrics_lp(spark, sf_dir):
    return _written_lines(spark, line_protocol.metric_lines(_points(spark, sf_dir)), "metric-lines")


@query
def sink_event_lp(spark, sf_dir):
    return _written_lines(spark, line_protocol.event_lines(_alarm_report(spark, sf_dir)), "event-lines")


def _targets(spark, sf_dir):
    """The alarms as a stored table, so its size is known before it is broadcast."""
    rules = fixtures.rules(spark)
    due = triggers.alarms(_rates(spark, sf_dir), rules, fixtures.FIRST_TICK)
    return settle(reports.alarm_targets(due, rules, fixtures.EPOCH), "alarms")


def _capture_columns(captured):
    named = with_rule_names(captured.withColumnRenamed("alarm_rule_id", "rule_id"))
    alarm_tick = (F.unix_seconds("alarm_ts") - fixtures.EPOCH).alias("alarm_tick")
    extra = ["position"] if "position" in captured.columns else []
    return named.select("rule_type", "rule_no", alarm_tick, "pkt_id", "dst_ip", "tick", *extra)


@query
def sink_capture(spark, sf_dir):
    path = scratch_path(spark, "capture")
    write_capture(reports.first_captured_packets(_packets(spark, sf_dir), _targets(spark, sf_dir)), path)
    return _capture_columns(spark.read.parquet(path))


@query
def sink_monitor(spark, sf_dir):
    points = _points(spark, sf_dir)
    return points.select(_tick("time"), "measurement", "rule", "type", "pps", "bps")


# --- filters ------------------------------------------------------------------------------


@query
def route_proto(spark, sf_dir):
    return match.route_proto(_packets(spark, sf_dir)).select("pkt_id", "rule_type")


@query
def flt_ip_range(spark, sf_dir):
    lo, hi = F.lit(3325256704), F.lit(3325256831)
    inside = in_range(F.col("src_ip"), lo, hi) & in_range(F.col("dst_ip"), F.lit(0), F.lit(3405803783))
    return _packets(spark, sf_dir).filter(inside).select("pkt_id", "src_ip", "dst_ip")


@query
def flt_port_range(spark, sf_dir):
    inside = in_range(F.col("dport"), F.lit(0), F.lit(443)) & in_range(F.col("sport"), F.lit(1024), F.lit(3000))
    return _packets(spark, sf_dir).filter(inside).select("pkt_id", "sport", "dport")


@query
def flt_num_cmp(spark, sf_dir):
    def test(column, op, num):
        return compare(F.col(column), F.lit(op), F.lit(num))

    tcp = test("seq", ">", 50_000_000) & test("ack", "=", 1000003) & test("win", "<", 8192) & test("tcp_hlen", "=", 24)
    udp = test("udp_len", ">", 100)
    icmp = test("icmp_type", "=", 8) & test("icmp_code", "<", 2)
    return _packets(spark, sf_dir).filter(tcp | udp | icmp).select("pkt_id", "proto")


@query
def flt_tcp_flags(spark, sf_dir):
    return _packets(spark, sf_dir).filter(flags_match(F.col("tcp_flags"), F.lit(2), F.lit(18))).select(
        "pkt_id", "tcp_flags"
    )


def _list_matches(rule_type):
    def run(spark, sf_dir):
        hits = match.all_matches(_packets(spark, sf_dir), fixtures.ruleset(spark).only(rule_type))
        return with_rule_names(hits.select("pkt_id", "rule_id")).drop("rule_type")

    return run


for _name in TYPE_ORDER:
    QUERIES[f"match_{_name}"] = _list_matches(_name)


# --- joins --------------------------------------------------------------------------------


@query
def join_rules_all(spark, sf_dir):
    hits = match.all_matches(_packets(spark, sf_dir), fixtures.ruleset(spark))
    return with_rule_names(hits.select("pkt_id", "rule_id"))


@query
def join_rules_first(spark, sf_dir):
    return with_rule_names(_matched(spark, sf_dir).select("pkt_id", "rule_id"))


@query
def join_rules_first_indexed(spark, sf_dir):
    hits = match.first_match_indexed(_packets(spark, sf_dir), fixtures.rules(spark))
    return with_rule_names(hits.select("pkt_id", "rule_id"))


@query
def join_rules_first_joined(spark, sf_dir):
    hits = match.first_match_joined(_packets(spark, sf_dir), fixtures.rules(spark))
    return with_rule_names(hits.select("pkt_id", "rule_id"))


def _in_sets(hits, rules):
    """Matches by packet, ruleset, list and number."""
    named = with_rule_names(hits.select("pkt_id", "rule_id"), book=True)
    return named.join(broadcast_if_small(rulesets.book_names(rules)), "book").drop("book")


@query
def join_rules_sets(spark, sf_dir):
    """Thousands of rules in three rulesets, each of which meets all packets, in the way that match_packets chooses."""
    rules = fixtures.user_rules(spark, sf_dir)
    return _in_sets(match.match_packets(_packets(spark, sf_dir), rules), rules)


@query
def join_rules_sets_indexed(spark, sf_dir):
    rules = fixtures.user_rules(spark, sf_dir)
    return _in_sets(match.first_match_indexed(_packets(spark, sf_dir), rules), rules)


@query
def join_rules_sets_joined(spark, sf_dir):
    rules = fixtures.user_rules(spark, sf_dir)
    return _in_sets(match.first_match_joined(_packets(spark, sf_dir), rules), rules)


@query
def semi_captured(spark, sf_dir):
    return match.captured(_packets(spark, sf_dir), fixtures.ruleset(spark)).select("pkt_id")


@query
def anti_unmatched(spark, sf_dir):
    return match.unmatched(_packets(spark, sf_dir), fixtures.ruleset(spark)).select("pkt_id")


@query
def asof_ruleset(spark, sf_dir):
    """A new version comes 50 seconds into every block of 2,000 packets."""
    return _asof(spark, sf_dir)


@query
def asof_ruleset_by_hour(spark, sf_dir):
    """The same, with versions met by hour as where there are many."""
    return _asof(spark, sf_dir, compiled=0)


def _asof(spark, sf_dir, **options):
    packets = _packets(spark, sf_dir)
    blocks = packets.groupBy(F.call_function("div", "pkt_id", F.lit(2000)).alias("block"))
    starts = blocks.agg(F.min("ts").alias("start")).select(
        F.col("block").cast("int").alias("version"),
        (F.col("start") + F.expr("INTERVAL 50 SECONDS")).alias("valid_from"),
    )
    versioned = rulesets.asof_ruleset(packets, settle(starts, "versions"), **options)
    return versioned.select("pkt_id", "tick", "version", "evaluated")


@query
def interval_capture(spark, sf_dir):
    return _capture_columns(reports.captured_packets(_packets(spark, sf_dir), _targets(spark, sf_dir)))


# --- aggregates ---------------------------------------------------------------------------


@query
def agg_rule_counters(spark, sf_dir):
    counts = counters.count_by(_matched(spark, sf_dir), "rule_id")
    return with_rule_names(counters.rule_counters(counts, fixtures.rules(spark)))


@query
def agg_rule_tick(spark, sf_dir):
    return with_rule_names(counters.rule_ticks(_matched(spark, sf_dir)))


@query
def agg_merge_partials(spark, sf_dir):
    rings = counters.count_by(_matched(spark, sf_dir), "source_id", "rule_id")
    return with_rule_names(counters.merge_partials([rings], ["rule_id"], fixtures.rules(spark)))


@query
def agg_dst_counts(spark, sf_dir):
    return with_rule_names(counters.dst_counts(_matched(spark, sf_dir))).drop("bytes")


@query
def agg_merge_dst(spark, sf_dir):
    rings = counters.count_by(_matched(spark, sf_dir), "source_id", "rule_id", "tick", "dst_ip")
    merged = counters.merge_partials([rings], ["rule_id", "tick", "dst_ip"], fixtures.rules(spark))
    return with_rule_names(merged).drop("bytes")


def _rules_now(spark, sf_dir):
    """Counters of every rule and its rate at the last tick."""
    table = _rates(spark, sf_dir)
    rules = fixtures.rules(spark)
    counts = table.groupBy("rule_id").agg(F.sum("pps").alias("packets"), F.sum("bps").alias("bytes"))
    newest = F.broadcast(table.agg(F.max("tick").alias("tick")))
    return counters.rule_counters(counts, rules), table.join(newest, "tick"), rules


def _per_rule(spark, sf_dir):
    totals, now, _ = _rules_now(spark, sf_dir)
    rows = totals.join(now.select("rule_id", "pps", "bps"), "rule_id", "left").fillna(0, ["pps", "bps"])
    return with_rule_names(rows)


@query
def agg_type_total(spark, sf_dir):
    return counters.with_totals(_per_rule(spark, sf_dir), ["packets", "bytes", "pps", "bps"])


@query
def agg_running_total(spark, sf_dir):
    table = settle(counters.rule_ticks(_matched(spark, sf_dir)), "rule-ticks")
    return with_rule_names(counters.running_totals(table)).drop("packets", "bytes")


@query
def ts_mean_1m_total(spark, sf_dir):
    means = timeseries.mean_1m_total(_points(spark, sf_dir))
    return means.select(_seconds("time"), "type", "mean_bps", "mean_pps")


@query
def ts_mean_1m_rule(spark, sf_dir):
    means = timeseries.mean_1m_rule(_points(spark, sf_dir), last_minutes=30)
    return means.select(_seconds("time"), "measurement", "rule", "mean_bps", "mean_pps")


@query
def ts_last_total(spark, sf_dir):
    return timeseries.last_total(_points(spark, sf_dir))


@query
def ts_tag_values(spark, sf_dir):
    return timeseries.tag_values(_alarm_report(spark, sf_dir))


# --- rates and triggers -------------------------------------------------------------------


@query
def rate_delta(spark, sf_dir):
    """Running counters sampled at uneven times after each tick."""
    table = settle(counters.rule_ticks(_matched(spark, sf_dir)), "rule-ticks")
    totals = counters.running_totals(table)
    samples = settle(
        totals.select(
            "rule_id",
            (F.col("tick") * 1000 + 1000 + F.col("tick") * 37 % 11 * 20).alias("sample_ms"),
            F.col("total_packets").alias("packets"),
            F.col("total_bytes").alias("bytes"),
        ),
        "samples",
    )
    return with_rule_names(rates.rate_delta(samples)).drop("packets", "bytes")


def _due_columns(due):
    return with_rule_names(due.select("rule_id", "tick", "pps", "bps", "trigger"))


@query
def trig_above(spark, sf_dir):
    over = triggers.above(_rates(spark, sf_dir), fixtures.rules(spark), fixtures.FIRST_TICK)
    return with_rule_names(over.select("rule_id", "tick", "pps", "bps", "pps_above", "bps_above"))


@query
def trig_single(spark, sf_dir):
    return _due_columns(triggers.single_alarms(_rates(spark, sf_dir), fixtures.rules(spark), fixtures.FIRST_TICK))


@query
def trig_dual(spark, sf_dir):
    return _due_columns(triggers.dual_alarms(_rates(spark, sf_dir), fixtures.rules(spark), fixtures.FIRST_TICK))


@query
def trig_dst_guard(spark, sf_dir):
    table = settle(counters.dst_counts(_matched(spark, sf_dir)), "dst-counts")
    totals = table.groupBy("rule_id", "tick").agg(F.sum("packets").alias("pps"), F.sum("bytes").alias("bps"))
    due = triggers.single_alarms(settle(totals, "rule-ticks"), fixtures.rules(spark), fixtures.FIRST_TICK)
    return _due_columns(triggers.guard(due, table))


@query
def top_dst(spark, sf_dir):
    profile = counters.tick_profile(counters.dst_counts(_matched(spark, sf_dir)))
    return with_rule_names(counters.with_dst_text(profile)).select("rule_type", "rule_no", "tick", "dst")


# --- order, limits, sets ------------------------------------------------------------------


@query
def ord_rules(spark, sf_dir):
    return reports.ordered_rules(_per_rule(spark, sf_dir), ["packets", "bytes"])


@query
def topk_dst(spark, sf_dir):
    counts = counters.dst_counts(_matched(spark, sf_dir))
    return with_rule_names(counters.top_destinations(counts, TOP)).drop("bytes")


@query
def limit_capture(spark, sf_dir):
    return _capture_columns(reports.first_captured_packets(_packets(spark, sf_dir), _targets(spark, sf_dir), CAPTURED))


@query
def ts_event_history(spark, sf_dir):
    history = timeseries.event_history(_alarm_report(spark, sf_dir))
    return history.withColumn("time", F.unix_seconds("time"))


@query
def union_types(spark, sf_dir):
    """All lists in one pass: a rule's id says which list it is of."""
    return with_rule_names(counters.count_by(_matched(spark, sf_dir), "rule_id"))


@query
def ruleset_diff(spark, sf_dir):
    old, _ = load_rules(_rule_texts(spark, sf_dir))
    new, _ = load_rules(_rule_texts(spark, sf_dir, newer=True))
    changed = rulesets.ruleset_diff(old, new, ["ruleset_id"])
    return changed.select("side", "ruleset_id", "rule_type", "rule_no", "pps_th", "bps_th")


# --- reports ------------------------------------------------------------------------------


@query
def rep_show_rules(spark, sf_dir):
    totals, now, rules = _rules_now(spark, sf_dir)
    return reports.show_rules(totals, now, rules)


@query
def rep_alarms_frames(spark, sf_dir):
    """From stored frames, some of them no packets at all, to the alarm report."""
    path = scratch_path(spark, "frames")
    packed = fixtures.frames_of(_packets(spark, sf_dir)).select(FRAMES.fieldNames())
    odd = packed.filter(F.unix_seconds("ts") % 5 == 0).withColumn("frame", F.substring("frame", 1, 30))
    packed.unionByName(odd).write.parquet(path)
    packets = with_tick(frames.frame_packets(frames.read_frames(spark, path)))
    report = reports.traffic_alarms(packets, fixtures.rules(spark), _FIRST)
    return _from_epoch(report).drop("time", "type", "ruleset_id", "version")


@query
def rep_alarms_versions(spark, sf_dir):
    """Two rulesets, each with a new version in every block of packets: counters and triggers start afresh with each."""
    packets = _packets(spark, sf_dir)
    rules = fixtures.versioned_rules(spark, settle(fixtures.ruleset_versions(packets), "versions"))
    report = reports.traffic_alarms(packets, rules, fixtures.FIRST_TICK, fixtures.EPOCH)
    return report.select("ruleset_id", "version", "rule_type", "rule_no", "tick", "trigger", "dst", "pps", "bps")


@query
def rep_alarms(spark, sf_dir):
    return _alarm_report(spark, sf_dir).drop("time", "type", "ruleset_id", "version")


# --- streaming ----------------------------------------------------------------------------


def _drained(spark, start, name):
    """Run a streaming job over all there is, then read what it wrote; and where it left its progress."""
    path, progress = scratch_path(spark, name), scratch_path(spark, f"{name}-progress")
    start(path, progress).awaitTermination()
    return spark.read.parquet(path), progress


def _by_time(packets):
    """Packets with Unix seconds as their tick, as streams have them."""
    return with_tick(packets.drop("tick"))


def _left_open(spark, sf_dir, progress):
    """The packets, in batch, that a finished stream has left open."""
    return watermarks.open_packets(_by_time(_packets(spark, sf_dir)), progress)


def _from_epoch(df):
    return df.withColumn("tick", F.col("tick") - fixtures.EPOCH)


_FIRST = fixtures.EPOCH + fixtures.FIRST_TICK


@query
def st_tick_counts(spark, sf_dir):
    ruleset = fixtures.ruleset(spark)
    counts = ticks.tick_counts(_stream(spark, sf_dir), ruleset, "0 seconds")
    table, progress = _drained(spark, lambda path, progress: monitor.run_to_table(counts, path, progress), "ticks")
    closing = counters.rule_ticks(match.first_match(_left_open(spark, sf_dir, progress), ruleset))
    return _from_epoch(with_rule_names(table.unionByName(closing)))


def _stream_due(spark, sf_dir, rules):
    """Alarms of the stream, closed."""
    due = stream_alarms(_stream(spark, sf_dir), rules, "0 seconds", _FIRST)
    table, progress = _drained(spark, lambda path, progress: monitor.run_to_table(due, path, progress), "alarms")
    matched = match.match_packets(_left_open(spark, sf_dir, progress), rules)
    rest = rates.tick_rates(counters.tick_profile(counters.dst_counts(matched)))
    return table.unionByName(closing_alarms(triggers.with_limits(rest, rules, _FIRST), progress))


@query
def st_triggers(spark, sf_dir):
    due = _stream_due(spark, sf_dir, fixtures.rules(spark))
    return _from_epoch(with_rule_names(counters.with_dst_text(due))).select("rule_type", "rule_no", "tick", "pps", "bps", "dst", "trigger")


def _event_files(spark, sf_dir):
    """The events in BATCHES files, one after the other in time; the path, and the last second of each."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = scratch_path(spark, "event-files")
    size = events.agg(F.max("event_id")).first()[0] // BATCHES + 1
    for n in range(BATCHES):
        part = events.filter(F.call_function("div", "event_id", F.lit(size)) == n)
        part.coalesce(1).write.mode("append").parquet(path)
    ends = fixtures.packets_of(events).groupBy(F.call_function("div", "pkt_id", F.lit(size)).alias("n")).agg(F.max("ts").alias("until"))
    return path, [row["until"] for row in ends.select("n", F.unix_micros("until").alias("until")).orderBy("n").collect()]


def _reloaded_counts(spark, sf_dir):
    """Counts of a stream of several files while versions of the rules come in: before each batch those that its packets can
    meet are announced."""
    files, ends = _event_files(spark, sf_dir)
    versions = settle(fixtures.ruleset_versions(_packets(spark, sf_dir)), "versions")
    calls = []

    def read_rules():
        calls.append(1)
        until = ends[min(len(calls), BATCHES) - 1]
        return fixtures.versioned_rules(spark, versions.filter(F.col("valid_from").isNull() | (F.unix_micros("valid_from") <= until)), epoch=0)

    schema = spark.read.parquet(files).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
    packets = _by_time(fixtures.packets_of(events))

    def start(path, progress):
        return monitor.reloading_counts(packets, read_rules, path, progress, _FIRST)

    counts, _ = _drained(spark, start, "partials")
    return counts.drop("batch"), versions


@query
def st_ruleset_reload(spark, sf_dir):
    """Two rulesets whose versions come in while the stream goes on; each version counts on its own."""
    partials, versions = _reloaded_counts(spark, sf_dir)
    rules = fixtures.versioned_rules(spark, versions)
    merged = counters.merge_partials([partials], ["rule_id", "tick"], rules)
    named = with_rule_names(merged, book=True).join(broadcast_if_small(rulesets.book_names(rules)), "book").drop("book")
    return _from_epoch(named)


@query
def st_alarms_reload(spark, sf_dir):
    """Alarms of the stream of counts that `st_ruleset_reload` makes: the limits come with the counts."""
    partials, versions = _reloaded_counts(spark, sf_dir)
    stored = scratch_path(spark, "partials")
    partials.write.parquet(stored)
    due = alarms_of_counts(spark.readStream.schema(partials.schema).parquet(stored), "0 seconds")
    table, progress = _drained(spark, lambda path, progress: monitor.run_to_table(due, path, progress), "alarms")
    summed = partials.groupBy("rule_id", "tick", "dst_ip", *triggers.LIMITS).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    rest = rates.tick_rates(counters.tick_profile(summed, ("rule_id", "tick", *triggers.LIMITS)))
    report = reports.written_alarms(table.unionByName(closing_alarms(rest, progress)), fixtures.versioned_rules(spark, versions))
    return _from_epoch(report).select("ruleset_id", "version", "rule_type", "rule_no", "tick", "trigger", "dst", "pps", "bps")


@query
def st_monitor(spark, sf_dir):
    ruleset, rules = fixtures.ruleset(spark), fixtures.rules(spark)
    counts = ticks.tick_counts(_stream(spark, sf_dir), ruleset, "0 seconds")

    def start(path, progress):
        return monitor.publish_rates(counts, rules, path, progress, SAMPLE_PERIOD)

    points, progress = _drained(spark, start, "points")
    rest = settle(rates.tick_rates(counters.rule_ticks(match.first_match(_left_open(spark, sf_dir, progress), ruleset))), "rule-ticks")
    points = points.drop("batch").unionByName(monitor.closing_points(rest, rules, progress, SAMPLE_PERIOD))
    return points.select(_tick("time"), "measurement", "rule", "type", "pps", "bps")


@query
def st_alarm_log(spark, sf_dir):
    """Alarms of the stream as log lines, each batch in a folder that it replaces."""
    rules = fixtures.rules(spark)
    due = settle(_stream_due(spark, sf_dir, rules), "due")
    stream = spark.readStream.schema(due.schema).parquet(due.inputFiles()[0].rpartition("/")[0])
    path = scratch_path(spark, "alarm-log")
    write = monitor.batches_into(path, alarm_log.write_alarm_log, lambda batch: reports.written_alarms(batch, rules))
    monitor.publish(stream, write, scratch_path(spark, "log-progress")).awaitTermination()
    return alarm_log.read_alarm_log(spark, path)


@query
def st_capture(spark, sf_dir):
    """Packets and alarms as streams, joined by time."""
    rules = fixtures.rules(spark)
    path = scratch_path(spark, "targets")
    due = triggers.alarms(_rates(spark, sf_dir), rules, fixtures.FIRST_TICK)
    reports.alarm_targets(due, rules, fixtures.EPOCH).write.parquet(path)
    targets = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    met = stream_captures(_stream(spark, sf_dir), targets, "10 seconds", "2 minutes")
    table, _ = _drained(spark, lambda path, progress: monitor.run_to_table(met, path, progress), "captures")
    return _capture_columns(_from_epoch(table))
