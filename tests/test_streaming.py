"""Each streaming job over many files equals its batch twin over the same rows."""

import os
import random
import shutil

import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import walks

from floodsight.operators import counters, match, rates, timeseries, triggers
from floodsight.plans import fixtures
from floodsight.schemas import PACKETS
from floodsight.session import settle
from floodsight.sources.packets import read_packets, stream_packets
from floodsight.plans import reports
from floodsight.sinks import alarm_log, line_protocol
from floodsight.sinks.capture import write_capture
from floodsight.sources import frames
from floodsight.streaming import monitor, ticks, watermarks
from floodsight.streaming.captures import stream_captures
from floodsight.streaming.triggers import TriggerProcessor, closing_alarms, stream_alarms

SF = "/root/testdata/sf0.01"
# Blocks of packets, in time order; two of them are floods.
BOUNDS = [0, 700, 1400, 1900, 2600, 3300, 4100]


def add_file(part, written, file, number):
    """Write one file; its time says when it came in."""
    part.coalesce(1).write.parquet(str(written))
    shutil.copy(next(written.glob("part-*.parquet")), file)
    os.utime(file, (1_700_000_000 + number * 10,) * 2)


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Packet files that arrive in time order, within a file in no order."""
    folder = tmp_path_factory.mktemp("feed")
    packets = fixtures.packets(spark, SF).select(PACKETS.fieldNames())
    for n, (lo, hi) in enumerate(zip(BOUNDS, BOUNDS[1:])):
        part = packets.filter(F.col("pkt_id").between(lo, hi - 1)).orderBy(F.xxhash64("pkt_id"))
        add_file(part, folder / f"part{n}", folder / f"{n}.parquet", n)
    return str(folder / "*.parquet")


def drain(start, tmp_path, name):
    path = str(tmp_path / name)
    query = start(path, str(tmp_path / f"{name}-progress"))
    query.awaitTermination()
    return path, query


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def batch_ticks(spark, feed):
    packets = read_packets(spark, feed)
    last = packets.agg(F.max("tick")).first()[0]
    matched = match.first_match(packets, fixtures.ruleset(spark))
    return settle(rates.tick_rates(counters.tick_profile(counters.dst_counts(matched))), "ticks"), last


def test_tick_counts(spark, feed, tmp_path):
    counts = ticks.tick_counts(stream_packets(spark, feed, 1), fixtures.ruleset(spark), "5 seconds")
    path, query = drain(lambda p, c: monitor.run_to_table(counts, p, c), tmp_path, "ticks")
    table, last = batch_ticks(spark, feed)
    closed = table.filter(F.col("tick") < last - 5)
    got = rows(spark.read.parquet(path), "rule_id", "tick", "packets", "bytes")
    assert got == rows(closed, "rule_id", "tick", "pps", "bps")
    rest = watermarks.open_packets(read_packets(spark, feed), str(tmp_path / "ticks-progress"))
    closing = counters.rule_ticks(match.first_match(rest, fixtures.ruleset(spark)))
    assert sorted(got + rows(closing, "rule_id", "tick", "packets", "bytes")) == rows(table, "rule_id", "tick", "pps", "bps")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == len(BOUNDS) - 1


def test_late_packets_are_dropped_and_counted(spark, feed, tmp_path):
    """Two files of new packets, then one of packets that the watermark has passed for a whole batch."""
    packets = read_packets(spark, feed).select(PACKETS.fieldNames())
    os.makedirs(tmp_path / "mix")
    for n, wanted in enumerate(("pkt_id BETWEEN 4000 AND 4049", "pkt_id >= 4050", "pkt_id < 10")):
        add_file(packets.filter(wanted), tmp_path / f"part{n}", tmp_path / "mix" / f"{n}.parquet", n)
    counts = ticks.tick_counts(stream_packets(spark, str(tmp_path / "mix"), 1), fixtures.ruleset(spark), "0 seconds")
    path, query = drain(lambda p, c: monitor.run_to_table(counts, p, c), tmp_path, "late")
    dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    assert dropped > 0
    oldest = packets.filter("pkt_id >= 4000").agg(F.min(F.unix_seconds("ts"))).first()[0]
    assert spark.read.parquet(path).filter(F.col("tick") < oldest).count() == 0


def test_alarms(spark, feed, tmp_path):
    first = fixtures.EPOCH + fixtures.FIRST_TICK
    rules = fixtures.rules(spark)
    due = stream_alarms(stream_packets(spark, feed, 1), rules, "0 seconds", first)
    path, query = drain(lambda p, c: monitor.run_to_table(due, p, c), tmp_path, "alarms")
    table, last = batch_ticks(spark, feed)
    want = triggers.alarms(table, rules, first)
    columns = ["rule_id", "tick", "pps", "bps", "dst_ip", "trigger"]
    got = rows(spark.read.parquet(path), *columns)
    assert got == rows(want.filter(F.col("tick") < last), *columns) and len(got) > 20
    closing = closing_alarms(triggers.with_limits(table, rules, first), str(tmp_path / "alarms-progress"))
    assert sorted(got + rows(closing, *columns)) == rows(want, *columns)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == len(BOUNDS) - 1


def test_rules_are_read_again_for_every_batch(spark, feed, tmp_path):
    read = []
    with_first, without = fixtures.rules(spark), fixtures.rules(spark).filter("rule_type <> 'icmp'")

    def read_rules():
        read.append(1)
        return with_first if len(read) <= 3 else without

    packets = stream_packets(spark, feed, 1)
    path, _ = drain(lambda p, c: monitor.reloading_counts(packets, read_rules, p, c, 0), tmp_path, "reload")
    assert len(read) == len(BOUNDS) - 1
    partials = spark.read.parquet(path).drop("batch")
    got = counters.merge_partials([partials], ["rule_id", "tick"], with_first)
    ruleset = fixtures.ruleset(spark)
    traffic = read_packets(spark, feed).filter((F.col("pkt_id") < BOUNDS[3]) | (F.col("proto") != 1))
    want = counters.rule_ticks(match.first_match(traffic, ruleset))
    columns = ["rule_id", "tick", "packets", "bytes"]
    assert rows(got, *columns) == rows(want, *columns)


def test_monitor_points(spark, feed, tmp_path):
    rules = fixtures.rules(spark)
    counts = ticks.tick_counts(stream_packets(spark, feed, 1), fixtures.ruleset(spark), "0 seconds")
    path, _ = drain(lambda p, c: monitor.publish_rates(counts, rules, p, c, 10), tmp_path, "points")
    table, last = batch_ticks(spark, feed)
    want = timeseries.metric_points(table.filter(F.col("tick") < last), rules, 10)
    columns = ["time", "measurement", F.coalesce("rule", F.lit(-1)), F.coalesce("type", F.lit("")), "pps", "bps"]
    assert rows(spark.read.parquet(path), *columns) == rows(want, *columns)


class Handle:
    """A state store in memory, for one key."""

    def __init__(self):
        self.values, self.maps, self.timers, self.largest = {}, {}, set(), 0

    def getValueState(self, name, schema):
        class Value:
            exists = lambda _: name in self.values
            get = lambda _: self.values[name]
            update = lambda _, value: self.values.update({name: value})

        return Value()

    def getMapState(self, name, *schema):
        def update(_, key, value):
            self.largest = max(self.largest, len(value[0]))
            self.maps[key] = value

        class Map:
            containsKey = lambda _, key: key in self.maps
            getValue = lambda _, key: self.maps[key]
            removeKey = lambda _, key: self.maps.pop(key)
            updateValue = update

        return Map()

    def registerTimer(self, time):
        self.timers.add(time)


class Expired:
    def __init__(self, time):
        self.getExpiryTimeInMs = lambda: time


def test_a_backlog_of_a_day_is_walked_a_minute_at_a_time():
    rng = random.Random(4)
    rates = {tick: (rng.choice([1, 20]) if rng.random() < 0.2 else 20, 150) for tick in range(1000, 87_400) if rng.random() < 0.97}
    limits = {"pps_th": 10, "bps_th": 100, "pps_period": 5, "bps_period": 7, "first_tick": 1001}
    ticks_, handle, processor = list(rates), Handle(), TriggerProcessor()
    rng.shuffle(ticks_)
    processor.init(handle)
    chunks = (pd.DataFrame([{"tick": t, "pps": rates[t][0], "bps": rates[t][1], "dst_ip": 9, **limits} for t in ticks_[n : n + 10_000]]) for n in range(0, len(ticks_), 10_000))
    assert list(processor.handleInputRows((3,), chunks, None)) == []
    out = [row for time in sorted(handle.timers) for frame in processor.handleExpiredTimer((3,), None, Expired(time)) for row in frame.itertuples(index=False)]
    want = walks.alarms(rates, 1001, 87_400, 10, 100, 5, 7)
    assert [(r.tick, r.trigger) for r in out] == want and len(want) > 5000
    assert handle.maps == {} and handle.largest <= 60 * 32


@pytest.mark.parametrize("kind", ["log", "lines", "capture"])
def test_a_batch_sent_twice_leaves_the_same_files(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    report = spark.createDataFrame([("a", "log", "/x"), ("b", "syslog", "")], "text string, action_type string, action_param string")
    if kind == "log":
        write, read = monitor.batches_into(path, alarm_log.write_alarm_log), lambda: alarm_log.read_alarm_log(spark, path)
    elif kind == "lines":
        lines = lambda batch: batch.select(F.col("text").alias("line"))
        write, read = monitor.batches_into(path, line_protocol.write_lines, lines), lambda: spark.read.text(path).select("value")
    else:
        report = fixtures.packets(spark, "/root/testdata/sf0.001").limit(20).selectExpr("0L AS alarm_rule_id", "ts AS alarm_ts", "*")
        write, read = monitor.batches_into(path, write_capture), lambda: spark.read.parquet(path).select("pkt_id", "dst_ip")
    report = settle(report, "report")
    write(report, 0)
    write(report, 1)
    before = sorted(map(tuple, read().collect()))
    write(report, 1)
    assert sorted(map(tuple, read().collect())) == before and len(before) == 2 * report.count()


def test_captures_of_a_stream(spark, feed, tmp_path):
    rules = fixtures.rules(spark)
    table, _ = batch_ticks(spark, feed)
    targets = settle(reports.alarm_targets(triggers.alarms(table, rules, fixtures.EPOCH + 1), rules), "targets")
    folder = targets.inputFiles()[0].rpartition("/")[0]
    streams = stream_packets(spark, feed, 1), spark.readStream.schema(targets.schema).parquet(folder)
    path, query = drain(lambda p, c: monitor.run_to_table(stream_captures(*streams, "0 seconds"), p, c), tmp_path, "captures")
    packets = read_packets(spark, feed)
    want = reports.captured_packets(packets, targets)
    columns = ["alarm_rule_id", "alarm_ts", "pkt_id"]
    assert rows(spark.read.parquet(path), *columns) == rows(want, *columns) and want.count() > 500
    # packets are kept for as long as an alarm may come for them, and alarms for a minute
    kept = query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    last = packets.agg(F.max("ts")).first()[0]
    recent = packets.filter(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 130 SECONDS")).count() + targets.count()
    assert kept <= recent < packets.count()


def test_frames_of_a_stream_are_counted_on_the_way(spark, tmp_path):
    packed = fixtures.frames_of(fixtures.packets(spark, "/root/testdata/sf0.001")).select("frame", "frame_len", "ts", "source_id")
    short = packed.limit(7).withColumn("frame", F.substring("frame", 1, 20))
    other = packed.limit(5).withColumn("frame", F.unhex(F.regexp_replace(F.hex("frame"), "^(.{24})0800", "$10806")))
    packed.unionByName(short).unionByName(other).write.parquet(str(tmp_path / "frames"))
    seen = Observation("frames")
    once = frames.frame_packets(frames.read_frames(spark, str(tmp_path / "frames")), seen)
    ids = rows(once, "pkt_id")
    assert seen.get == {"frames": 1012, "short_frame": 7, "not_IPv4": 5, "other_protocol": 0}
    assert len(set(ids)) == 1000 and ids == rows(frames.frame_packets(frames.read_frames(spark, str(tmp_path / "frames"))), "pkt_id")
    stream = frames.frame_packets(frames.stream_frames(spark, str(tmp_path / "frames")), "seen")
    path, query = drain(lambda p, c: monitor.run_to_table(stream, p, c), tmp_path, "decoded")
    assert rows(spark.read.parquet(path), "pkt_id") == ids
    counted = [p["observedMetrics"]["seen"] for p in query.recentProgress if p["numInputRows"]]
    assert sum(c["frames"] for c in counted) == 1012 and sum(c["short_frame"] for c in counted) == 7
