"""Ruleset versions, step functions of triggers, captures cut before the join, stored packets, rule files read in splits."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from floodsight.operators import byte_walk, capture, triggers
from floodsight.operators.rulesets import book_names, with_books
from floodsight.plans import fixtures, reports
from floodsight.schemas import RULES
from floodsight.session import settle
from floodsight.sources.packets import packets_between, read_packets, store_packets
from floodsight.sources.rules import read_rule_files

SF = "/root/testdata/sf0.01"


def walked(ticks, over, hidden, period, first, last, age):
    good, expected = first - 1 - age, first
    for tick, is_over, is_hidden in zip(ticks, over, hidden):
        if tick > expected:
            good = tick - 1
        expected = tick + 1
        if not is_hidden and (not is_over or tick - good > period):
            good = tick
    return min(last - good, period) if expected == last + 1 else 0


def test_steps_of_a_segment_equal_the_walk_from_every_age():
    rng = random.Random(3)
    for _ in range(1500):
        width, first, period = rng.randrange(1, 30), rng.randrange(5), rng.choice([1, 2, 3, 5, 8, 20, 50])
        there, swallowed = rng.choice([0.5, 0.9, 1.0]), rng.choice([0, 0.1, 0.4])
        ticks = [t for t in range(first, first + width) if rng.random() < there] or [first]
        over, hidden = [rng.random() < 0.97 for _ in ticks], [rng.random() < swallowed for _ in ticks]
        last = first + width - 1
        steps = [dict(zip(("age", "exit", "slope"), step)) for step in byte_walk.exit_ages(ticks, over, hidden, period, first, last)]
        for age in range(period + 1):
            assert byte_walk.exit_age(steps, age, period) == walked(ticks, over, hidden, period, first, last, age)


def test_a_period_of_any_length_takes_no_more_room(spark):
    """Both thresholds are passed for 3,000 ticks; bytes are due at the first tick that packets leave to them, and never again."""
    steps = byte_walk.exit_ages(list(range(512)), [True] * 512, [n % 4 == 0 for n in range(512)], 10**9, 0, 511)
    assert len(steps) < 600
    rule = dict.fromkeys(RULES.fieldNames()) | {
        "ruleset_id": "r", "rule_type": "tcp", "rule_no": 0, "text_rule": "", "next_rule": False, "pps_th": 10, "bps_th": 10,
        "pps_period": 2, "bps_period": 10**9, "action_type": "syslog", "action_param": "", "comment": "",
    }
    rules = spark.createDataFrame([tuple(rule.values())], RULES)
    rates = spark.range(1, 3001).select(F.lit(0).cast("long").alias("rule_id"), F.col("id").alias("tick"), F.lit(20).cast("long").alias("pps"), F.lit(20).cast("long").alias("bps"))
    found = triggers.dual_alarms(rates, rules, 1).groupBy("trigger").agg(F.count("*"), F.min("tick")).collect()
    assert sorted(map(tuple, found)) == [("bps", 1, 2), ("pps", 1000, 1)]


def test_versions_of_rulesets(spark):
    day = dt.datetime(2024, 1, 1)
    rules = fixtures.rules(spark).limit(1).drop("ruleset_id")
    at = lambda seconds: day + dt.timedelta(seconds=seconds)
    versions = [("a", 1, None), ("a", 2, at(60)), ("a", 3, at(60)), ("b", 1, at(5)), ("b", 2, at(90))]
    versions = spark.createDataFrame(versions, "ruleset_id string, version int, valid_from timestamp")
    table = versions.select("ruleset_id", "version").filter("NOT (ruleset_id = 'a' AND version = 3)").crossJoin(rules)
    booked = with_books(table, versions, 1704067200)
    got = {(r.ruleset_id, r.version): (r.book, r.from_us and r.from_us // 10**6 - 1704067200, r.to_us and r.to_us // 10**6 - 1704067200, r.first_tick) for r in booked.collect()}
    assert got == {("a", 1): (0, None, 60, None), ("a", 2): (1, 60, 60, 61), ("b", 1): (3, 5, 90, 6), ("b", 2): (4, 90, None, 91)}
    assert book_names(booked).count() == 4


def captures(spark):
    rng = random.Random(6)
    start = 1704067200
    rows = [(n, 6, rng.choice([5, 6, 7]), start * 10**6 + rng.randrange(90 * 4) * 250_000) for n in range(6000)]
    packets = spark.createDataFrame(rows, "pkt_id long, proto int, dst_ip long, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    alarms = spark.createDataFrame([(n, 6, rng.choice([5, 6]), start + rng.randrange(80)) for n in range(25)], "rule_id long, proto int, dst_ip long, s long")
    return packets, settle(alarms.withColumn("ts", F.timestamp_seconds("s")).drop("s"), "alarms")


@pytest.mark.parametrize("k", [1, 7, 100, 1000])
def test_captures_cut_before_the_join(spark, k):
    packets, alarms = captures(spark)
    columns = ["alarm_rule_id", "alarm_ts", "pkt_id", "position"]
    want = capture.limit_capture(capture.interval_capture(packets, alarms), k).select(columns).collect()
    assert sorted(capture.first_captured(packets, alarms, k).select(columns).collect()) == sorted(want)


def test_alarms_between_seconds_are_refused(spark):
    packets, alarms = captures(spark)
    odd = settle(alarms.withColumn("ts", F.col("ts") + F.expr("INTERVAL 0.5 SECONDS")), "alarms")
    with pytest.raises(Exception, match="not at a whole second"):
        capture.first_captured(packets, odd).count()


def test_a_range_of_time_reads_its_days_only(spark, tmp_path):
    packets = fixtures.packets(spark, SF)
    later = packets.withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 DAYS"))
    store_packets(packets.unionByName(later), str(tmp_path / "p"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        stored = read_packets(spark, str(tmp_path / "p"))
        second = 1704067200 + 3 * 86400 + 100
        targets = settle(spark.createDataFrame([(0, 6, 3405803777, second)], "rule_id long, proto int, dst_ip long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s"), "t")
        found = reports.captured_packets(stored, targets)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2024-01-04", plan), plan
        assert found.count() == later.filter(F.unix_seconds("ts").between(second, second + 60) & (F.col("proto") == 6) & (F.col("dst_ip") == 3405803777)).count() > 0
        assert packets_between(stored, 1704067200 * 10**6, 1704153599 * 10**6).count() == packets.count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rule_files_are_read_in_splits(spark, tmp_path):
    lines = [f"TCP -d 203.0.113.{n % 256} --pps-th {n + 1}p" if n % 3 else "" for n in range(5000)]
    (tmp_path / "a.txt").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "b.txt").write_text("\n".join(lines[:7]) + "\n")
    kept = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted(map(tuple, read_rule_files(spark, str(tmp_path)).collect()))
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert got == [("a.txt", n, line) for n, line in enumerate(lines)] + [("b.txt", n, line) for n, line in enumerate(lines[:7])]
