"""Whole jobs at size: guarded triggers, backlogs of streams, captures by time."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from floodsight.operators import match, rulesets
from floodsight.plans import catalog, fixtures
from floodsight.session import settle
from floodsight.sources.rules import load_rules
from floodsight.streaming import triggers as stream_triggers
from floodsight.streaming.captures import stream_captures


def test_guard_keeps_alarms_of_all_counted_ticks(spark, tmp_path):
    """Every alarm has a counted destination, so the guard drops none, whatever its tick."""
    kind = F.element_at(F.array(*map(F.lit, ("click", "error", "view"))), (F.col("id") % 3 + 1).cast("int"))
    events = spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 50).alias("user_id"), kind.alias("event_type"), (F.col("id") % 300).cast("double").alias("value"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    guarded = catalog.trig_dst_guard(spark, str(tmp_path)).collect()
    assert sorted(guarded) == sorted(catalog.trig_single(spark, str(tmp_path)).collect())
    assert any(row["tick"] % 3 == 0 for row in guarded)


class Store:
    """The state of a processor in memory, which counts how often the map is written."""

    def __init__(self):
        self.value, self.held, self.timers, self.writes = None, {}, set(), 0

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def get(self):
        return self.value

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key], self.writes = value, self.writes + 1

    def removeKey(self, key):
        del self.held[key]

    def registerTimer(self, at):
        self.timers.add(at)


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_a_backlog_is_not_written_again_for_each_chunk():
    limits = dict(pps_th=5, bps_th=50, pps_period=3, bps_period=4, first_tick=1)
    rng = random.Random(4)
    ticks = [(tick, rng.choice([3, 9]), rng.choice([30, 90]), 7) for tick in range(20_000)]
    want = stream_triggers.walk([*stream_triggers._fresh(1), *limits.values()], np.array([row for row in ticks if row[0] >= 1]))[1]
    rng.shuffle(ticks)
    table = pd.DataFrame(ticks, columns=["tick", "pps", "bps", "dst_ip"]).assign(**limits)
    store, processor = Store(), stream_triggers.TriggerProcessor()
    processor.init(store)
    assert list(processor.handleInputRows((3,), iter([table[at : at + 500] for at in range(0, len(table), 500)]), None)) == []
    assert store.writes < 100
    got = [row for at in sorted(store.timers) for part in processor.handleExpiredTimer((3,), None, Expired(at)) for row in part.itertuples(index=False)]
    assert [tuple(row)[1:] for row in got] == want and not store.held


def test_stream_captures_join_by_time_bucket(spark, tmp_path):
    """An alarm must not look through all packets of its host."""
    schema = "pkt_id long, ts timestamp, proto int, dst_ip long"
    alarms = "rule_id long, proto int, dst_ip long, ts timestamp"
    met = stream_captures(spark.readStream.schema(schema).parquet(str(tmp_path)), spark.readStream.schema(alarms).parquet(str(tmp_path)), "10 seconds")
    assert "bucket" in met._jdf.queryExecution().analyzed().toString()


def _versioned(spark, blocks):
    """Packets with and without time in blocks of 2,000, and the rules of their versions; some versions are never in force."""
    kind = F.element_at(F.array(*map(F.lit, ("click", "error", "view", "purchase"))), (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int"))
    events = spark.range(2000 * blocks).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 500).alias("user_id"), kind.alias("event_type"), (F.col("id") % 300).cast("double").alias("value"))
    packets = fixtures.packets_of(events)
    versions = fixtures.ruleset_versions(packets)
    never = versions.filter("version = 2").withColumns({"version": F.lit(3).cast("int"), "book": F.col("book") + 1000})
    rules = fixtures.versioned_rules(spark, settle(versions.filter("version <> 3").unionByName(never), "versions"))
    early = F.when(F.col("pkt_id") % 900 == 0, F.lit(None)).when(F.col("pkt_id") % 901 == 0, F.timestamp_seconds(F.lit(-1.5))).otherwise(F.col("ts"))
    return settle(packets.withColumn("ts", early).repartition(4), "packets"), rules


def test_versions_in_an_index_and_a_join_equal_compiled_ones(spark):
    packets, rules = _versioned(spark, 4)
    want = sorted(match.first_match(packets, match.collect_rules(rules)).select("pkt_id", "rule_id").collect())
    assert len(want) > 5000
    for way in (match.first_match_indexed, match.first_match_joined):
        assert sorted(way(packets, rules).select("pkt_id", "rule_id").collect()) == want


def test_a_key_of_the_index_holds_the_rules_of_its_time_only(spark):
    """However many versions there are, a packet meets few of them."""
    _, rules = _versioned(spark, 20)
    index = match.build_index(rules)
    assert max(row["lanes"] for row in index.about.values()) <= 4 and len(index.wide.rows) <= 2


def test_many_terminal_hits_of_several_books(spark):
    lines = [f"TCP -d 203.0.113.7/32 --win <{2000 + n} --pps-th 1p {'--next' if n % 3 == 0 else ''}" for n in range(90)]
    texts = fixtures.rule_texts(spark, lines, "a").unionByName(fixtures.rule_texts(spark, lines[::-1], "b"))
    rules = settle(rulesets.with_books(match_rules(texts)), "rules")
    rows = spark.range(60).select(F.col("id").alias("event_id"), F.lit(7).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
    packets = fixtures.packets_of(rows).withColumn("win", (1980 + F.col("pkt_id") * 2).cast("int"))
    want = sorted(match.first_match(packets, match.collect_rules(rules)).select("pkt_id", "rule_id").collect())
    assert want and sorted(match.first_match_indexed(packets, rules).select("pkt_id", "rule_id").collect()) == want


def match_rules(texts):
    return load_rules(texts)[0]
