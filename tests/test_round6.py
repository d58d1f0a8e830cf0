"""Rules with the same tests, looked up by one code, and tests as ranges of numbers."""

import itertools

from pyspark.sql import functions as F

from floodsight.functions.predicates import packet_value, range_tests, rule_columns_match, rule_range, time_range, time_value
from floodsight.operators import match, rulesets
from floodsight.plans import fixtures
from floodsight.schemas import PACKETS, PROTO, RULES
from floodsight.session import settle
from floodsight.sources.rules import load_rules


def _alike(spark, copies):
    """Rules of two rulesets over one host: a few tests, each of them of many rules, that go on but for the last; and packets."""
    tests = [("TCP", f"--win <{1990 + n}") for n in range(3)] + [("UDP", "--dport 53"), ("ICMP", "--code =1")]
    lines = [f"{kind} -d 203.0.113.7/32 {test} --pps-th 1p --next" for _ in range(copies) for kind, test in tests]
    lines += [f"TCP -d 203.0.113.7/32 --win <1991 --pps-th 1p{end}" for end in ("", " --next", "")]
    # In the other ruleset a terminal rule stands in the midst of them.
    other = [*lines[: len(lines) // 2], "TCP -d 203.0.113.0/24 --win >1986 --pps-th 1p", *lines[len(lines) // 2 :]]
    texts = fixtures.rule_texts(spark, lines, "a").unionByName(fixtures.rule_texts(spark, other, "b"))
    rules = settle(rulesets.with_books(load_rules(texts)[0]), "rules")
    kind = F.element_at(F.array(*map(F.lit, ("click", "view", "error"))), (F.col("id") % 3 + 1).cast("int"))
    events = spark.range(0, 48, 1, 3).select(F.col("id").alias("event_id"), F.lit(7).alias("user_id"), kind.alias("event_type"), F.lit(1.0).alias("value"))
    packets = fixtures.packets_of(events).withColumn("win", F.when(F.col("proto") == 6, 1984 + F.col("pkt_id") % 12).cast("int"))
    return settle(packets.unionByName(packets.filter("pkt_id < 12")), "packets"), rules


def _hits(matched):
    return sorted(matched.select("pkt_id", "rule_id").collect())


def test_an_index_of_rules_with_the_same_tests(spark, monkeypatch):
    """More rules than the index may have entries, and ids in several rows: rules with the same tests are one entry or two."""
    packets, rules = _alike(spark, 20)
    want = _hits(match.first_match(packets, match.collect_rules(rules, 1000)))
    assert len(want) > 1000
    for name, value in (("INDEX_ENTRIES", 30), ("CODES", 6), ("COMPILED_RULES", 0)):
        monkeypatch.setattr(match, name, value)
    assert rules.count() > 200 and match.index_entries(rules) <= 30
    assert _hits(match.first_match_indexed(packets, rules)) == want
    # No room for the ids in a broadcast either.
    monkeypatch.setattr(match, "broadcast_if_small", lambda table: table.hint("merge"))
    assert _hits(match.first_match_indexed(packets, rules)) == want


def test_a_packet_carries_no_ids_of_rules_with_the_same_tests(spark):
    """What the join sorts for a packet doesn't grow with the rules that have the same tests."""
    packets, rules = _alike(spark, 20)
    listed = match._rule_lists(rules, match._RULE_FIELDS[2:])[0]
    assert listed.agg(F.max(F.array_max(F.transform("_rules", lambda rule: F.size(rule["codes"]))))).first()[0] <= 2
    assert _hits(match.first_match_joined(packets, rules)) == _hits(match.first_match(packets, match.collect_rules(rules, 1000)))


def test_match_packets_uses_the_index_for_rules_with_the_same_tests(spark, monkeypatch):
    packets, rules = _alike(spark, 60)
    want = _hits(match.first_match(packets, match.collect_rules(rules, 1000)))
    monkeypatch.setattr(match, "INDEX_ENTRIES", 30)
    monkeypatch.setattr(match, "first_match_joined", None)
    assert _hits(match.match_packets(packets, rules)) == want


def test_ids_of_several_rules_are_not_folded(spark):
    """Two rulesets without books: an id is that of a rule of each, and what goes with it must not be given to the other."""
    one = [f"TCP -d 203.0.113.7/32 --win <{1990 + n // 2} --pps-th 1p --next" for n in range(6)]
    two = [f"TCP -d 203.0.113.7/32 --win <{1994 - n // 3} --pps-th 1p --next" for n in range(6)]
    rules = settle(load_rules(fixtures.rule_texts(spark, one, "a").unionByName(fixtures.rule_texts(spark, two, "b")))[0], "rules")
    packets = _alike(spark, 1)[0].filter("proto = 6 AND pkt_id >= 12")
    limits = [*[1990 + n // 2 for n in range(6)], *[1994 - n // 3 for n in range(6)]]
    want = sorted((row["pkt_id"], n % 6) for row in packets.collect() for n, limit in enumerate(limits) if row["win"] < limit)
    assert want
    for way in (match.first_match_indexed, match.first_match_joined):
        assert _hits(way(packets, rules)) == want


def test_ranges_equal_the_tests(spark):
    """Every operator, bounds that are missing, numbers at the ends, fields that are null or zero, tests of other lists."""
    fields = {f.name: f.dataType for f in RULES.fields}
    blank = dict.fromkeys(RULES.fieldNames())
    cases = [{f"{side}_lo": lo, f"{side}_hi": hi} for side in ("src", "dst", "sport", "dport") for lo in (0, 1, 2, None) for hi in (0, 2, None)]
    cases += [{f"{name}_op": op, f"{name}_num": num} for name in ("seq", "ack", "win", "hlen", "type", "code") for op in ("=", "<", ">", "!", None) for num in (0, 1, 2**63 - 1, -(2**63), None)]
    rules = spark.createDataFrame([tuple((blank | case | {"rule_type": kind}).values()) for kind in PROTO for case in cases], RULES)
    packets = []
    for proto, value in itertools.product(PROTO.values(), (None, 0, 1, 2, 3)):
        packets.append(tuple(None if f.name in ("source_id", "ts") else proto if f.name == "proto" else value for f in PACKETS.fields))
    packets = spark.createDataFrame(packets, PACKETS).withColumn("proto_of", F.col("proto"))
    used = {name for name in fields if name.endswith(("_lo", "_op"))}
    names = range_tests(used)
    assert len(names) == 10
    met = rules.select(F.struct("*").alias("rule"), *[end.alias(f"{name}_{n}") for name in names for n, end in enumerate(rule_range(name))])
    met = met.join(packets.withColumns({f"_v_{name}": packet_value(name) for name in names}))
    for kind, number in PROTO.items():
        here = met.filter((F.col("rule.rule_type") == kind) & (F.col("proto") == number))
        test = F.coalesce(rule_columns_match(kind, F.col, lambda name: F.col(f"rule.{name}"), used), F.lit(False))
        ranges = F.lit(True)
        for name in names:
            ranges &= F.col(f"_v_{name}").between(F.col(f"{name}_0"), F.col(f"{name}_1"))
        counts = here.agg(F.count_if(test), F.count_if(~test), F.count_if(test != ranges)).first()
        assert counts[0] > 100 and counts[1] > 100 and counts[2] == 0


def test_time_ranges_equal_the_time_of_a_book(spark):
    spans = spark.createDataFrame([(a, b) for a in (None, 0, 5_000_000) for b in (None, 5_000_000, 9_000_001)], "a long, b long")
    times = spark.createDataFrame([(None,), (0,), (4_999_999,), (5_000_000,), (9_000_000,), (9_000_001,)], "t long").select(F.timestamp_micros("t").alias("ts"))
    lo, hi = time_range(F.col("a"), F.col("b"))
    met = spans.join(times).withColumn("want", F.coalesce(match.in_force(F.col("ts"), F.col("a"), F.col("b")), F.lit(False)))
    assert met.filter(F.col("want") != time_value(F.col("ts")).between(lo, hi)).count() == 0 and met.filter("want").count() > 10
