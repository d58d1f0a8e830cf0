import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

import walks
from floodsight.operators import match
from floodsight.operators.match import with_rule_names
from floodsight.plans import fixtures
from floodsight.schemas import PACKETS, RULES
from floodsight.sources.packets import read_packets, store_packets


def random_rule(rng, kind, number):
    rule = dict.fromkeys(RULES.fieldNames())
    rule |= {
        "ruleset_id": "r", "rule_type": kind, "rule_no": number, "text_rule": "", "pps_th": 1, "bps_th": 0,
        "pps_period": 1, "bps_period": 1, "next_rule": rng.random() < 0.4, "action_type": "syslog",
        "action_param": "", "comment": "",
    }
    for side in ("src", "dst"):
        if rng.random() < 0.7:
            lo = rng.choice([0, 1, 250, 256, 300, 70000, 4294967290])
            rule[f"{side}_lo"], rule[f"{side}_hi"] = lo, min(lo + rng.choice([0, 5, 300, 100_000, 2**32]), 2**32 - 1)
    if kind != "icmp":
        for side in ("sport", "dport"):
            if rng.random() < 0.3:
                lo = rng.randrange(4)
                rule[f"{side}_lo"], rule[f"{side}_hi"] = lo, lo + rng.randrange(-1, 3)
    for name in walks.COMPARED[kind]:
        if rng.random() < 0.25:
            rule[f"{name}_op"], rule[f"{name}_num"] = rng.choice("=<>"), rng.randrange(4)
    if kind == "tcp" and rng.random() < 0.3:
        mask = rng.randrange(64)
        rule["flag_mask"], rule["flag_bits"] = mask, mask & rng.randrange(64)
    return rule


def random_packet(rng, number):
    packet = dict.fromkeys(PACKETS.fieldNames())
    proto = rng.choice([6, 17, 1, 47])
    address = [0, 1, 3, 254, 255, 256, 301, 400, 70001, 4294967295]
    packet |= {
        "pkt_id": number, "source_id": "a", "proto": proto, "src_ip": rng.choice(address),
        "dst_ip": rng.choice(address), "frame_len": 60 + rng.randrange(100),
    }
    if proto in (6, 17):
        packet |= {"sport": rng.randrange(5), "dport": rng.randrange(5)}
    if proto == 6:
        packet |= {name: rng.randrange(5) for name in ("seq", "ack", "win", "tcp_hlen")}
        packet["tcp_flags"] = rng.randrange(64)
    if proto == 17:
        packet["udp_len"] = rng.randrange(5)
    if proto == 1:
        packet |= {"icmp_type": rng.randrange(5), "icmp_code": rng.randrange(5)}
    return packet


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(row[name] for name in schema.fieldNames()) for row in rows], schema)


def pairs(df):
    named = with_rule_names(df.select("pkt_id", "rule_id"))
    return sorted((r.pkt_id, r.rule_type, r.rule_no) for r in named.collect())


@pytest.mark.parametrize("seed, count", [(1, 3), (2, 8), (3, 45), (4, 80)])
def test_all_ways_of_matching_agree_with_the_walk(spark, seed, count):
    rng = random.Random(seed)
    rules = [random_rule(rng, kind, n) for kind in ("tcp", "udp", "icmp") for n in range(count)]
    packets = [random_packet(rng, n) for n in range(300)]
    expected, ended = [], []
    for packet in packets:
        hits, end = walks.first_match([r for r in rules if walks.PROTO[r["rule_type"]] == packet["proto"]], packet)
        expected += [(packet["pkt_id"], *hit) for hit in hits]
        if end:
            ended.append(packet["pkt_id"])
    everything = sorted(
        (p["pkt_id"], r["rule_type"], r["rule_no"]) for p in packets for r in rules if walks.matches(r, p)
    )
    table, traffic = frame(spark, rules, RULES), frame(spark, packets, PACKETS)
    ruleset = match.collect_rules(table)
    assert pairs(match.first_match(traffic, ruleset)) == sorted(expected)
    assert pairs(match.first_match_indexed(traffic, table)) == sorted(expected)
    assert pairs(match.first_match_joined(traffic, table)) == sorted(expected)
    assert pairs(match.all_matches(traffic, ruleset)) == everything
    assert sorted(r.pkt_id for r in match.captured(traffic, ruleset).collect()) == ended
    left = sorted(r.pkt_id for r in match.unmatched(traffic, ruleset).collect())
    assert left == sorted({p["pkt_id"] for p in packets} - set(ended))


def test_index_by_version_uses_the_rules_of_the_version(spark):
    rng = random.Random(5)
    first = [random_rule(rng, "tcp", n) for n in range(5)]
    second = [random_rule(rng, "tcp", n) for n in range(5)]
    packets = [p for p in (random_packet(rng, n) for n in range(200)) if p["proto"] == 6]
    rules = frame(spark, first, RULES).withColumn("version", F.lit(0))
    rules = rules.unionByName(frame(spark, second, RULES).withColumn("version", F.lit(1)))
    traffic = frame(spark, packets, PACKETS).withColumn("version", (F.col("pkt_id") % 2).cast("int"))
    expected = [
        (p["pkt_id"], *hit)
        for p in packets
        for hit in walks.first_match(second if p["pkt_id"] % 2 else first, p)[0]
    ]
    assert pairs(match.first_match_indexed(traffic, rules, ["version"])) == sorted(expected)


def test_match_packets_falls_back_by_size(spark, monkeypatch):
    rng = random.Random(6)
    rules = frame(spark, [random_rule(rng, "udp", n) for n in range(6)], RULES)
    traffic = frame(spark, [random_packet(rng, n) for n in range(100)], PACKETS)
    compiled = pairs(match.match_packets(traffic, rules))
    monkeypatch.setattr(match, "first_match", None)
    collect, calls = match.collect_rules, []
    monkeypatch.setattr(match, "collect_rules", lambda table: calls.append(1) or (None if len(calls) % 2 else collect(table)))
    assert pairs(match.match_packets(traffic, rules)) == compiled
    monkeypatch.setattr(match, "INDEX_ENTRIES", 0)
    calls.append(1)
    with pytest.raises(ValueError, match="too many"):
        match.first_match_indexed(traffic, rules)
    assert pairs(match.match_packets(traffic, rules)) == compiled


@pytest.mark.parametrize("lanes", [0, 1, 4])
def test_index_with_many_rules_at_a_key_books_and_spans(spark, monkeypatch, lanes):
    """Rules of both sides, several books, each with a span of time, a few keys with very many rules."""
    rng = random.Random(9)
    rules = []
    for book in range(3):
        for kind in ("tcp", "udp", "icmp"):
            for number in range(30):
                rule = random_rule(rng, kind, number)
                side = rng.choice(["src", "dst"])
                if number < 27:
                    rule[f"{side}_lo"] = rng.choice([1, 254, 256, 400])
                    rule[f"{side}_hi"] = rule[f"{side}_lo"] + rng.choice([0, 0, 1, 200])
                rules.append(rule | {"book": book, "from_us": [None, 100, 250][book], "to_us": [150, None, 10_000][book]})
    packets = [random_packet(rng, n) for n in range(300)]
    expected = []
    for packet in packets:
        for book in range(3):
            mine = [r for r in rules if r["book"] == book and walks.PROTO[r["rule_type"]] == packet["proto"]]
            if mine and (mine[0]["from_us"] or 0) <= packet["pkt_id"] < (mine[0]["to_us"] or 10**9):
                expected += [(packet["pkt_id"], book, *hit) for hit in walks.first_match(mine, packet)[0]]
    schema = RULES.fieldNames()
    table = spark.createDataFrame([tuple(r[n] for n in schema) + (r["book"], r["from_us"], r["to_us"]) for r in rules],
        StructType([*RULES.fields, *(StructField(n, LongType()) for n in ("book", "from_us", "to_us"))]))
    traffic = frame(spark, packets, PACKETS).withColumn("ts", F.timestamp_micros("pkt_id"))
    monkeypatch.setattr(match, "LANES", lanes)
    for way in (match.first_match_indexed, match.first_match_joined, lambda p, r: match.first_match(p, match.collect_rules(r, 1000))):
        named = with_rule_names(way(traffic, table).select("pkt_id", "rule_id"), book=True)
        assert sorted((r.pkt_id, r.book, r.rule_type, r.rule_no) for r in named.collect()) == sorted(expected)


def test_compiled_match_neither_shuffles_nor_leaves_the_jvm(spark):
    rng = random.Random(7)
    ruleset = match.collect_rules(frame(spark, [random_rule(rng, "tcp", n) for n in range(40)], RULES))
    plan = match.first_match(frame(spark, [random_packet(rng, 1)], PACKETS), ruleset)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text and "Python" not in text


def test_a_list_reads_only_the_folders_of_its_protocol(spark, tmp_path):
    ruleset = match.RuleSet(
        [row for row in fixtures.ruleset(spark).rows if row["rule_type"] == "udp"]
    )
    store_packets(fixtures.packets(spark, "/root/testdata/sf0.001"), str(tmp_path / "p"))
    stored = read_packets(spark, str(tmp_path / "p"))
    plan = match.first_match(stored, ruleset)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(proto#\d+ = 17\)", plan), plan
    assert stored.count() == 1000


def test_no_rules_match_nothing(spark):
    traffic = frame(spark, [random_packet(random.Random(8), n) for n in range(20)], PACKETS)
    assert match.first_match(traffic, match.RuleSet([])).count() == 0
    assert match.unmatched(traffic, match.RuleSet([])).count() == 20
