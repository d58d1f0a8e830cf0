from pyspark.sql import functions as F

from floodsight.operators.match import first_match_indexed, first_match_joined, index_entries, match_packets, with_rule_id, with_rule_names
from floodsight.operators.rulesets import with_books
from floodsight.plans import fixtures, reports
from floodsight.sinks import alarm_log
from floodsight.sources.rules import load_rules


def test_an_alarm_stays_one_line(spark, tmp_path):
    alarms = spark.createDataFrame([("tcp|203.0.113.9|two\nlines", "log", "/x")], "text string, action_type string, action_param string")
    alarm_log.write_alarm_log(alarms, str(tmp_path / "log"))
    assert [r.line for r in alarm_log.read_alarm_log(spark, str(tmp_path / "log")).collect()] == ["trigger alarm: tcp|203.0.113.9|two\\nlines"]


def test_index_entries_without_ansi_mode(spark):
    rows = [("r", n, f"TCP -d 203.0.113.{n} --pps-th 1p") for n in range(5)]
    rules, _ = load_rules(spark.createDataFrame(rows, "ruleset_id string, line_no int, line string"))
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert index_entries(rules) == 5
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_rules_are_evaluated_from_the_second_tick_on(spark):
    rules = fixtures.rules(spark, ["TCP -d 203.0.113.1/32 --pps-th 1p --pps-th-period 3"])
    start = 1704067200
    values = {"tick": F.lit(start) + F.col("id") % 10, "proto": F.lit(6), "dst_ip": F.lit(3405803777), "src_ip": F.lit(1), "frame_len": F.lit(60)}
    types = {f.name: f.dataType for f in fixtures.PACKETS.fields} | {"tick": "bigint"}
    packets = spark.range(40).select([values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in types.items()])
    ticks = sorted(r.tick - start for r in reports.traffic_alarms(packets, rules).collect())
    assert ticks == [1, 5, 9]
    assert reports.traffic_alarms(packets.limit(0), rules).count() == 0


def test_each_ruleset_of_a_table_meets_all_packets(spark):
    packets, rules = fixtures.packets(spark, "/root/testdata/sf0.01"), fixtures.rules(spark)
    other = fixtures.rules(spark, fixtures.RULE_LINES[2:5]).withColumn("ruleset_id", F.lit("other"))
    alone = [match_packets(packets, table).count() for table in (rules, other)]
    both = with_books(rules.unionByName(other))
    assert [match_packets(packets, both).count(), first_match_indexed(packets, both).count(), first_match_joined(packets, both).count()] == [sum(alone)] * 3
    report = reports.traffic_alarms(packets, rules.unionByName(other), fixtures.FIRST_TICK, fixtures.EPOCH)
    counts = {row["ruleset_id"]: row["count"] for row in report.groupBy("ruleset_id").count().collect()}
    assert counts["main"] == 103 and counts["other"] > 0


def test_rule_numbers_above_a_million_and_books(spark):
    rules = spark.createDataFrame([("tcp", 2_000_000_000, 5), ("icmp", 1_000_001, 2**30 - 1)], "rule_type string, rule_no int, book long")
    named = with_rule_names(with_rule_id(rules).select("rule_id"), book=True)
    assert sorted(map(tuple, named.select("rule_type", "rule_no", "book").collect())) == sorted(map(tuple, rules.collect()))
