"""Crowded rule keys and long captures."""

from pyspark.sql import functions as F

from floodsight.operators import match, rulesets
from floodsight.plans import fixtures
from floodsight.session import settle
from floodsight.sinks.capture import write_capture
from floodsight.sources.rules import load_rules


def test_a_long_capture_is_stored_in_few_files(spark, tmp_path):
    """Two hosts over two days, from many tasks: a file for each folder, not for each minute and task."""
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60)
    captured = spark.range(0, 2880, 1, 6).select(
        (F.col("id") % 3).alias("alarm_rule_id"), ts.alias("alarm_ts"), F.col("id").alias("pkt_id"), ts.alias("ts"), (5 + F.col("id") % 2).alias("dst_ip")
    )
    write_capture(captured, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert len(stored.inputFiles()) == 4
    want = captured.withColumns({"host": F.concat(F.lit("0.0.0."), "dst_ip"), "minute": F.date_format("ts", "yyyyMMddHHmm").cast("bigint")})
    columns = [*captured.columns, "host", "minute"]
    assert sorted(stored.select(*columns).collect()) == sorted(want.select(*columns).collect())


def _crowded(spark, users):
    """Rules of two rulesets that all lie under one host, most of them with tests that others have too; packets to that host."""
    tests = [f"--win <{1990 + user % 7}" for user in range(users)]
    nexts = [user % 5 == 0 or user < users // 2 for user in range(users)]
    lines = [f"TCP -d 203.0.113.7/32 {test} --pps-th {1 + n}p{' --next' if goes_on else ''}" for n, (test, goes_on) in enumerate(zip(tests, nexts))]
    lines += [f"TCP -d 0.0.0.0/0 --win >1993 --pps-th {1 + n}p --next" for n in range(3)] + [f"UDP -d 203.0.113.7/32 --dport 53 --pps-th {1 + n}p" for n in range(9)]
    texts = fixtures.rule_texts(spark, lines, "a").unionByName(fixtures.rule_texts(spark, lines[::-1], "b"))
    rules = settle(rulesets.with_books(load_rules(texts)[0]), "rules")
    kind = F.when(F.col("id") % 4 == 3, "view").otherwise("click")
    events = spark.range(0, 60, 1, 3).select(F.col("id").alias("event_id"), F.lit(7).alias("user_id"), kind.alias("event_type"), F.lit(1.0).alias("value"))
    packets = fixtures.packets_of(events).withColumn("win", F.when(F.col("proto") == 6, 1985 + F.col("pkt_id") % 12).cast("int"))
    return packets.unionByName(packets.filter("pkt_id < 20")), rules


def test_a_crowded_key_of_the_join_is_tested_in_its_rows(spark, monkeypatch):
    """Hits don't leave the row of the packet before they are cut: packets are shuffled once, before they meet the rules."""
    packets, rules = _crowded(spark, 80)
    want = sorted(match.first_match(packets, match.collect_rules(rules, 1000)).select("pkt_id", "rule_id").collect())
    assert len(want) > 1000
    for listed, codes in ((256, 256), (2, 3)):
        monkeypatch.setattr(match, "LISTED", listed)
        monkeypatch.setattr(match, "CODES", codes)
        joined = match.first_match_joined(packets, rules).select("pkt_id", "rule_id")
        assert sorted(joined.collect()) == want
        text = joined._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in text


def test_the_join_by_shuffle_gives_the_same(spark, monkeypatch):
    packets, rules = _crowded(spark, 30)
    want = sorted(match.first_match(packets, match.collect_rules(rules, 1000)).select("pkt_id", "rule_id").collect())
    monkeypatch.setattr(match, "broadcast_if_small", lambda table: table.hint("merge"))
    joined = match.first_match_joined(packets, rules).select("pkt_id", "rule_id")
    assert sorted(joined.collect()) == want and "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()


def test_rules_with_the_same_tests_are_one_row(spark):
    _, rules = _crowded(spark, 80)
    fields = match._RULE_FIELDS[2:]
    folded = match.folded_rules(match.placed_rules(rules), fields).collect()
    # Seven tests of TCP to the host, the wide one and one of UDP in each book.
    assert len(folded) == 2 * (7 + 1 + 1)
    assert all(sum(code >= 0 for code in row["codes"]) <= 1 for row in folded)
    assert sum(len(row["codes"]) for row in folded) < rules.count()
