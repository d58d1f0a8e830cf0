import datetime as dt

import pytest
from pyspark.sql import functions as F

from floodsight.operators import capture, counters, rates, rulesets, timeseries
from floodsight.operators.match import with_rule_id
from floodsight.plans import fixtures, reports
from floodsight.schemas import FRAMES, PACKETS, RULES
from floodsight.session import scratch_path, settle
from floodsight.sinks import alarm_log, line_protocol
from floodsight.sinks.capture import write_capture
from floodsight.sources.frames import decode_frames, frame_packets, frame_rejects

NOON = dt.datetime(2024, 1, 1, 12)


def rule_table(spark, *lines):
    from floodsight.sources.rules import load_rules

    return load_rules(fixtures.rule_texts(spark, list(lines)))[0]


def ipv4(proto, l4, options=b"", ethertype=b"\x08\x00"):
    head = bytes([0x40 + 5 + len(options) // 4]) + bytes(8) + bytes([proto]) + bytes(2)
    return bytes(12) + ethertype + head + bytes([198, 51, 100, 7, 203, 0, 113, 5]) + options + l4


def test_frames(spark):
    tcp = bytes.fromhex("04d2 01bb fffffffe 00000001 60 12 2000 00000000".replace(" ", ""))
    udp = bytes.fromhex("0035 1f90 0064 0000".replace(" ", ""))
    frames = {
        "tcp": ipv4(6, tcp),
        "options": ipv4(6, tcp, options=bytes(4)),
        "udp": ipv4(17, udp),
        "icmp": ipv4(1, bytes([8, 3, 0, 0])),
        "gre": ipv4(47, bytes(20)),
        "ipv6": ipv4(6, tcp, ethertype=b"\x86\xdd"),
        "cut in L4": ipv4(6, tcp[:19]),
        "cut in IP": ipv4(6, b"")[:33],
        "cut by options": ipv4(17, b"", options=bytes(4)),
        "empty": b"",
    }
    rows = [(bytearray(frame), len(frame) + 100, NOON, name) for name, frame in frames.items()]
    table = spark.createDataFrame(rows, FRAMES)
    got = {r.source_id: r for r in frame_packets(table).collect()}
    assert set(got) == {"tcp", "options", "udp", "icmp"}
    for name in ("tcp", "options"):
        r = got[name]
        assert (r.src_ip, r.dst_ip, r.sport, r.dport) == (3325256711, 3405803781, 1234, 443)
        # SYN and ACK on the wire are 16 and 2 of ours.
        assert (r.seq, r.ack, r.win, r.tcp_hlen, r.tcp_flags) == (4294967294, 1, 8192, 24, 18)
        assert (r.udp_len, r.icmp_type, r.frame_len) == (None, None, len(frames[name]) + 100)
    assert (got["udp"].sport, got["udp"].dport, got["udp"].udp_len, got["udp"].seq) == (53, 8080, 100, None)
    assert (got["icmp"].icmp_type, got["icmp"].icmp_code, got["icmp"].sport) == (8, 3, None)
    rejects = {r.source_id: (r.reject, r.frames) for r in frame_rejects(table).collect()}
    assert rejects == {
        "gre": ("other protocol", 1),
        "ipv6": ("not IPv4", 1),
        **{name: ("short frame", 1) for name in ("cut in L4", "cut in IP", "cut by options", "empty")},
    }
    plan = decode_frames(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_every_tcp_flag_of_a_frame(spark):
    wire = {0x20: 1, 0x10: 2, 0x08: 4, 0x04: 8, 0x02: 16, 0x01: 32, 0x3F: 63, 0xC0: 0}
    rows = [(bytearray(ipv4(6, bytes(13) + bytes([bits]) + bytes(6))), 60, NOON, str(bits)) for bits in wire]
    got = {int(r.source_id): r.tcp_flags for r in frame_packets(spark.createDataFrame(rows, FRAMES)).collect()}
    assert got == wire


UDP = 1 << 31  # the first id of the second list


def test_merge_partials_adds_rings_and_refuses_unknown_rules(spark):
    rules = rule_table(spark, "TCP -d 203.0.113.1 --pps-th 1p", "UDP -d 203.0.113.1 --pps-th 1p")
    schema = "rule_id long, packets long, bytes long"
    one = spark.createDataFrame([(0, 5, 500), (UDP, 1, 60)], schema)
    two = spark.createDataFrame([(0, 7, 700)], schema)
    merged = counters.merge_partials([one, two], ["rule_id"], rules)
    assert sorted(map(tuple, merged.collect())) == [(0, 12, 1200), (UDP, 1, 60)]
    stray = spark.createDataFrame([(1, 5, 500)], schema)
    with pytest.raises(Exception, match="unknown rule: 1"):
        counters.merge_partials([one, stray], ["rule_id"], rules).collect()
    with pytest.raises(Exception, match="unknown rule: 1"):
        counters.merge_partials([one, stray], ["rule_id"], rules).select("packets").collect()


def test_busiest_destination_ties_go_to_the_lowest_address(spark):
    rows = [(0, 1, 4294967295, 3, 1), (0, 1, 9, 3, 1), (0, 1, 10, 3, 1), (0, 1, 1, 2, 1), (0, 2, 4294967295, 1, 1)]
    counts = spark.createDataFrame(rows, "rule_id long, tick long, dst_ip long, packets long, bytes long")
    got = sorted((r.tick, r.dst_ip, r.packets) for r in counters.tick_profile(counts).collect())
    assert got == [(1, 9, 11), (2, 4294967295, 1)]
    ranked = counters.top_destinations(counts, 2)
    assert sorted((r.tick, r["rank"], r.dst_ip) for r in ranked.collect()) == [(1, 1, 9), (1, 2, 10), (2, 1, 4294967295)]
    assert counters.with_dst_text(spark.sql("SELECT CAST(NULL AS BIGINT) AS dst_ip")).first().dst == "0.0.0.0"
    plan = counters.tick_profile(counts)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_rates_round_halves_up_and_skip_resets(spark):
    rows = [(0, 1000, 10, 5), (0, 3000, 13, 1005), (0, 5000, 3, 2007), (1, 400, 1, 1)]
    samples = spark.createDataFrame(rows, "rule_id long, sample_ms long, packets long, bytes long")
    got = {(r.rule_id, r.sample_ms): (r.pps, r.bps) for r in rates.rate_delta(samples, width=1000).collect()}
    assert got == {(0, 1000): (10, 5), (0, 3000): (2, 500), (0, 5000): (None, 501), (1, 400): (3, 3)}


def test_asof_versions_by_constants_and_by_hour_agree(spark, monkeypatch):
    start = dt.datetime(2024, 1, 1)
    gaps = [0, 10, 10, 3000, 9000, 20000, 20001]
    versions = settle(
        spark.createDataFrame(
            [(n, start + dt.timedelta(seconds=s + n / 1000)) for n, s in enumerate(gaps)], "version int, valid_from timestamp"
        ),
        "versions",
    )
    packets = spark.range(0, 40000, 7).select(
        F.col("id").alias("pkt_id"), F.timestamp_seconds(F.col("id") + 1704067200 - 500).alias("ts")
    )

    def run():
        rows = rulesets.asof_ruleset(packets, versions).select("pkt_id", "version", "evaluated").collect()
        return sorted(map(tuple, rows))

    constants = run()
    expected = []
    for pkt in range(0, 40000, 7):
        at = pkt - 500
        live = [n for n, s in enumerate(gaps) if s + n / 1000 <= at]
        if live:
            expected.append((pkt, live[-1], at > gaps[live[-1]]))
    assert constants == expected
    monkeypatch.setattr(rulesets, "COMPILED_VERSIONS", 2)
    assert run() == expected


def test_ruleset_diff_sees_tests_and_places_but_not_texts(spark):
    old = rule_table(spark, "TCP -d 203.0.113.1 --pps-th 1p", "TCP -d 203.0.113.2 --pps-th 1p")
    same = rule_table(spark, "TCP -d 203.0.113.1 --pps-th 1p -c note -a log:/tmp/x", "TCP --dst 203.0.113.2 --pps-th 1p")
    assert rulesets.ruleset_diff(old, same).count() == 0
    zero = rule_table(spark, "TCP -d 203.0.113.1 --pps-th 1p --seq =0", "TCP -d 203.0.113.2 --pps-th 1p")
    assert sorted(r.side for r in rulesets.ruleset_diff(old, zero).collect()) == ["new", "old"]
    swapped = rule_table(spark, "TCP -d 203.0.113.2 --pps-th 1p", "TCP -d 203.0.113.1 --pps-th 1p")
    assert rulesets.ruleset_diff(old, swapped).count() == 4


def test_capture_takes_the_first_packets_within_the_span(spark, tmp_path):
    alarms = spark.createDataFrame(
        [(0, 6, 5, NOON), (1, 6, 5, NOON + dt.timedelta(seconds=59))], "rule_id long, proto int, dst_ip long, ts timestamp"
    )
    rows = [(n, NOON + dt.timedelta(milliseconds=500 * n - 2000), 6 if n % 3 else 17, 5 if n % 5 else 6) for n in range(400)]
    packets = spark.createDataFrame(rows, "pkt_id long, ts timestamp, proto int, dst_ip long")
    got = capture.interval_capture(packets, alarms)
    want = sorted(
        (rule, n)
        for rule, at in ((0, 0), (1, 59))
        for n in range(400)
        if n % 3 and n % 5 and 0 <= (500 * n - 2000) - 1000 * at <= 60_000
    )
    assert sorted((r.alarm_rule_id, r.pkt_id) for r in got.collect()) == want
    narrowed = reports.captured_packets(packets, settle(alarms, "alarms"))
    assert sorted((r.alarm_rule_id, r.pkt_id) for r in narrowed.collect()) == want
    assert reports.captured_packets(packets, settle(alarms.limit(0), "alarms")).count() == 0
    limited = capture.limit_capture(got, 10)
    firsts = [[p for r, p in want if r == rule][:10] for rule in (0, 1)]
    assert sorted((r.alarm_rule_id, r.pkt_id) for r in limited.collect()) == [(r, p) for r in (0, 1) for p in firsts[r]]
    full = capture.limit_capture(got)
    assert "WindowGroupLimit" in full._jdf.queryExecution().executedPlan().toString()
    write_capture(limited, str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.host) for r in stored.collect()} == {"0.0.0.5"} and stored.count() == 20


def points_of(spark):
    rows = [(0, 10, 5, 100), (0, 11, 6, 100), (0, 20, 7, 200), (1, 40, 1, 10)]
    table = settle(spark.createDataFrame(rows, "rule_id long, tick long, pps long, bps long"), "rates")
    rules = rule_table(spark, "TCP -d 203.0.113.1 --pps-th 1p", "TCP -d 203.0.113.2 --pps-th 1p", "ICMP -d 203.0.113.2 --pps-th 1p")
    return timeseries.metric_points(table, rules, 10), rules


def test_points_have_zeros_totals_and_a_mark_for_empty_lists(spark):
    points, _ = points_of(spark)
    got = {(F_(r.time), r.measurement, r.rule, r.type): (r.pps, r.bps) for r in points.collect()}
    assert len(got) == 4 * (3 + 2 + 1)
    assert got[10, "tcp", 0, None] == (5, 800) and got[10, "tcp", 1, None] == (0, 0)
    assert got[20, "total", None, "tcp"] == (7, 1600) and got[30, "total", None, "tcp"] == (0, 0)
    assert got[40, "tcp", 1, None] == (1, 80) and got[40, "total", None, "icmp"] == (0, 0)
    assert got[10, "total", None, "none"] == (0, 0)


def F_(time):
    return int(time.replace(tzinfo=dt.timezone.utc).timestamp())


def test_sample_grid_is_whole_across_blocks(spark):
    _, rules = points_of(spark)
    grid = timeseries.sample_grid(rules, 5, 25_000, 10)
    assert grid.count() == grid.distinct().count() == 3 * 2500
    assert timeseries.sample_grid(rules, 11, 19, 10).count() == 0


def test_lines(spark, tmp_path):
    points, _ = points_of(spark)
    lines = {r.line for r in line_protocol.metric_lines(points).collect()}
    assert "tcp,rule=0 pps=5,bps=800 10000000000" in lines
    assert "total,type=tcp pps=7,bps=1600 20000000000" in lines
    assert "total,type=none pps=0,bps=0 10000000000" in lines
    events = spark.createDataFrame(
        [(NOON, "203.0.113.5", 800, 11, "tcp", 'say "hi" \\')], "time timestamp, dst string, bps long, pps long, type string, comment string"
    )
    line = line_protocol.event_lines(events).first().line
    assert line == (
        f'events,dst=203.0.113.5 bps=800,pps=11,type="tcp",comment="say \\"hi\\" \\\\" {F_(NOON)}000000000'
    )
    line_protocol.write_lines(line_protocol.metric_lines(points), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == points.count()


def test_alarm_log_keeps_targets_apart_and_appends(spark, tmp_path):
    rows = [("tcp|1.2.3.4", "log", "/tmp/a=b/c.log"), ("udp|1.2.3.4|dns", "syslog", "")]
    alarms = spark.createDataFrame(rows, "text string, action_type string, action_param string")
    for _ in range(2):
        alarm_log.write_alarm_log(alarms, str(tmp_path / "log"))
    got = sorted(map(tuple, alarm_log.read_alarm_log(spark, str(tmp_path / "log")).collect()))
    assert got == 2 * [("trigger alarm: tcp|1.2.3.4", "log", "/tmp/a=b/c.log")] + 2 * [
        ("trigger alarm: udp|1.2.3.4|dns", "syslog", "")
    ]


def test_time_series_queries(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=s), "total", None, "tcp", p, p * 10) for s, p in ((0, 1), (30, 2), (150, 9))]
    rows += [(start + dt.timedelta(seconds=s), "tcp", 0, None, 4, 40) for s in (0, 7200)]
    points = spark.createDataFrame(rows, "time timestamp, measurement string, rule int, type string, pps long, bps long")
    means = [(F_(r.time) - F_(start), r.mean_bps, r.mean_pps) for r in timeseries.mean_1m_total(points).orderBy("time").collect()]
    assert means == [(0, 15.0, 1.5), (120, 90.0, 9.0)]
    assert timeseries.last_total(points).collect()[0].bps == 90
    assert timeseries.mean_1m_rule(points).count() == 2
    assert timeseries.mean_1m_rule(points, last_minutes=30).count() == 1
    bands = spark.createDataFrame([(499_999_999,), (500_000_000,), (1_000_000_000,)], "v long")
    got = [r.s for r in bands.select(timeseries.severity(F.col("v"), timeseries.BPS_BANDS).alias("s")).collect()]
    assert got == [0, 1, 2]


def test_listing_of_rules(spark):
    rules = rule_table(
        spark, "TCP -s 198.51.100.32/27 --bps-th 3Kb", "TCP --dport 8000-8100 -d 203.0.113.64/26 --pps-th 40p", "ICMP -d 203.0.113.7 --pps-th 2p --next"
    )
    icmp = with_rule_id(rules).where("rule_type = 'icmp'").first().rule_id
    counted = spark.createDataFrame([(0, 512, 40960), (1, 7, 777), (icmp, 3, 252)], "rule_id long, packets long, bytes long")
    now = spark.createDataFrame([(0, 2500, 200000), (1, 7, 777)], "rule_id long, pps long, bps long")
    lines = [r.line for r in reports.show_rules(counted, now, rules).collect()]
    # fixed values: the headings, the word order and the padding of the listing
    assert lines == [
        "TCP rules (num, rule, counter):",
        "    0:   -s 198.51.100.32/27 --bps-th 3Kb                    : 2.50Kp/s (1.60Mb/s), 512 packets, 40960 bytes",
        "    1:   --dport 8000-8100 -d 203.0.113.64/26 --pps-th 40p   : 7.00p/s (6.22Kb/s), 7 packets, 777 bytes",
        "Total: 2.51Kp/s (1.61Mb/s), 519 packets, 41737 bytes",
        "UDP rules (num, rule, counter):",
        "Total: 0.00p/s (0.00b/s), 0 packets, 0 bytes",
        "ICMP rules (num, rule, counter):",
        "    0:   -d 203.0.113.7 --pps-th 2p --next   : 0.00p/s (0.00b/s), 3 packets, 252 bytes",
        "Total: 0.00p/s (0.00b/s), 3 packets, 252 bytes",
    ]


def test_scratch_paths_lie_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_schemas_have_the_documented_types():
    assert PACKETS["src_ip"].dataType.typeName() == "long" and RULES["seq_num"].dataType.typeName() == "long"
