
from pyspark.sql import functions as F

from floodsight.functions import addresses, rule_text, sizes
from floodsight.plans import fixtures
from floodsight.sources.rules import load_rules, read_rule_files


def column_values(spark, texts, expression):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    return [row.v for row in df.select("n", expression(F.col("t")).alias("v")).orderBy("n").collect()]


def load(spark, *lines):
    accepted, rejected = load_rules(fixtures.rule_texts(spark, list(lines)))
    good = {(r.rule_type, r.rule_no): r for r in accepted.collect()}
    return good, {r.line_no: r.reason for r in rejected.collect()}


def test_cidr(spark):
    cases = {
        "1.2.3.4": (16909060, 16909060),
        "10.1.2.3/8": (167772160, 184549375),
        "1.2.3.4/0": (0, 4294967295),
        "0.0.0.0/0": (0, 4294967295),
        "128.0.0.0/1": (2147483648, 4294967295),
        "0.0.0.0/31": (0, 1),
        "255.255.255.255/32": (4294967295, 4294967295),
        "0.0.0.0": None,
        "0.0.0.0/32": None,
        "1.2.3": None,
        "1.2.3.256": None,
        "01.2.3.4": None,
        "1.2.3.4/33": None,
        "1.2.3.4/x": None,
        "1.2.3.4/-1": None,
    }
    got = column_values(spark, cases, addresses.cidr_range)
    assert [None if v is None else tuple(v) for v in got] == list(cases.values())


def test_ports(spark):
    cases = {"80": (80, 80), "80-443": (80, 443), "0-80": (0, 80), "443-80": (443, 80), "0": None, "0-0": None,
             "abc": None, "65536": None, "1-70000": None, "99999999999": None, "-5": None}
    got = column_values(spark, cases, addresses.port_range)
    assert [None if v is None else tuple(v) for v in got] == list(cases.values())


def test_texts_of_addresses_and_ranges(spark):
    row = spark.range(1).select(
        addresses.ip_text(F.lit(3405803781)).alias("a"),
        addresses.ip_range_text(F.lit(0), F.lit(4294967295)).alias("b"),
        addresses.num_range_text(F.lit(80), F.lit(443)).alias("c"),
    ).first()
    assert tuple(row) == ("203.0.113.5", "0.0.0.0-255.255.255.255", "80-443")


def test_size_parse(spark):
    bits = {"100Mb": 12500000, "7b": 0, "8b": 1, "9b": 1, "40Gb": 5_000_000_000, "1Pb": 125 * 10**12, "100": None,
            "Mb": None, "10Mp": None, "10mb": None, "-1Mb": None, "10 Mb": None, "99999999Pb": None}
    assert column_values(spark, bits, lambda t: sizes.size_parse(t, True)) == list(bits.values())
    packets = {"10p": 10, "10Kp": 10_000, "5Gp": 5 * 10**9, "1Tp": 10**12, "10Kb": None, "0p": 0}
    assert column_values(spark, packets, lambda t: sizes.size_parse(t, False)) == list(packets.values())


def test_size_text(spark):
    bits = {"0": "0.00b/s", "31": "248.00b/s", "4096": "32.77Kb/s", "70000000": "560.00Mb/s",
            "125": "1.00Kb/s", "124": "992.00b/s", "125000000000000000": "1000.00Pb/s"}
    assert column_values(spark, bits, lambda t: sizes.size_text(t.cast("long"), True)) == list(bits.values())
    # Ties of two decimals go to the even digit.
    packets = {"31": "31.00p/s", "4096000": "4.10Mp/s", "1125": "1.12Kp/s", "1375": "1.38Kp/s",
               "1005": "1.00Kp/s", "999999": "1000.00Kp/s"}
    assert column_values(spark, packets, lambda t: sizes.size_text(t.cast("long"), False)) == list(packets.values())


def test_compare_parse(spark):
    cases = {"=0": ("=", 0), ">100": (">", 100), "<65535": ("<", 65535), ">65536": None, "=": None, "5": None,
             "!5": None, "=5x": None, "=-5": None, "": None}
    got = column_values(spark, cases, lambda t: sizes.compare_parse(t, 65535))
    assert [None if v is None else tuple(v) for v in got] == list(cases.values())


def test_flags_parse(spark):
    # U, A, P, R, S, F are bits 1, 2, 4, 8, 16, 32.
    cases = {"P:1,R:0,A:1": (6, 14), "S:1,A:0": (16, 18), "S:1,S:0": (0, 16), "S:0,S:1": (16, 16), "R:1": (8, 8),
             "X:1": None, "S:2": None, "S": None, "": None, "S:1,,A:1": (18, 18)}
    got = column_values(spark, cases, rule_text.flags_parse)
    assert [None if v is None else tuple(v) for v in got] == list(cases.values())


def test_action_parse(spark):
    cases = {"syslog": ("syslog", ""), "log:/tmp/a.log": ("log", "/tmp/a.log"), "script:/a/b": ("script", "/a/b"),
             "mail:x": None, "log:a:b": None, "": None, "log:'a:b'": ("log", "a:b")}
    got = column_values(spark, cases, rule_text.action_parse)
    assert [None if v is None else tuple(v) for v in got] == list(cases.values())


def test_tokenize(spark):
    cases = {
        "a  b c ": ["a", "b", "c"],
        '-c "two words" x': ["-c", "two words", "x"],
        "a\\ b c": ["a b", "c"],
        '"it\'s': ["its"],
        "'q u' \"\" r": ["q u", "r"],
        "x\\\\y": ["x\\y"],
        "x\\ny": ["x\ny"],
        "x\\\\ny": ["x\\ny"],
        'pre"in side"post': ["prein sidepost"],
        "": [],
    }
    assert column_values(spark, cases, rule_text.tokenize) == list(cases.values())


def test_alarm_text(spark):
    rows = spark.createDataFrame([("tcp", "1.2.3.4", ""), ("udp", "1.2.3.4", "dns")], "a string, b string, c string")
    got = [r.t for r in rows.select(rule_text.alarm_text(F.col("a"), F.col("b"), F.col("c")).alias("t")).collect()]
    assert got == ["tcp|1.2.3.4", "udp|1.2.3.4|dns"]


def test_rule_folder(spark, tmp_path):
    (tmp_path / "a.rules").write_text("\n".join(["# all kinds", *fixtures.wide_rule_lines()]))
    (tmp_path / "b.rules").write_text("\nSCTP -d 203.0.113.1 --pps-th 1p\nUDP -d 203.0.113.2 --pps-th 4p\n\nUDP --bogus 3\n")
    accepted, rejected = load_rules(read_rule_files(spark, str(tmp_path)))
    counts = {(r.ruleset_id, r.rule_type): r["count"] for r in accepted.groupBy("ruleset_id", "rule_type").count().collect()}
    assert counts == {("a.rules", "tcp"): 36, ("a.rules", "udp"): 14, ("a.rules", "icmp"): 9, ("b.rules", "udp"): 1}
    assert sorted((r.ruleset_id, r.reason.split(":")[0]) for r in rejected.collect()) == [("b.rules", "unknown option"), ("b.rules", "unknown rule type")]
    for kind, count in (("tcp", 36), ("udp", 14), ("icmp", 9)):
        found = accepted.where((F.col("ruleset_id") == "a.rules") & (F.col("rule_type") == kind)).collect()
        assert sorted(r.rule_no for r in found) == list(range(count))


def test_defaults_and_every_option(spark):
    good, bad = load(
        spark,
        "TCP -s 198.51.100.0/24 --pps-th 5p",
        "TCP --dstip=203.0.113.1 -s198.51.100.7 --sport 1-2 --dport 3 --seq =4 --ack >5 --win <6 --hlen =20 "
        "--tcp-flag S:1,A:0 --pps-th 7Kp --bps-th 8Kb --pps-th-period 9 --bps-th-period 10 --action log:/tmp/x "
        '--comment "two words" --next',
        "UDP -d 203.0.113.1 --bps-th 1Mb --bps-th-per 3",
        "ICMP -d 203.0.113.1 --pps-th 1p --type =8 --code <5",
    )
    assert not bad
    plain, full = good["tcp", 0], good["tcp", 1]
    assert (plain.pps_th, plain.bps_th, plain.pps_period, plain.bps_period) == (5, 0, 10, 10)
    assert (plain.action_type, plain.action_param, plain.comment, plain.next_rule) == ("syslog", "", "", False)
    assert (plain.dst_lo, plain.seq_op, plain.flag_mask) == (None, None, None)
    assert (full.src_lo, full.dst_lo, full.sport_hi, full.dport_lo) == (3325256711, 3405803777, 2, 3)
    assert (full.seq_op, full.ack_num, full.win_op, full.hlen_num) == ("=", 5, "<", 20)
    assert (full.pps_th, full.bps_th, full.pps_period, full.bps_period) == (7000, 1000, 9, 10)
    assert (full.action_type, full.action_param, full.comment, full.next_rule) == ("log", "/tmp/x", "two words", True)
    assert full.text_rule.endswith("--comment two words --next ")
    assert good["udp", 0].bps_period == 3
    assert (good["icmp", 0].type_num, good["icmp", 0].code_op) == (8, "<")


REJECTED = {
    "TCP -d 203.0.113.1 --dport 0 --pps-th 1p": "bad dport: 0",
    "TCP -d 203.0.113.1 --dport abc --pps-th 1p": "bad dport: abc",
    "TCP -d 203.0.113 -s 198.51.100.1 --pps-th 1p": "bad dstip: 203.0.113",
    "TCP -d 203.0.113.1/40 --pps-th 1p": "bad dstip: 203.0.113.1/40",
    "TCP --pps-th 1p": "no srcip or dstip",
    "TCP -d 203.0.113.1": "no pps or bps threshold",
    "TCP -d 203.0.113.1 --bps-th 7b": "no pps or bps threshold",
    "TCP -d 203.0.113.1 --pps-th 100": "bad pps-th: 100",
    "TCP -d 203.0.113.1 --bps-th 1Zb": "bad bps-th: 1Zb",
    "TCP -d 203.0.113.1 --pps-th 1p --pps-th-period 0": "pps period below 1",
    "TCP -d 203.0.113.1 --pps-th 1p --pps-th-period x": "bad pps-th-period: x",
    "TCP -d 203.0.113.1 --pps-th 1p --seq =4294967296": "bad seq: =4294967296",
    "TCP -d 203.0.113.1 --pps-th 1p --win !5": "bad win: !5",
    "TCP -d 203.0.113.1 --pps-th 1p --action mail:me": "bad action: mail:me",
    "TCP -d 203.0.113.1 --pps-th 1p --tcp-flag S": "bad tcp-flag: S",
    "TCP -d 203.0.113.1 --pps-th 1p --pps-th 2p": "repeated option: pps-th",
    "TCP -d 203.0.113.1 --pps-th": "no value for option: pps-th",
    "TCP -d 203.0.113.1 --pps-th 1p stray": "bad option: stray",
    "TCP -d 203.0.113.1 --pps-th 1p --next=1": "option next takes no value",
    "UDP -d 203.0.113.1 --pps-th 1p --seq =1": "unknown option: --seq",
    "ICMP -d 203.0.113.1 --pps-th 1p --dport 5": "unknown option: --dport",
    "TCP --p 203.0.113.1": "ambiguous option: --p",
    "TCP -d 203.0.113.1 --pps-th 1p -c a\\b": "unknown escape",
    "tcp -d 203.0.113.1 --pps-th 1p": "unknown rule type: tcp",
}


def test_rejected_rules_have_a_reason_and_loading_goes_on(spark):
    good, bad = load(spark, *REJECTED, "TCP -d 203.0.113.1 --bps-th 7b --pps-th 1p", "TCP", "   ", "#TCP x")
    assert bad == dict(enumerate(REJECTED.values()))
    assert list(good) == [("tcp", 0)]


def test_thresholds_above_32_bits_are_kept(spark):
    good, _ = load(spark, "TCP -d 203.0.113.1 --bps-th 40Gb --pps-th 5Gp")
    assert (good["tcp", 0].bps_th, good["tcp", 0].pps_th) == (5 * 10**9, 5 * 10**9)



def test_rules_of_many_sets_are_numbered_apart(spark):
    rows = [(f"set{n % 2}", n, f"TCP -d 203.0.113.{n} --pps-th 1p") for n in range(1, 20)]
    accepted, _ = load_rules(spark.createDataFrame(rows, "ruleset_id string, line_no long, line string"))
    for name, first in (("set0", 2), ("set1", 1)):
        got = [(r.rule_no, r.dst_lo - 3405803776) for r in accepted.filter(F.col("ruleset_id") == name).collect()]
        assert sorted(got) == list(enumerate(range(first, 20, 2)))
