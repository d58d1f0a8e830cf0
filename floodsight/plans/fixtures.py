"""Packets derived from the `events` test table, and the rules that are run over them."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floodsight.operators.match import RuleSet, collect_rules
from floodsight.operators.rulesets import with_books
from floodsight.schemas import PACKETS, RULE_TEXTS
from floodsight.session import settle
from floodsight.sources.rules import load_rules

# Unix time of tick 0, and the first tick at which triggers are looked at.
EPOCH = 1704067200
FIRST_TICK = 1
RINGS = 12
EVENT_KINDS = ("click", "error", "purchase", "signup", "view")

RULE_LINES = [
    "TCP -d 203.0.113.0/28 --dport 80-443 --pps-th 10p --pps-th-period 3 --next",
    "TCP -d 203.0.113.5/32 --bps-th 4Kb --bps-th-period 1",
    "TCP -s 198.51.100.0/25 --tcp-flag S:1,A:0 --pps-th 10p --pps-th-period 5 --comment syn",
    "TCP -d 0.0.0.0/0 --pps-th 10p --pps-th-period 4 --bps-th 16Kb --bps-th-period 6",
    "UDP -d 203.0.113.0/24 --dport 53 --pps-th 2p --pps-th-period 1",
    "UDP -d 0.0.0.0/0 --hlen >100 --bps-th 1Kb --bps-th-period 1",
    "ICMP -d 203.0.113.0/24 --type =8 --code =0 --pps-th 1p --pps-th-period 1 --next",
    "ICMP -d 0.0.0.0/0 --type <5 --pps-th 4p --pps-th-period 2",
]


def wide_rule_lines() -> list[str]:
    """59 rules over both sides and every kind of test: 36 TCP, 14 UDP, 9 ICMP."""
    lines = ["TCP -s 198.51.100.0/27 -d 203.0.113.0/29 --sport 1024-20000 --tcp-flag S:1,F:0 --pps-th 3p --pps-th-period 2 --next"]
    for n in range(12):  # clients in blocks of 16, each with a service of its own
        service = (22, 53, 80, 443)[n % 4]
        lines.append(f"TCP -s 198.51.100.{16 * n}/28 --dport {service} --pps-th {2 + n}p --pps-th-period {1 + n % 5}")
        lines.append(f"TCP -d 203.0.113.{n}/32 --hlen >{20 + n % 3} --bps-th {1 + n}Kb --bps-th-period {2 + n % 3}")
    for n in range(8):  # windows and numbers that a sane client seldom sends
        test = f"--win >{4096 * (n % 4)}" if n % 2 else f"--ack =0 --seq >{n * 100_000_000}"
        lines.append(f"TCP -d 203.0.113.{2 * n}/31 {test} --pps-th {5 + n}p --pps-th-period 3{' --next' if n == 3 else ''}")
    lines += [f"TCP -s 198.51.100.{64 * n}/26 --bps-th {8 * (n + 1)}Kb --bps-th-period 4 --comment block{n}" for n in range(3)]
    for n in range(7):
        lines.append(f"UDP -s 198.51.100.{32 * n}/27 --sport 2000-{9000 + 4000 * n} --bps-th {1 + n}Kb --bps-th-period 2")
        lines.append(f"UDP -d 203.0.113.{n + 8}/32 --hlen <{40 + 30 * n} --pps-th {1 + n % 3}p --pps-th-period {1 + n}")
    for n in range(9):
        lines.append(f"ICMP -s 198.51.100.{28 * n}/30 --type <{9 - n % 2} --code ={n % 3} --pps-th 1p --pps-th-period {1 + n % 4}")
    return lines


def user_rule_texts(events: DataFrame) -> DataFrame:
    """A rule for every user and kind of event, dealt to three rulesets: thousands of rules on either side of the traffic, with
    and without ports, and a few that are wide on both sides."""
    user, host = F.col("user_id"), (F.col("user_id") % 256).cast("string")
    kinds = F.array(*map(F.lit, EVENT_KINDS))
    kind = F.array_position(kinds, F.col("event_type")).cast("bigint")
    number = user * len(EVENT_KINDS) + kind
    dst, shape = (user % 16).cast("string"), number % 5
    port = F.element_at(F.array(*map(F.lit, ("80", "443", "53", "22"))), (kind % 4 + 1).cast("int"))

    def line(template, *values):
        return F.format_string(template, *[value.cast("string") for value in values])

    text = (
        F.when((user < 4) & (shape == 0), line("TCP -d 0.0.0.0/0 --tcp-flag S:1 --win <%s --pps-th 3p --pps-th-period 2 --next", kind * 4096))
        .when(shape == 0, line("TCP -s 198.51.100.%s/32 --dport %s --pps-th 1p --pps-th-period 2 --next", host, port))
        .when(shape == 1, line("TCP -s 198.51.100.%s/30 -d 203.0.113.%s/31 --hlen >%s --bps-th 1Kb --bps-th-period 2", host, dst, 20 + kind))
        .when(shape == 2, line("UDP -s 198.51.100.%s/28 --hlen >%s --bps-th 1Kb --bps-th-period 1", host, user % 100))
        .when(shape == 3, line("ICMP -d 203.0.113.%s/32 --code =%s --pps-th 1p --pps-th-period 1 --next", dst, user % 3))
        .otherwise(line("UDP -d 203.0.113.%s/32 --dport %s --pps-th 1p --pps-th-period 3", dst, port))
    )
    pairs = events.select("user_id", "event_type").distinct()
    return pairs.select(F.concat(F.lit("set"), (user % 3).cast("string")).alias("ruleset_id"), number.alias("line_no"), text.alias("line"))


def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted rules of `user_rule_texts`, with books.

    The texts are stored first: the filters of the parse would be pushed below the distinct and tokenize a line for every event. They
    are dealt out evenly, as few bytes would go to one task that parses all of them.
    """
    texts = user_rule_texts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    accepted, _ = load_rules(settle(texts.repartition(2 * spark.sparkContext.defaultParallelism), "user-rule-texts"))
    return settle(with_books(accepted), "user-rules")


#: two rulesets that change with their version: thresholds go up by version modulo 3
VERSIONED_LINES = {
    "edge": [
        "TCP -d 203.0.113.0/28 --dport 80-443 --pps-th %sp --pps-th-period 3 --next",
        "TCP -d 0.0.0.0/0 --pps-th %sp --pps-th-period 4 --bps-th 16Kb --bps-th-period 6",
        "UDP -d 203.0.113.0/24 --pps-th %sp --pps-th-period 1",
    ],
    "core": [
        "TCP -s 198.51.100.0/25 --pps-th %sp --pps-th-period 2",
        "ICMP -d 203.0.113.0/24 --pps-th %sp --pps-th-period 1",
    ],
}
#: the first threshold of each line
VERSIONED_BASE = {"edge": [6, 10, 2], "core": [5, 1]}
#: seconds into a block of 2,000 packets at which a new version comes
VERSIONED_START = {"edge": 50, "core": 109}


def ruleset_versions(packets: DataFrame) -> DataFrame:
    """(ruleset_id, version, valid_from, book): a new version of each ruleset in every block of packets; the first is always there."""
    blocks = packets.groupBy(F.call_function("div", "pkt_id", F.lit(2000)).alias("version")).agg(F.min("ts").alias("start"))
    out = None
    for n, (name, start) in enumerate(VERSIONED_START.items()):
        later = F.when(F.col("version") > 0, F.col("start") + F.make_dt_interval(secs=F.lit(start)))
        part = blocks.select(
            F.lit(name).alias("ruleset_id"), F.col("version").cast("int").alias("version"), later.alias("valid_from"),
            (F.col("version") * len(VERSIONED_START) + n).cast("bigint").alias("book"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def versioned_rules(spark: SparkSession, versions: DataFrame, epoch: int = EPOCH) -> DataFrame:
    """The rules of every version, with books and the time in which they are in force; `epoch` is the Unix time of tick 0."""
    lines = [(name, n, line, VERSIONED_BASE[name][n]) for name, own in VERSIONED_LINES.items() for n, line in enumerate(own)]
    table = spark.createDataFrame(lines, "ruleset_id string, line_no long, line string, base long")
    texts = versions.select("ruleset_id", "version").join(F.broadcast(table), "ruleset_id")
    line = F.replace("line", F.lit("%s"), (F.col("base") + F.col("version") % 3).cast("string"))
    texts = texts.select(F.concat_ws("@", "ruleset_id", "version").alias("ruleset_id"), "line_no", line.alias("line"))
    accepted, _ = load_rules(texts)
    named = F.split("ruleset_id", "@")
    accepted = accepted.withColumns({"version": named[1].cast("int"), "ruleset_id": named[0]})
    return settle(with_books(accepted, versions, epoch), "versioned-rules")


def packet_columns() -> dict[str, Column]:
    """Packet columns over an `events` table; `tick` starts at 0."""
    event, uid, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    whole = F.floor("value").cast("bigint")
    proto = F.when(kind == "error", 1).when(kind == "view", 17).otherwise(6)
    tcp, udp, icmp = proto == 6, proto == 17, proto == 1
    flood = event % 2000 >= 1000
    base = F.call_function("div", event, F.lit(2000)) * 120 + F.when(flood, 100).otherwise(0)
    pace = F.when(flood, 50).otherwise(10)
    tick = base + F.call_function("div", event % 1000, pace)
    turn = event % 5
    port = F.when(turn == 0, 80).when(turn == 1, 443).when(turn == 2, 53).when(turn == 3, 22).otherwise(0)
    return {
        "pkt_id": event,
        "source_id": F.concat(F.lit("ring"), (uid % RINGS).cast("string")),
        "ts": F.timestamp_seconds(tick + EPOCH),
        "proto": proto,
        "src_ip": F.when(event % 97 == 0, 0).otherwise(3325256704 + uid % 256),
        "dst_ip": 3405803776 + uid % 16,
        "frame_len": 60 + whole,
        "sport": F.when(~icmp, 1024 + uid * 37 % 50000),
        "dport": F.when(~icmp, port),
        "seq": F.when(tcp, event * 7919 % 4294967296),
        "ack": F.when(tcp, event % 3 * 1000003),
        "win": F.when(tcp, event % 4 * 4096),
        "tcp_hlen": F.when(tcp, 20 + event % 3 * 4),
        "tcp_flags": F.when(kind == "click", 16).when(kind == "purchase", 6).when(kind == "signup", 34),
        "udp_len": F.when(udp, 8 + whole),
        "icmp_type": F.when(icmp, F.when(event % 2 == 0, 8).otherwise(0)),
        "icmp_code": F.when(icmp, event % 3),
        "tick": tick,
    }


def packets_of(events: DataFrame) -> DataFrame:
    types = {f.name: f.dataType for f in PACKETS.fields} | {"tick": "bigint"}
    return events.select([value.cast(types[name]).alias(name) for name, value in packet_columns().items()])


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def rule_texts(spark: SparkSession, lines: list[str], ruleset: str = "main") -> DataFrame:
    return spark.createDataFrame([(ruleset, n, line) for n, line in enumerate(lines)], RULE_TEXTS)


_loaded: dict = {}


def rules(spark: SparkSession, lines: list[str] = RULE_LINES) -> DataFrame:
    """The rules of some lines as a stored table, loaded once per session."""
    key = (spark.sparkContext.applicationId, tuple(lines))
    if key not in _loaded:
        accepted, _ = load_rules(rule_texts(spark, lines))
        stored = settle(accepted, "rules")
        _loaded[key] = (stored, collect_rules(stored))
    return _loaded[key][0]


def ruleset(spark: SparkSession, lines: list[str] = RULE_LINES) -> RuleSet:
    """The same rules on the driver."""
    rules(spark, lines)
    return _loaded[(spark.sparkContext.applicationId, tuple(lines))][1]


def frames_of(packets: DataFrame) -> DataFrame:
    """Pack packets into Ethernet frames, zero-padded to `frame_len`; the wire twin of the table."""

    def hexed(value, size):
        return F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")

    def zero(size):
        return F.lit("00" * size)

    proto = F.col("proto")
    flags = F.lit(0)
    # Our flag bits and their wire bits.
    for ours, wire in ((1, 0x20), (2, 0x10), (4, 0x08), (8, 0x04), (16, 0x02), (32, 0x01)):
        flags = flags + F.when(F.col("tcp_flags").bitwiseAND(F.lit(ours)) != 0, F.lit(wire)).otherwise(F.lit(0))
    ports = F.concat(hexed(F.col("sport"), 2), hexed(F.col("dport"), 2))
    tcp = F.concat(
        ports, hexed(F.col("seq"), 4), hexed(F.col("ack"), 4),
        hexed(F.shiftleft(F.call_function("div", F.col("tcp_hlen"), F.lit(4)).cast("bigint"), 4), 1),
        hexed(flags, 1), hexed(F.col("win"), 2), zero(4),
    )
    udp = F.concat(ports, hexed(F.col("udp_len"), 2), zero(2))
    icmp = F.concat(hexed(F.col("icmp_type"), 1), hexed(F.col("icmp_code"), 1), zero(2))
    l4 = F.when(proto == 6, tcp).when(proto == 17, udp).otherwise(icmp)
    head = F.concat(
        zero(12), F.lit("0800"), F.lit("45"), zero(8), hexed(proto, 1), zero(2),
        hexed(F.col("src_ip"), 4), hexed(F.col("dst_ip"), 4),
    )
    body = F.concat(head, l4)
    size = F.greatest(F.col("frame_len").cast("int") * 2, F.length(body))
    frame = F.unhex(F.rpad(body, size, "0"))
    return packets.select(
        "pkt_id", "source_id", "ts", frame.alias("frame"), F.col("frame_len").cast("int").alias("frame_len")
    )
