"""Table schemas. IPv4 addresses and 32-bit header fields are LONG: Spark has no unsigned INT."""

from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields):
    return StructType([StructField(name, kind(), True) for name, kind in fields.items()])


# The protocol numbers, and the order in which the lists are shown.
PROTO = {"tcp": 6, "udp": 17, "icmp": 1}
TYPE_ORDER = ["tcp", "udp", "icmp"]

FRAMES = _struct(frame=BinaryType, frame_len=IntegerType, ts=TimestampType, source_id=StringType)

PACKETS = _struct(
    pkt_id=LongType,
    source_id=StringType,
    ts=TimestampType,
    proto=IntegerType,
    src_ip=LongType,
    dst_ip=LongType,
    frame_len=LongType,
    sport=IntegerType,
    dport=IntegerType,
    seq=LongType,
    ack=LongType,
    win=IntegerType,
    tcp_hlen=IntegerType,
    tcp_flags=IntegerType,
    udp_len=IntegerType,
    icmp_type=IntegerType,
    icmp_code=IntegerType,
)

RULE_TEXTS = _struct(ruleset_id=StringType, line_no=LongType, line=StringType)

# A disabled test is NULL in its columns.
RULE_TESTS = _struct(
    src_lo=LongType,
    src_hi=LongType,
    dst_lo=LongType,
    dst_hi=LongType,
    sport_lo=IntegerType,
    sport_hi=IntegerType,
    dport_lo=IntegerType,
    dport_hi=IntegerType,
    seq_op=StringType,
    seq_num=LongType,
    ack_op=StringType,
    ack_num=LongType,
    win_op=StringType,
    win_num=LongType,
    hlen_op=StringType,
    hlen_num=LongType,
    flag_bits=IntegerType,
    flag_mask=IntegerType,
    type_op=StringType,
    type_num=LongType,
    code_op=StringType,
    code_num=LongType,
)

RULE_LIMITS = _struct(
    pps_th=LongType,
    bps_th=LongType,
    pps_period=LongType,
    bps_period=LongType,
    next_rule=BooleanType,
)

RULES = StructType(
    _struct(ruleset_id=StringType, rule_type=StringType, rule_no=IntegerType, text_rule=StringType).fields
    + RULE_TESTS.fields
    + RULE_LIMITS.fields
    + _struct(action_type=StringType, action_param=StringType, comment=StringType).fields
)

RULE_REJECTS = _struct(ruleset_id=StringType, line_no=LongType, line=StringType, reason=StringType)

METRICS = _struct(
    time=TimestampType,
    measurement=StringType,
    rule=IntegerType,
    type=StringType,
    pps=LongType,
    bps=LongType,
)
