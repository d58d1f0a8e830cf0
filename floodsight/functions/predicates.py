"""Packet tests of a rule, as Columns. A disabled test (NULL parameter) passes every packet."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from floodsight.schemas import PROTO

# Tests of each list in the order they are made: kind, packet column, rule column prefix.
_ADDRESSES = [("range", "src_ip", "src"), ("range", "dst_ip", "dst")]
_PORTS = [("range", "sport", "sport"), ("range", "dport", "dport")]
TESTS = {
    "tcp": _ADDRESSES
    + _PORTS
    + [
        ("compare", "seq", "seq"),
        ("compare", "ack", "ack"),
        ("compare", "win", "win"),
        ("compare", "tcp_hlen", "hlen"),
        ("flags", "tcp_flags", "flag"),
    ],
    "udp": _ADDRESSES + _PORTS + [("compare", "udp_len", "hlen")],
    "icmp": _ADDRESSES + [("compare", "icmp_type", "type"), ("compare", "icmp_code", "code")],
}


# Ending of the column that says whether a test is on.
FIRST_COLUMN = {"range": "_lo", "compare": "_op", "flags": "_mask"}


def in_range(value: Column, lo: Column, hi: Column) -> Column:
    """Closed range. Zero is never inside an enabled range."""
    return lo.isNull() | ((value != 0) & value.between(lo, hi))


def compare(value: Column, op: Column, num: Column) -> Column:
    return (
        op.isNull()
        | ((op == "=") & (value == num))
        | ((op == ">") & (value > num))
        | ((op == "<") & (value < num))
    )


def flags_match(value: Column, bits: Column, mask: Column) -> Column:
    return mask.isNull() | (value.bitwiseAND(mask) == bits)


def rule_columns_match(rule_type: str, packet, rule, used: set[str] | None = None) -> Column:
    """All tests of one list, with the rule given as columns.

    `packet` and `rule` map a column name to a Column, e.g. ``lambda name: df[name]``. With `used` only the tests
    whose first column it names are made.
    """
    result = packet("proto") == PROTO[rule_type]
    for kind, field, prefix in TESTS[rule_type]:
        if used is not None and f"{prefix}{FIRST_COLUMN[kind]}" not in used:
            continue
        value = packet(field)
        if kind == "range":
            result &= in_range(value, rule(f"{prefix}_lo"), rule(f"{prefix}_hi"))
        elif kind == "compare":
            result &= compare(value, rule(f"{prefix}_op"), rule(f"{prefix}_num"))
        else:
            result &= flags_match(value, rule("flag_bits"), rule("flag_mask"))
    return result


# A packet's value that passes disabled tests only.
_NOTHING = -(2**63)
_MOST = 2**63 - 1
_BEFORE = {(prefix, kind): FIRST_COLUMN[kind] for tests in TESTS.values() for kind, _, prefix in tests}


def range_tests(used: set[str]) -> list[str]:
    """The names of the tests that `used` asks for by their first column and that can be put as a range of numbers."""
    return [prefix for (prefix, kind), ending in _BEFORE.items() if kind != "flags" and f"{prefix}{ending}" in used]


def _bounds(lo: Column, hi: Column, on: Column) -> tuple[Column, Column]:
    """A range for a test that is `on`: a bound that isn't known lets nothing through. Every value passes one that is off."""
    lo, hi = lo.cast("bigint"), hi.cast("bigint")
    lo = F.when(lo == _NOTHING, F.lit(_NOTHING + 1)).otherwise(lo)
    known = lo.isNotNull() & hi.isNotNull()
    return F.when(~on, F.lit(_NOTHING)).when(known, lo).otherwise(F.lit(_MOST)), F.when(~on, F.lit(_MOST)).when(known, hi).otherwise(F.lit(_NOTHING))


def rule_range(name: str) -> tuple[Column, Column]:
    """The test `name` of a rule as the least and the largest value of `packet_value` that pass it."""
    lists = [rule_type for rule_type, tests in TESTS.items() if any(prefix == name for _, _, prefix in tests)]
    here = F.col("rule_type").isin(lists)
    if (name, "range") in _BEFORE:
        return _bounds(F.col(f"{name}_lo"), F.col(f"{name}_hi"), here & F.col(f"{name}_lo").isNotNull())
    op, num = F.col(f"{name}_op"), F.col(f"{name}_num").cast("bigint")
    lo = F.when(op == "=", num).when(op == ">", F.try_add(num, F.lit(1).cast("bigint"))).when((op == "<") & num.isNotNull(), F.lit(_NOTHING + 1))
    hi = F.when(op == "=", num).when((op == ">") & num.isNotNull(), F.lit(_MOST)).when(op == "<", F.try_subtract(num, F.lit(1).cast("bigint")))
    return _bounds(lo, hi, here & op.isNotNull())


def packet_value(name: str) -> Column:
    """What a rule's range `name` is compared with. Zero is never inside an enabled range of addresses or ports."""
    fields = {rule_type: field for rule_type, tests in TESTS.items() for _, field, prefix in tests if prefix == name}
    value = F.lit(None).cast("bigint")
    for rule_type, field in fields.items():
        value = F.when(F.col("proto") == PROTO[rule_type], F.col(field).cast("bigint")).otherwise(value)
    if (name, "range") in _BEFORE:
        value = F.nullif(value, F.lit(0).cast("bigint"))
    return F.coalesce(value, F.lit(_NOTHING))


def time_range(from_us: Column, to_us: Column) -> tuple[Column, Column]:
    """The time of a book as a range of `time_value`; a missing end is open."""
    hi = F.when(to_us.isNull(), F.lit(_MOST)).otherwise(F.try_subtract(to_us, F.lit(1).cast("bigint")))
    return _bounds(F.coalesce(from_us, F.lit(_NOTHING + 1)), hi, from_us.isNotNull() | to_us.isNotNull())


def time_value(ts: Column) -> Column:
    return F.coalesce(F.unix_micros(ts), F.lit(_NOTHING))


def _literal_test(kind: str, value: Column, prefix: str, rule) -> Column | None:
    if kind == "range":
        lo, hi = rule[f"{prefix}_lo"], rule[f"{prefix}_hi"]
        if lo is None:
            return None
        # Zero never matches, so a range from zero starts at one.
        lo = max(lo, 1)
        return value == lo if lo == hi else (value >= lo) & (value <= hi)
    if kind == "compare":
        op, num = rule[f"{prefix}_op"], rule[f"{prefix}_num"]
        if op is None:
            return None
        return {"=": value == num, ">": value > num, "<": value < num}[op]
    if rule["flag_mask"] is None:
        return None
    return value.bitwiseAND(F.lit(rule["flag_mask"])) == rule["flag_bits"]


def compiled_match(rule, packet=F.col) -> Column:
    """The tests of one rule row with its parameters as constants and disabled tests left out.

    The protocol is not tested here: the caller branches on it once for the whole list.
    """
    result = None
    for kind, field, prefix in TESTS[rule["rule_type"]]:
        test = _literal_test(kind, packet(field), prefix, rule)
        if test is not None:
            result = test if result is None else result & test
    return F.lit(True) if result is None else result
