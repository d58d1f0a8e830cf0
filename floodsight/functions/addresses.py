"""IPv4 address and port text to numbers and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# One octet, decimal without leading zeros.
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_CIDR = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}(?:/(3[0-2]|[12]?[0-9]))?$"
_PORTS = r"^0*([0-9]{1,5})(?:-0*([0-9]{1,5}))?$"

ALL_ADDRESSES = 4294967295
MAX_PORT = 65535


def ip_text(ip: Column) -> Column:
    """LONG address to dotted text."""
    parts = [F.shiftright(ip, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)


def ip_range_text(lo: Column, hi: Column) -> Column:
    return F.concat(ip_text(lo), F.lit("-"), ip_text(hi))


def num_range_text(lo: Column, hi: Column) -> Column:
    return F.concat(lo.cast("string"), F.lit("-"), hi.cast("string"))


def cidr_range(text: Column) -> Column:
    """``a.b.c.d[/n]`` to struct(lo, hi); NULL when the text is wrong.

    Usual CIDR meaning for every mask from 0 to 32. A range that holds only address 0 can
    never match a packet, so it is wrong too.
    """
    octets = [F.regexp_extract(text, _CIDR, i).try_cast("bigint") for i in (1, 2, 3, 4)]
    ip = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    mask_text = F.regexp_extract(text, _CIDR, 5)
    bits = F.when(mask_text == "", F.lit(32)).otherwise(mask_text.try_cast("int"))
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), 32 - bits)
    lo = ip - F.pmod(ip, size)
    hi = lo + size - 1
    good = text.rlike(_CIDR) & (hi > 0)
    return F.when(good, F.struct(lo.alias("lo"), hi.alias("hi")))


def port_range(text: Column) -> Column:
    """``n`` or ``a-b`` to struct(lo, hi); NULL when the text is wrong, too large or only port 0.

    A reversed range is kept: it matches nothing.
    """
    lo = F.regexp_extract(text, _PORTS, 1).try_cast("int")
    hi_text = F.regexp_extract(text, _PORTS, 2)
    hi = F.when(hi_text == "", lo).otherwise(hi_text.try_cast("int"))
    good = text.rlike(_PORTS) & (lo <= MAX_PORT) & (hi <= MAX_PORT) & ((lo > 0) | (hi > 0))
    return F.when(good, F.struct(lo.alias("lo"), hi.alias("hi")))
