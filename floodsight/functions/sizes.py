"""Short sizes such as ``100Mb`` or ``1.12Mp/s``, and numeric comparisons such as ``>100``."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Steps of 1000, in this order.
PREFIXES = ["", "K", "M", "G", "T", "P"]
MAX_LONG = 2**63 - 1

_COMPARE = r"^([=<>])0*([0-9]{1,10})$"


def size_parse(text: Column, bits: bool) -> Column:
    """``10Kp`` to packets, or ``100Mb`` (bits) to whole bytes. NULL when wrong or above LONG."""
    pattern = rf"^0*([0-9]{{1,18}})([KMGTP]?){'b' if bits else 'p'}$"
    number = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    prefix = F.regexp_extract(text, pattern, 2)
    size = F.when(prefix == "", number)
    for step, name in enumerate(PREFIXES[1:], start=1):
        fits = number <= MAX_LONG // 1000**step
        size = size.when((prefix == name) & fits, number * 1000**step)
    size = F.call_function("div", size, F.lit(8)) if bits else size
    return F.when(text.rlike(pattern), size)


def size_text(number: Column, bits: bool) -> Column:
    """Number to ``7.71Gb/s`` or ``1.12Mp/s``; bytes are shown in bits.

    Two decimals of quotient plus last remainder over 1000, in single precision, ties to even.
    """
    size = number.cast("bigint") * (8 if bits else 1)
    last = len(PREFIXES) - 1
    text = F.when(size >= 1000**last, _scaled(size, last, bits))
    for step in reversed(range(1, last)):
        text = text.when(size >= 1000**step, _scaled(size, step, bits))
    return text.otherwise(_scaled(size, 0, bits))


def _scaled(size: Column, step: int, bits: bool) -> Column:
    quotient = F.call_function("div", size, F.lit(1000**step))
    shown = quotient.cast("float")
    if step:
        remainder = F.call_function("div", size, F.lit(1000 ** (step - 1))) % 1000
        shown = shown + (remainder.cast("float") / F.lit(1000)).cast("float")
    rounded = F.bround(shown.cast("double").cast("decimal(38,17)"), 2).cast("decimal(38,2)")
    return F.concat(rounded.cast("string"), F.lit(PREFIXES[step] + ("b/s" if bits else "p/s")))


def compare_parse(text: Column, most: int) -> Column:
    """``=n``, ``>n`` or ``<n`` to struct(op, num); NULL when wrong or above `most`."""
    num = F.regexp_extract(text, _COMPARE, 2).try_cast("bigint")
    good = text.rlike(_COMPARE) & (num <= most)
    return F.when(good, F.struct(F.regexp_extract(text, _COMPARE, 1).alias("op"), num.alias("num")))
