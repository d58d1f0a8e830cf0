"""Time-series points as line-protocol text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _nanoseconds(time: str) -> Column:
    return F.concat(F.unix_seconds(time).cast("string"), F.lit("000000000"))


def _field_text(text: Column) -> Column:
    """Quoted string field; backslashes and quotes are escaped."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def metric_lines(points: DataFrame) -> DataFrame:
    """``tcp,rule=0 pps=N,bps=BITS NS`` per rule, ``total,type=tcp pps=N,bps=BITS NS`` per list."""
    total = F.col("measurement") == "total"
    tag = F.when(total, F.concat(F.lit("type="), F.col("type"))).otherwise(
        F.concat(F.lit("rule="), F.col("rule").cast("string"))
    )
    line = F.concat(
        F.col("measurement"), F.lit(","), tag,
        F.lit(" pps="), F.col("pps").cast("string"),
        F.lit(",bps="), F.col("bps").cast("string"),
        F.lit(" "), _nanoseconds("time"),
    )
    return points.select(line.alias("line"))


def event_lines(events: DataFrame) -> DataFrame:
    """``events,dst=IP bps=BITS,pps=N,type="tcp",comment="..." NS`` per alarm."""
    line = F.concat(
        F.lit("events,dst="), F.col("dst"),
        F.lit(" bps="), F.col("bps").cast("string"),
        F.lit(",pps="), F.col("pps").cast("string"),
        F.lit(",type="), _field_text(F.col("type")),
        F.lit(",comment="), _field_text(F.col("comment")),
        F.lit(" "), _nanoseconds("time"),
    )
    return events.select(line.alias("line"))


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    lines.select("line").write.mode(mode).text(path)
