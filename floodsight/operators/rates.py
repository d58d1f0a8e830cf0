"""Rates from counter samples, and the rates of ticks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.operators.segments import previous_row

SAMPLE_SEGMENT_MS = 512_000


def rate_delta(samples: DataFrame, start_ms: int = 0, width: int = SAMPLE_SEGMENT_MS) -> DataFrame:
    """Per-second rates between successive samples (rule_id, sample_ms, packets, bytes).

    Counters are 0 at `start_ms`. Halves round away from zero. A counter that went down was
    reset: its rate is NULL.
    """
    looked_up = {"_ms": "sample_ms", "_packets": "packets", "_bytes": "bytes"}
    df = previous_row(samples, ["rule_id"], "sample_ms", looked_up, width)
    zero = F.lit(0).cast("bigint")
    elapsed = F.col("sample_ms") - F.coalesce(F.col("_ms"), F.lit(start_ms).cast("bigint"))

    def rate(counter):
        delta = F.col(counter) - F.coalesce(F.col(f"_{counter}"), zero)
        per_second = F.round(delta / elapsed.cast("double") * 1000).cast("bigint")
        return F.when((delta >= 0) & (elapsed > 0), per_second)

    return df.select(*samples.columns, rate("packets").alias("pps"), rate("bytes").alias("bps"))


def tick_rates(ticks: DataFrame) -> DataFrame:
    """A tick lasts one second, so its counts are its rates (bytes per second in `bps`)."""
    return ticks.withColumnRenamed("packets", "pps").withColumnRenamed("bytes", "bps")
