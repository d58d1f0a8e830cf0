"""Windows over a long ordered axis, worked out in two levels.

A plain ``Window.partitionBy(rule).orderBy(tick)`` puts all ticks of a rule into one task. Here
the axis is cut into segments of `width`: rows are only windowed within (keys, segment), one
summary row per segment is windowed within the keys, and its carry is joined back. Results are
those of the plain window. Each function reads its input twice, so give it a stored table when
the input is costly.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_WIDTH = 512
_SEG = "_segment"


def segment_of(order: str, width: int):
    """First position of the segment that holds the row."""
    return F.col(order) - F.pmod(F.col(order), F.lit(width))


def _levels(df: DataFrame, keys: list[str], order: str, width: int):
    within = Window.partitionBy(*keys, _SEG).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(_SEG)
    return df.withColumn(_SEG, segment_of(order, width)), within, across


def running_sum(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, str], width: int = SEGMENT_WIDTH
) -> DataFrame:
    """Add running totals: `sums` maps a new column to the column it adds up. `order` is unique per key."""
    rows, within, across = _levels(df, keys, order, width)
    totals = rows.groupBy(*keys, _SEG).agg(*[F.sum(col).alias(new) for new, col in sums.items()])
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, _SEG, *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"_c_{new}") for new in sums]
    )
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    added = {new: F.sum(col).over(upto) + F.col(f"_c_{new}") for new, col in sums.items()}
    joined = rows.join(carry, [*keys, _SEG])
    return joined.withColumns(added).select(*df.columns, *sums)


def previous_row(
    df: DataFrame, keys: list[str], order: str, columns: dict[str, str], width: int = SEGMENT_WIDTH
) -> DataFrame:
    """Add values of the row before: `columns` maps a new column to the column it looks up."""
    rows, within, across = _levels(df, keys, order, width)
    picked = F.struct(*[F.col(col).alias(new) for new, col in columns.items()])
    lasts = rows.groupBy(*keys, _SEG).agg(F.max_by(picked, F.col(order)).alias("_last"))
    carry = lasts.select(*keys, _SEG, F.lag("_last").over(across).alias("_carry"))
    joined = rows.join(carry, [*keys, _SEG])
    joined = joined.withColumn("_prev", F.coalesce(F.lag(picked).over(within), F.col("_carry")))
    return joined.select(*df.columns, *[F.col(f"_prev.{new}").alias(new) for new in columns])


def island_start(df: DataFrame, keys: list[str], order: str, width: int = SEGMENT_WIDTH) -> DataFrame:
    """Add `island_start`: the first position of the run of consecutive positions the row is in."""
    rows, within, across = _levels(df, keys, order, width)
    before = F.lag(order).over(within)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_head", F.when(before.isNull() | (before != F.col(order) - 1), F.col(order)))
    rows = rows.withColumn("_start", F.max("_head").over(upto)).drop("_head")
    edges = rows.groupBy(*keys, _SEG).agg(
        F.min(order).alias("_first"), F.max(order).alias("_end"), F.max("_start").alias("_start_of_end")
    )
    edges = edges.withColumn("_prev_end", F.lag("_end").over(across))
    # The first run of a segment goes on from an earlier one when the tick before it is there.
    edges = edges.withColumn("_joined", F.coalesce(F.col("_prev_end") == F.col("_first") - 1, F.lit(False)))
    true_start = F.when((F.col("_start_of_end") != F.col("_first")) | ~F.col("_joined"), F.col("_start_of_end"))
    carried = F.last(true_start, ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carry = edges.select(*keys, _SEG, "_first", "_joined", carried.alias("_carried"))
    joined = rows.join(carry, [*keys, _SEG])
    goes_on = (F.col("_start") == F.col("_first")) & F.col("_joined")
    joined = joined.withColumn("island_start", F.when(goes_on, F.col("_carried")).otherwise(F.col("_start")))
    return joined.select(*df.columns, "island_start")
