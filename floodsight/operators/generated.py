"""Keeping generated code small enough for the JVM to compile."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def own_method(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns in a projection that ends in a one-row generator.

    Whole-stage code puts what follows a generator into a method of its own, and filters are not
    pushed below it, which would copy the expressions. Without that, long rule lists and frame
    decoding become single methods above the size that the JVM compiles (8,000 bytes), and run
    several times slower.
    """
    if len(columns) == 1:
        return df.withColumns({name: F.explode(F.array(value)) for name, value in columns.items()})
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    df = df.withColumn("_packed", F.explode(F.array(packed)))
    return df.withColumns({name: F.col(f"_packed.{name}") for name in columns}).drop("_packed")
