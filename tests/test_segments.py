import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from floodsight.operators.segments import island_start, previous_row, running_sum


def series(spark, seed):
    rng = random.Random(seed)
    rows = [(key, tick, rng.randrange(10)) for key in range(3) for tick in range(200) if rng.random() < 0.6 + key * 0.19]
    return spark.createDataFrame(rows, "key int, tick long, n long")


def as_set(df):
    return sorted(map(tuple, df.collect()))


def test_running_sum(spark):
    df = series(spark, 1)
    plain = F.sum("n").over(Window.partitionBy("key").orderBy("tick"))
    for width in (1, 7, 64, 1000):
        got = running_sum(df, ["key"], "tick", {"total": "n"}, width)
        assert as_set(got) == as_set(df.withColumn("total", plain))


def test_previous_row(spark):
    df = series(spark, 2)
    order = Window.partitionBy("key").orderBy("tick")
    expected = df.withColumns({"t": F.lag("tick").over(order), "m": F.lag("n").over(order)})
    for width in (1, 7, 64, 1000):
        got = previous_row(df, ["key"], "tick", {"t": "tick", "m": "n"}, width)
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_island_start(spark):
    df = series(spark, 3)
    rank = F.col("tick") - F.row_number().over(Window.partitionBy("key").orderBy("tick"))
    expected = df.withColumn("g", rank)
    expected = expected.withColumn("island_start", F.min("tick").over(Window.partitionBy("key", "g"))).drop("g")
    for width in (1, 7, 64, 1000):
        assert as_set(island_start(df, ["key"], "tick", width)) == as_set(expected)
