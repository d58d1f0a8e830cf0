"""Alarm lines, one folder per action and target."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from floodsight.schemas import _struct

PREFIX = "trigger alarm: "
_LOG = _struct(line=StringType, action_type=StringType, action_param=StringType)


def write_alarm_log(alarms: DataFrame, path: str, mode: str = "append") -> None:
    """Append ``trigger alarm: <text>`` per alarm under ``action_type=../action_param=..``.

    A line break in a text is written as ``\\n`` or ``\\r``, so an alarm stays one line.
    """
    text = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    lines = alarms.select(F.concat(F.lit(PREFIX), text).alias("line"), "action_type", "action_param")
    lines.write.partitionBy("action_type", "action_param").mode(mode).text(path)


def read_alarm_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines with their action, of all batches; an action without a target has an empty one."""
    lines = spark.read.schema(_LOG).text(path).select(_LOG.fieldNames())
    return lines.withColumn("action_param", F.coalesce("action_param", F.lit("")))
