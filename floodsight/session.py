"""Where a job stores its intermediate tables, and size-checked broadcasts."""

import io
import os
import sysconfig
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; gone when the session ends.

    Only a local session without that setting gets a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="floodsight-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/floodsight-{name}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, where it is neither installed nor on their path: it is zipped into the shared
    folder and added to the session once."""
    root = Path(__file__).resolve().parent.parent
    paths = {Path(p or ".").resolve() for p in (*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd(), sysconfig.get_path("purelib"))}
    if root in paths or spark.sparkContext.applicationId in _shipped:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.glob("floodsight/**/*.py")):
            archive.write(file, file.relative_to(root))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'code')}/floodsight.zip")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path.toString())
    _shipped.add(spark.sparkContext.applicationId)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Store `df` as a table and read it back: it is worked out once, and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(stored: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored table for broadcast if it has at most `rows` rows and `size` bytes; else leave the join to Spark,
    whose adaptive joins split skewed keys. Both are measured in a job over the (small, stored) table."""
    found = stored.agg(F.count("*"), F.coalesce(F.sum(row_bytes(stored)), F.lit(0))).first()
    return F.broadcast(stored) if found[0] <= rows and found[1] <= size else stored


def row_bytes(df: DataFrame) -> Column:
    """What a row takes in Spark's row format: eight bytes a column, and the bytes of texts and lists."""
    size = F.lit(8 * (1 + len(df.columns))).cast("bigint")
    for field in df.schema.fields:
        if isinstance(field.dataType, StringType | BinaryType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, ArrayType | StructType):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    return size
