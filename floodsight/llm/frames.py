"""What the text operators share on the Spark side."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.llm.text import batches

BROADCAST_ROWS = 1_000_000
ARROW_BYTES = 4 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
_ARROW_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_arrow_batches(spark) -> None:
    """Have Spark send Python at most ARROW_BYTES (or one row) at once: ten thousand texts, the usual batch, can be any size."""
    now = spark.conf.get(_ARROW_SETTING, None) or ""
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        spark.conf.set(_ARROW_SETTING, str(ARROW_BYTES))


def give_back() -> None:
    """Return freed memory to the system: Spark keeps its Python workers, each of a size of its own otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, rows: int = 4096) -> DataFrame:
    """`work` on slices of about a MB of text and `rows` rows at most; the memory they took is given back after each Arrow batch."""
    small_arrow_batches(df.sparkSession)

    def run(parts):
        for part in parts:
            for piece in batches(part, rows=rows):
                yield from work(piece)
            give_back()

    return df.mapInArrow(run, schema)


def broadcast_checked(stored: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a stored table of a few narrow columns has at most `rows` rows; beyond that Spark joins by a shuffle."""
    return F.broadcast(stored) if stored.count() <= rows else stored
