"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query runs twice and the second run counts. `packets_per_second` is measured on a larger
table: the packets of the directory repeated $BENCH_COPIES times, each copy later in time.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from floodsight.operators.counters import dst_counts, rule_ticks, tick_profile
from floodsight.operators.match import first_match, first_match_indexed, first_match_joined
from floodsight.plans import fixtures
from floodsight.plans.catalog import QUERIES
from floodsight.schemas import FRAMES
from floodsight.session import scratch_path
from floodsight.sources.frames import frame_packets, read_frames
from floodsight.sources.packets import read_packets, with_tick

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "100"))

HEADLINES = [
    "src_frames",
    "join_rules_first",
    "agg_rule_counters",
    "agg_rule_tick",
    "agg_dst_counts",
    "agg_merge_partials",
    "agg_running_total",
    "top_dst",
    "topk_dst",
    "rate_delta",
    "trig_single",
    "trig_dual",
    "ts_mean_1m_total",
    "limit_capture",
    "rep_show_rules",
    "rep_alarms",
    "st_tick_counts",
]
# On either side of the traffic, most of them beside it.
MIXED_RULES = [f"TCP -d 203.{n // 256}.{n % 256}.0/28 --pps-th 1p" for n in range(1000)]
MIXED_RULES += [f"TCP -s 198.{n // 256}.{n % 256}.0/28 --pps-th 1p" for n in range(1000)]


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def repeated_packets(spark):
    """The packets of the directory, COPIES times in a row on the time axis."""
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    size = events.count()
    copies = events.repartition(64).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    copies = copies.withColumn("event_id", F.col("event_id") + F.col("copy") * size)
    path = scratch_path(spark, "bench")
    fixtures.packets_of(copies).drop("tick").write.parquet(path)
    return read_packets(spark, path), size * COPIES


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("floodsight-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        timed(lambda: QUERIES[name](spark, SF_DIR))
        times[name] = round(timed(lambda: QUERIES[name](spark, SF_DIR)), 3)

    packets, count = repeated_packets(spark)
    speeds = {}
    for lines, label in ((fixtures.RULE_LINES, "8_rules"), (fixtures.wide_rule_lines(), "59_rules")):
        ruleset, table = fixtures.ruleset(spark, lines), fixtures.rules(spark, lines)
        jobs = {
            f"rule_ticks_{label}": lambda: rule_ticks(first_match(packets, ruleset)),
            f"tick_profile_{label}": lambda: tick_profile(dst_counts(first_match(packets, ruleset))),
            f"rule_ticks_indexed_{label}": lambda: rule_ticks(first_match_indexed(packets, table)),
        }
        for name, job in jobs.items():
            speeds[name] = round(count / min(timed(job), timed(job)))
    mixed = fixtures.rules(spark, MIXED_RULES)
    for way in (first_match_indexed, first_match_joined):
        job = lambda way=way: rule_ticks(way(packets, mixed))
        speeds[f"rule_ticks_{way.__name__.removeprefix('first_match_')}_2000_rules"] = round(count / min(timed(job), timed(job)))
    some = packets.filter(F.col("pkt_id") < count // 10)
    path = scratch_path(spark, "bench-frames")
    fixtures.frames_of(some).select(FRAMES.fieldNames()).write.parquet(path)
    ruleset = fixtures.ruleset(spark)
    job = lambda: rule_ticks(first_match(with_tick(frame_packets(read_frames(spark, path))), ruleset))
    speeds["frames_to_ticks_8_rules"] = round(count // 10 / min(timed(job), timed(job)))
    result = {
        "metric": "sum of headline query times",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
        "packets_measured": count,
        "packets_per_second": speeds,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
