"""Sharding by fixed virtual slots.

A record is hashed into one of thousands of slots, once and for all. Bytes are summed by slot, and a small versioned table
says which shard holds which slot. Rebalancing or adding a shard writes a new version of that table, in which some slots
have moved; no record is hashed anew, and only records of the moved slots change their shard.

All of it is DataFrame operations on integers. What is worked on slot by slot is the table of slots, whose size is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodsight.llm.crc_sql import CRC_SQL, crc32_sql
from floodsight.llm.frames import documents
from floodsight.session import settle

SHARDS, SLOTS = 8, 4096
#: a slot's records are counted and numbered in so many parts
PARTS = 16
COPIES = 10_000


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def place_of(doc_id: Column, size: Column, crc: Column) -> Column:
    """Slot and part of a record as one number, from all three, so rows that share a doc_id alone, or a text alone, lie apart."""
    name = F.concat_ws("-", F.coalesce(doc_id.cast("string"), F.lit("")), size, crc)
    return F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("long") % (SLOTS * PARTS)


def _measured(text: Column) -> dict[str, Column]:
    return {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, part) for each row of `docs`: size is the UTF-8 bytes of the text and one more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(name) for name, c in _measured(_text()).items()])
    rows = rows.withColumn("place", place_of(F.col("doc_id"), F.col("size"), F.col("text_crc32")))
    return rows.select("doc_id", "size", "text_crc32", F.expr(f"place div {PARTS}").cast("int").alias("virtual_slot"), F.expr(f"place % {PARTS}").cast("int").alias("part"))


def slot_loads(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes) of every slot, empty ones too."""
    all_slots = rows.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("virtual_slot"))
    loads = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    return all_slots.join(F.broadcast(loads), "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def first_map(loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(version, virtual_slot, shard, bytes): version 1 deals the slots in turn, whatever they hold."""
    return loads.select(F.lit(1).alias("version"), "virtual_slot", F.pmod("virtual_slot", F.lit(shards)).cast("int").alias("shard"), "bytes")


def newest(slot_map: DataFrame) -> DataFrame:
    """The rows of the map's last version."""
    last = Window.partitionBy("virtual_slot").orderBy(F.desc("version"))
    return slot_map.withColumn("_turn", F.row_number().over(last)).where("_turn = 1").drop("_turn")


def _released(current: DataFrame, target: Column) -> DataFrame:
    """`current` with `moves`: a shard keeps its largest slot, and further ones as long as they fit into its share, and releases the
    rest."""
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    held = F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return current.withColumns({"moves": held > target, "_turn": F.row_number().over(order)}).withColumn("moves", F.expr("moves AND _turn > 1")).drop("_turn")


def rebalanced(slot_map: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The map with one more version, in which shards over their equal share have given slots to the others.

    Released slots go, the largest first, to the shard that holds least. That is a fold over the table of slots, one row of
    fixed size.
    """
    current = newest(slot_map)
    total = Window.partitionBy(F.lit(0))
    share = F.ceil(F.sum("bytes").over(total) / shards)
    parted = _released(current.withColumn("share", share), F.col("share"))
    kept = F.array(*[F.coalesce(F.sum(F.when(~F.col("moves") & (F.col("shard") == s), F.col("bytes"))), F.lit(0)).cast("long") for s in range(shards)])
    pool = F.array_sort(F.collect_list(F.when(F.col("moves"), F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))))
    none = F.array().cast("array<struct<virtual_slot:int,shard:int>>")

    def deal(done: Column, slot: Column) -> Column:
        to = F.array_position(done["loads"], F.array_min(done["loads"])).cast("int") - 1
        loads = F.transform(done["loads"], lambda load, s: F.when(s == to, load - slot["less"]).otherwise(load))
        moved = F.concat(done["moved"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard"))))
        return F.struct(loads.alias("loads"), moved.alias("moved"))

    dealt = parted.agg(kept.alias("kept"), pool.alias("pool")).select(
        F.explode(F.aggregate("pool", F.struct(F.col("kept").alias("loads"), none.alias("moved")), deal)["moved"]).alias("m")
    )
    moved = dealt.select(F.col("m.virtual_slot").alias("virtual_slot"), F.col("m.shard").alias("to"))
    after = current.join(F.broadcast(moved), "virtual_slot", "left")
    after = after.select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").alias("shard"), "bytes")
    return slot_map.union(after)


def grown(slot_map: DataFrame, shards: int) -> DataFrame:
    """The map with one more version, in which shard number `shards` is new and has slots of those over their new share."""
    current = newest(slot_map)
    share = F.ceil(F.sum("bytes").over(Window.partitionBy(F.lit(0))) / (shards + 1))
    after = _released(current.withColumn("share", share), F.col("share"))
    shard = F.when(F.col("moves"), F.lit(shards)).otherwise(F.col("shard")).cast("int")
    return slot_map.union(after.select((F.col("version") + 1).alias("version"), "virtual_slot", shard.alias("shard"), "bytes"))


def sharded(docs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, virtual_slot, version): `slot` numbers the records of a shard from 0 without gaps.

    The order is virtual slot, part, doc_id (null first), size, crc32. Rows equal in all of these are counted, placed as
    one and dealt out again, so that neither many copies nor a large shard is ordered in one task.
    """
    return _numbered(settle(records(docs), "records"), slot_map)


def _numbered(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    current = newest(slot_map).select("virtual_slot", "shard", "version")
    rows = rows.join(F.broadcast(current), "virtual_slot")
    where = ["shard", "virtual_slot", "part"]
    same = rows.groupBy(*where, "version", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    within = Window.partitionBy(*where).orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    same = same.withColumn("after", F.sum("copies").over(within))
    parts = rows.groupBy(*where).agg(F.count("*").alias("n"))
    parts = parts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part")) - F.col("n"))
    same = same.join(F.broadcast(parts.drop("n")), where).withColumn("first", F.expr("start + after - copies"))
    runs = F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))
    run = same.withColumn("run", F.explode(runs)).withColumns({"first": F.expr(f"first + run * {COPIES}"), "many": F.expr(f"least({COPIES}L, copies - run * {COPIES})")})
    return run.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence("first", F.expr("first + many - 1"))).alias("slot"), "virtual_slot", "version")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The documents' places, as of `sharded`, and the map they were dealt by: dealt in turn, then rebalanced by bytes.

    `docs(doc_id, text, ...)`; other columns are ignored. Null text: no bytes. A null doc_id is hashed with size and text
    like any other. Rows alike in doc_id and text have one slot, and so one shard. A text is one record, so the shards'
    sizes differ by no more than the largest slot. An empty table gives an empty result and the whole map.
    """
    rows = settle(records(docs), "records")
    slot_map = settle(rebalanced(settle(first_map(slot_loads(rows), shards), "slot-map"), shards), "slot-map")
    return _numbered(rows, slot_map), slot_map


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str) -> None:
    """The documents, with all their columns, in a folder `shard=<n>` for each shard; where `docs` has a column of that name, it is `shard_`."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    size, crc = _measured(_text("doc.text")).values()
    rows = docs.select(F.struct("*").alias("doc")).withColumn("place", place_of(F.col("doc.doc_id").cast("long"), size, crc))
    held = newest(slot_map).select(F.col("virtual_slot").alias("held"), F.col("shard").alias("to"))
    rows = rows.join(F.broadcast(held), F.expr(f"place div {PARTS}") == F.col("held"))
    rows.select("doc.*", F.col("to").alias(name)).write.partitionBy(name).parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")


OP12_SQL = f"""WITH RECURSIVE {CRC_SQL},
  texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  measured AS (SELECT doc_id, octet_length(encode(text)) + 1 AS size, {crc32_sql("text")} AS text_crc32 FROM texts, crc),
  records AS (SELECT *, ('0x' || left(md5(concat_ws('-', coalesce(doc_id::VARCHAR, ''), size, text_crc32)), 7))::BIGINT % {SLOTS * PARTS} AS place FROM measured),
  loads AS (SELECT s::INT AS virtual_slot, coalesce(sum(size), 0)::BIGINT AS bytes, (s % {SHARDS})::INT AS shard FROM range({SLOTS}) r(s) LEFT JOIN records ON place // {PARTS} = s GROUP BY s),
  parted AS (SELECT *, sum(bytes) OVER by_size > (SELECT ceil(sum(bytes) / {SHARDS}) FROM loads) AND row_number() OVER by_size > 1 AS moves FROM loads
    WINDOW by_size AS (PARTITION BY shard ORDER BY bytes DESC, virtual_slot ROWS UNBOUNDED PRECEDING)),
  pool AS (SELECT row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS step, virtual_slot, bytes FROM parted WHERE moves),
  kept AS (SELECT list(bytes ORDER BY shard) AS loads FROM (SELECT shard, coalesce(sum(bytes) FILTER (NOT moves), 0)::BIGINT AS bytes FROM parted GROUP BY shard)),
  deal AS (SELECT 0::BIGINT AS step, loads, -1 AS virtual_slot, -1::BIGINT AS shard FROM kept
    UNION ALL SELECT p.step, list_transform(d.loads, lambda l, i: CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN l + p.bytes ELSE l END), p.virtual_slot, list_position(d.loads, list_min(d.loads)) - 1
      FROM deal d JOIN pool p ON p.step = d.step + 1),
  held AS (SELECT l.virtual_slot, coalesce(d.shard, l.shard)::INT AS shard FROM loads l LEFT JOIN deal d USING (virtual_slot))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  NULL::INT AS grown_shard, virtual_slot, 2 AS version
FROM records JOIN held ON virtual_slot = place // {PARTS}"""
