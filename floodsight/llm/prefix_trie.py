"""Prefix trie of rebuilt conversations by whole-sequence collapse.

A conversation is rebuilt from the first turns of another one and the rest of its own. A node of the trie is a distinct
sequence of first turns; it is named by a 128-bit digest chained from turn to turn, so a prefix is one short value however
long its texts are. Identical rebuilt conversations are collapsed into one sequence with a weight and a list of ends, and
only the sequences' prefixes are looked at from there on. A sequence that is a proper prefix of another one goes by an
anti-join; what stays are the leaves.

Sums over subtrees need no walk. A node is owned by its smallest member, which stands for a sequence through it, and the
nodes that a sequence owns are the end of its path. So the sum over a node's subtree is all that the sequences through it
own, but for its owner, of which only the rest from that node on counts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodsight.llm.crc_sql import CRC_SQL, crc32_sql
from floodsight.llm.frames import small_arrow_batches
from floodsight.session import settle

FAMILY, HEADS = 5, 9
PIECE = 1 << 16  # code points of an end list that one row holds, about
ROOT = bytes(16)
_PREFIXES = "conv_id long, depth long, node binary, parent binary, n_bytes long, is_end boolean"
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]


def n_head(conv_id: int) -> int:
    """How many turns come from the family's first conversation."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def extend(node: bytes, role: bytes, text: bytes) -> bytes:
    return hashlib.blake2b(b"".join((node, len(role).to_bytes(8, "little"), role, text)), digest_size=16).digest()


def rebuilt_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, n_bytes, is_end): a row for each prefix of each rebuilt conversation, the empty one
    included; n_bytes are the UTF-8 bytes of its last text.

    A conversation c begins with the first `n_head(c)` turns of c - c % 5 (% has the sign of c) and goes on with its own
    from there. A family of five is read as one stream, its first conversation in front: a task holds eight digests and
    one Arrow batch of it.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text")).where("conv_id IS NOT NULL")
    rows = rows.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % FAMILY)
    rows = rows.repartition("first_id").sortWithinPartitions("first_id", F.col("conv_id") != F.col("first_id"), "conv_id", "turn", "role", "text")
    rows = rows.select("first_id", "conv_id", F.col("role").cast("binary"), F.col("text").cast("binary"))
    small_arrow_batches(conversations.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]):
        family = conv = last = None
        head: list[tuple[bytes, bytes, int]] = []
        place = skipped = 0
        for part in parts:
            out = []
            for of, name, role, body in zip(*(column.to_pylist() for column in part.columns)):
                if of != family:
                    family, head = of, []
                if name != conv:
                    if last:
                        out.append((*last, True))
                    conv, place, skipped, last = name, 0, 0, (name, 0, ROOT, None, 0)
                    if name != of:
                        skipped = n_head(name)
                        for depth, (node, parent, n_bytes) in enumerate(head[:skipped], 1):
                            out.append((*last, False))
                            last = (name, depth, node, parent, n_bytes)
                place += 1
                if place > skipped:
                    out.append((*last, False))
                    last = (name, last[1] + 1, extend(last[2], role, body), last[2], len(body))
                    if name == of and place < HEADS:
                        head.append(last[2:])
            yield _batch(out)
        if last:
            yield _batch([(*last, True)])

    return rows.mapInArrow(run, _PREFIXES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _KINDS]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS)], [f.split()[0] for f in _PREFIXES.split(", ")])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): the hash of the ids in ascending order, joined by commas.

    The ids are put in order over all tasks, a hot list over many of them, and written as pieces of text; only the
    pieces of a list are then hashed one after the other.
    """
    small_arrow_batches(ends.sparkSession)

    def joined(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            pieces: list[list] = []
            for node, conv in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not pieces or pieces[-1][0] != node or pieces[-1][3] > PIECE:
                    pieces.append([node, conv, [], 0])
                name = str(conv)
                pieces[-1][2].append(name)
                pieces[-1][3] += len(name) + 1
            names = pa.array([",".join(p[2]) for p in pieces], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.int64()), names], ["node", "at", "ids"])

    def hashed(parts: Iterator[pa.RecordBatch]):
        now, state = None, hashlib.sha256()
        for part in parts:
            done = []
            for node, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if node == now:
                    state.update(b",")
                else:
                    done.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield _digests(done)
        yield _digests([(now, state.hexdigest())])

    def _digests(rows: list[tuple]) -> pa.RecordBatch:
        rows = [r for r in rows if r[0] is not None]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])

    ordered = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = ordered.mapInArrow(joined, "node binary, at long, ids string").repartition("node").sortWithinPartitions("node", "at")
    return pieces.select("node", "ids").mapInArrow(hashed, "node binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of all rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, node).

    `conversations(conv_id, turn, role, text)`, turns in the order of turn, null first; equal ones by role and text, and
    repeated rows are turns of their own. Null role or text: empty. A null conv_id names no conversation; such rows are
    left out. Other columns are ignored. An empty table has no nodes. A conversation may be as long as it likes, but one
    task reads it, turn by turn.
    """
    prefixes = settle(rebuilt_prefixes(conversations), "prefixes")
    ends = prefixes.where("is_end")
    sequences = settle(ends.groupBy("node").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")), "sequences")
    digests = end_digests(ends)

    paths = prefixes.join(sequences.select("rep", "weight"), F.col("conv_id") == F.col("rep")).drop("conv_id")
    paths = settle(paths, "paths")
    inner = paths.where("NOT is_end").select("node").distinct()
    leaves = sequences.join(inner, "node", "left_anti").select("rep", F.lit(1).alias("leaf"))
    passing = paths.join(leaves, "rep", "left")
    nodes = passing.groupBy("node", "parent", "depth", "n_bytes").agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves")
    )
    nodes = settle(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")

    owned = settle(nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.sum("saved").alias("all_saved"), F.min("depth").alias("top")), "owned")
    through = paths.join(owned, F.col("rep") == F.col("owner")).select("node", F.col("all_saved").alias("saved"), F.lit(0).alias("child"))
    children = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node"), F.lit(0).cast("long").alias("saved"), F.lit(1).alias("child"))
    sums = through.union(children).groupBy("node").agg(F.sum("saved").alias("through"), F.sum("child").alias("n_children"))

    down = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    placed = nodes.withColumn("below", F.sum("saved").over(down)).join(owned, F.col("conv_id") == F.col("owner"))
    tops = placed.where("depth = top").select(F.col("node").alias("of"), "parent")
    tops = tops.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")), "parent").select("of", "above")
    placed = placed.join(sums, "node").join(tops, F.col("node") == F.col("of"), "left").join(digests, "node", "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    none = F.lit(hashlib.sha256().hexdigest())
    return placed.select(
        "conv_id",
        "depth",
        parent.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("through") - F.col("all_saved") + F.col("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = f"""WITH {CRC_SQL},
  t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, {crc32_sql("conv_id::VARCHAR")} % {HEADS} AS h, conv_id - conv_id % {FAMILY} AS first_id FROM (SELECT DISTINCT conv_id FROM t), crc),
  own AS (SELECT c.conv_id, 0 AS part, p, role, text FROM c JOIN t ON t.conv_id = first_id WHERE p <= h AND first_id <> c.conv_id
    UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN t USING (conv_id) WHERE p > h OR first_id = conv_id),
  turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS depth, md5(role) || md5(text) AS k, octet_length(encode(text)) AS n_bytes FROM own),
  prefixes AS (SELECT conv_id, 0 AS depth, '' AS k, 0 AS n_bytes FROM c
    UNION ALL SELECT conv_id, depth, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth), n_bytes FROM turns),
  nodes AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved FROM prefixes GROUP BY depth, k),
  ends AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(k, depth) AS k FROM prefixes GROUP BY conv_id) GROUP BY k),
  children AS (SELECT left(k, -64) AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
  trees AS (SELECT left(n.k, 64 * d) AS k, sum(saved) AS saved_tokens, count(*) FILTER (c.k IS NULL) AS n_leaves
    FROM (SELECT k, saved, unnest(range(depth + 1)) AS d FROM nodes) n LEFT JOIN children c ON c.k = n.k GROUP BY ALL)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens,
  coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN trees USING (k) LEFT JOIN nodes p ON n.depth > 0 AND p.k = left(n.k, -64) LEFT JOIN children c ON c.k = n.k LEFT JOIN ends e ON e.k = n.k"""
