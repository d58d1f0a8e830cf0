"""Repeated passages by prefix-partitioned suffix trees over words.

A suffix starts at every word that has a whole window (`window` words) behind it. Its prefix is of
variable length: it runs up to the end of the window's anchor, the `gram`-word run with the smallest
fingerprint in the window (the leftmost of equals). Equal windows have their anchor at the same place,
so suffixes that share a window share their prefix. Neighbouring suffixes mostly have the same anchor,
so they travel together, as one segment that carries their words once.

1. Anchors are counted over all texts. A prefix that occurs once has no deep node; it is dropped.
2. Segments of the other prefixes are dealt to groups of bounded memory, by anchor. Each group grows its
   trees downwards from the prefixes, `LEVEL` words a level, and drops every node with a single leaf. What
   is left at the depth of the window are the deep internal nodes: the leaves below them are the places
   where repeats start. A run of such places is a maximal repeat's stretch in its text.
3. A prefix with more than `hot` places would not fit a group. Its suffixes get the longest prefix there is,
   the whole window, which is a deep node by itself if it has two places; those are only counted.
4. Stretches go back to their texts, and covered words are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.llm.frames import broadcast_checked, documents, map_texts
from floodsight.llm.text import find_words, hash_runs, hash_spans, mix, signed, text_bytes
from floodsight.session import settle

WINDOW, GRAM, HOT, LEVEL = 35, 8, 20_000, 5
GROUP_BYTES = 96 << 20
SUFFIX_BYTES = 80  # of a group's memory for each suffix, words and work arrays together


def segments(words: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Runs of suffixes with one anchor: anchor fingerprint, text, first suffix, number of suffixes, anchor's place."""
    none = np.zeros(0, np.int64)
    grams = hash_runs(words, gram)
    if len(words) < window:
        return none.astype(np.uint64), none, none, none, none
    low = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, window - gram + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(place)]
    valid = np.arange(len(place)) + window <= first[1:][text]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    sums = np.concatenate([[0], np.cumsum(valid)])
    ends = np.append(start[1:], len(valid))
    count = sums[ends] - sums[start]
    return grams[place[start]], text[start], start, count, place[start]


def _batch(batch: pa.RecordBatch, window: int, gram: int):
    body = text_bytes(batch.column(batch.schema.get_field_index("text")))
    found = find_words(body)
    words = hash_spans(body.data, found.start, found.end)
    return words, found.first, segments(words, found.first, window, gram)


def _anchor_counts(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def work(batch):
        _, _, (anchor, *_) = _batch(batch, window, gram)
        anchor, count = np.unique(anchor, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(count)], ["anchor", "n"])

    return map_texts(docs, work, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _anchors_by_text(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def work(batch):
        _, _, (anchor, text, *_) = _batch(batch, window, gram)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(signed(anchor))], ["row_id", "anchor"])

    return map_texts(docs, work, "row_id long, anchor long")


def _live_segments(docs: DataFrame, window: int, gram: int, cool: bool = True) -> DataFrame:
    """The segments whose anchors are in the row's list `cool`, with their words; or else the suffixes of those in
    its list `hot`, the fingerprint of the window being the key.
    """
    take_cool = cool

    def keys(column) -> np.ndarray:
        return np.sort(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)) if len(column) else np.zeros(0, np.uint64)

    def work(batch):
        wanted = np.unique(keys(pa.table(batch)["cool" if take_cool else "hot"]))
        if not len(wanted):
            return
        words, first, (anchor, text, start, count, place) = _batch(batch, window, gram)
        ids, names = batch.column(0), ["key", "row_id", "start", "n", "place", "words"]
        live = _member(anchor, wanted)
        a, t, s, n, p = (x[live] for x in (anchor, text, start, count, place))
        if take_cool:
            lengths = n + window - 1
            ends = np.concatenate([[0], np.cumsum(lengths)])
            picked = words[np.arange(ends[-1]) - np.repeat(ends[:-1], lengths) + np.repeat(s, lengths)]
            blob = pa.Array.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer((ends * 8).astype(np.int64).tobytes()), pa.py_buffer(picked.tobytes())])
            columns = [pa.array(signed(a)), ids.take(pa.array(t)), pa.array(s - first[:-1][t]), pa.array(n.astype(np.int32)), pa.array((p - s).astype(np.int32)), blob.cast(pa.binary())]
        else:
            t, s = np.repeat(t, n), np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            one = np.ones(len(s), np.int32)
            columns = [pa.array(signed(hash_runs(words, window)[s])), ids.take(pa.array(t)), pa.array(s - first[:-1][t]), pa.array(one), pa.array(one - 1), pa.nulls(len(s), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names)

    return map_texts(docs, work, "key long, row_id long, start long, n int, place int, words binary")


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def deep_leaves(key: np.ndarray, place: np.ndarray, n: np.ndarray, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Grow the trees of a group. Returns segment and offset of every leaf below an internal node of depth `window`.

    place: of the anchor, from the segment's first suffix. words: of all segments, n + window - 1 each.
    """
    segment = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    lengths = n + window - 1
    at = (np.cumsum(lengths) - lengths)[segment] + offset
    # the tree's root: the anchor, and how far into the suffix it is
    node = mix(key[segment] + (place[segment] - offset).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    depth = 0
    while depth < window and len(node):
        step = min(LEVEL, window - depth)
        node = mix(node) ^ hash_runs(words, step)[at + depth]
        order = np.argsort(node, kind="stable")
        ordered = node[order]
        same = np.zeros(len(node) + 1, bool)
        same[1:-1] = ordered[1:] == ordered[:-1]
        inner = np.sort(order[same[1:] | same[:-1]])  # two leaves at least
        node, segment, offset, at = node[inner], segment[inner], offset[inner], at[inner]
        depth += step
    return segment, offset


def _trees(rows: DataFrame, window: int) -> DataFrame:
    """Stretches of repeat starts (row_id, start, n) of the cool segments; each partition is one group."""

    def run(parts):
        held = [part for part in parts if len(part)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        key, row, start, n, place = (table[x].combine_chunks().to_numpy(zero_copy_only=False) for x in ("key", "row_id", "start", "n", "place"))
        words = np.concatenate([np.frombuffer(c.buffers()[2], np.uint8, c_size(c), c_start(c)).view(np.uint64) for c in table["words"].chunks if len(c)])
        segment, offset = deep_leaves(key.view(np.uint64), place, n, words, window)
        new = np.ones(len(segment), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(segment)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[segment[at]]), pa.array(start[segment[at]] + offset[at]), pa.array(length)], ["row_id", "start", "n"]
        )

    def offsets(c):
        return np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]

    def c_start(c):
        return int(offsets(c)[0])

    def c_size(c):
        return int(offsets(c)[-1]) - int(offsets(c)[0])

    return rows.select("key", "row_id", "start", "n", "place", "words").mapInArrow(run, "row_id long, start long, n long")


def repeated_stretches(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(row_id, start, n): at `n` consecutive words from `start` of the text (counted from 0) start windows that also start elsewhere.

    `docs(row_id, text)`, row_id without nulls or repeats.
    """
    spark = docs.sparkSession
    counts = settle(_anchor_counts(docs, window, gram).where("n > 1"), "anchors")
    weight = counts.agg(F.sum(F.when(F.col("n") <= hot, F.col("n")))).first()[0] or 0
    suffixes = weight * (window - gram + 2) // 2
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes * SUFFIX_BYTES // GROUP_BYTES))
    live = _anchors_by_text(docs, window, gram).join(broadcast_checked(counts), "anchor")
    lists = live.groupBy("row_id").agg(
        F.collect_set(F.when(F.col("n") <= hot, F.col("anchor"))).alias("cool"), F.collect_set(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot")
    )
    # the left join over all rows is the same shuffle of the texts that later puts the result together
    rows = docs.join(lists, "row_id", "left").select("row_id", "text", "cool", "hot")
    trees = _trees(_live_segments(rows, window, gram).where("words IS NOT NULL").repartition(groups, "key"), window)
    if not counts.where(F.col("n") > hot).take(1):
        return trees
    long = _live_segments(rows, window, gram, cool=False).select("key", "row_id", "start")
    deep = long.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return trees.union(long.join(deep, "key").select("row_id", "start", F.lit(1).cast("long").alias("n")))


def strip_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Each text without the words of its repeated windows: (doc_id, n_words, n_removed, kept).

    Words are runs of characters other than space and 0x09-0x0D, unchanged; `kept` joins those left by one
    space. A null text has no words and an empty `kept`. Texts under `window` words are kept whole. Rows with
    equal or null doc_id are texts of their own. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    name = "row_id"
    if docs.where("doc_id IS NULL").take(1) or docs.groupBy("doc_id").count().where("count > 1").take(1):
        docs, name = settle(docs.withColumn("row_id", F.monotonically_increasing_id()), "rows"), "doc_id"
    else:
        docs = docs.withColumnRenamed("doc_id", "row_id")
    stretches = repeated_stretches(docs.select("row_id", "text"), window, gram, hot)
    lists = stretches.groupBy("row_id").agg(F.collect_list(F.struct("start", "n")).alias("stretches"))

    def work(batch):
        body = text_bytes(batch.column(1))
        spans = batch.column(2)
        total, removed, kept = [], [], []
        for i in range(len(batch)):
            words = body.data[body.at[i] : body.at[i + 1]].tobytes().split()
            total.append(len(words))
            if spans[i].is_valid:
                values = spans[i].values
                start, n = values.field(0).to_numpy(), values.field(1).to_numpy()
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, start, 1)
                np.add.at(cover, np.minimum(start + n + window - 1, len(words)), -1)
                keep = np.cumsum(cover[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist()) if k]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    joined = docs.join(lists, "row_id", "left").select(F.col(name).alias("doc_id"), "text", "stretches")
    return map_texts(joined, work, "doc_id long, n_words long, n_removed long, kept string")


def op5_repeated_passages(spark, sf_dir: str) -> DataFrame:
    out = strip_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
