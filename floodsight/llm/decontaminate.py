"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits. Runs of `seed` words that a text shares with an item
are its seeds: rolled Karp-Rabin fingerprints of both sides, joined in each task with one block of items.
Seeds that follow one another in both are one match. Tiles are then marked greedily, the longest match
first; a match that overlaps a tile is cut back, and counts again if `seed` words of it are left. Tiles
may lie anywhere in the text, so passages whose sentences were moved around are covered as well. An item
is in a text if the tiles cover at least `share` of its words.

Where seeds of a text stand in very many places of the items, as in repetitive texts, their pairs are not written out: items are
tiled one by one, by the length of the longest match that is left. The tiles are the same.

Items go to the tasks in blocks of bounded bytes, and the texts are read once for each block, without
a shuffle.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.llm.frames import documents, map_texts
from floodsight.llm.text import find_runs, hash_runs, hash_spans, inside, text_bytes

SEED, SHARE = 5, 0.5
MOST_PAIRS = 1 << 19  # of equal places that are written out at once
BLOCK_BYTES = 8 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of all texts, and where each text's begin."""
    body = text_bytes(pc.utf8_lower(texts.cast(pa.string())))
    start, end, first = find_runs(_WORD[body.data], body.at)
    return hash_spans(body.data, start, end), first


class Items:
    """A block of benchmark items, with the places of all their seeds."""

    def __init__(self, ids: pa.Array, texts: pa.Array, seed: int):
        self.ids, self.seed = ids, seed
        self.words, self.first = plain_words(texts)
        start, item = inside(self.first, seed)
        grams = hash_runs(self.words, seed)[start]
        order = np.argsort(grams, kind="stable")
        self.grams, self.item, self.place = grams[order], item[order], (start - self.first[:-1][item])[order]

    def found(self, texts: pa.Array, share: float) -> list[tuple[int, int, int, int, int]]:
        """(text, item, words of the item, words covered, tiles) of each text and item that reaches `share`."""
        words, first = plain_words(texts)
        start, text = inside(first, self.seed)
        grams = hash_runs(words, self.seed)[start] if len(words) >= self.seed else np.zeros(0, np.uint64)
        low, high = np.searchsorted(self.grams, grams), np.searchsorted(self.grams, grams, side="right")
        out = []
        for texts_here in _portions(text, high - low, len(first) - 1):
            out += self._pairs(words, first, start, text, low, high, share, texts_here)
        return out

    def _pairs(self, words, first, start, text, low, high, share, here: slice) -> list[tuple[int, int, int, int, int]]:
        """`found` for the seeds `here`: those of some texts with MOST_PAIRS places in all, or of one text with more."""
        start, text, low, high = start[here], text[here], low[here], high[here]
        hit = np.flatnonzero(high > low)
        count = (high - low)[hit]
        if not len(hit):
            return []
        if count.sum() > MOST_PAIRS:
            return self._repetitive(words, first, int(text[0]), low[hit], high[hit], share)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)
        item, p = self.item[at], self.place[at]
        text, t = np.repeat(text[hit], count), np.repeat((start - first[:-1][text])[hit], count)
        order = np.lexsort((t, t - p, item, text))
        item, p, text, t = item[order], p[order], text[order], t[order]
        pair = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])])
        out = []
        for a, b in zip(pair, np.append(pair[1:], len(text))):
            size = int(self.first[item[a] + 1] - self.first[item[a]])
            if not self._reached(np.unique(p[a:b]), size, share):
                continue
            covered, tiles = tile(t[a:b], p[a:b], self.seed)
            if covered >= share * size:
                out.append((int(text[a]), int(item[a]), size, covered, tiles))
        return out

    def _reached(self, places: np.ndarray, size: int, share: float) -> bool:
        """Whether all seeds together cover enough of the item."""
        reach = np.zeros(size + 1, np.int64)
        reach[places] += 1
        reach[places + self.seed] -= 1
        return (np.cumsum(reach[:-1]) > 0).sum() >= share * size

    def _repetitive(self, words, first, text: int, low, high, share) -> list[tuple[int, int, int, int, int]]:
        """`found` for one text whose seeds stand in very many places: an item is looked at once, however often they do."""
        _, once = np.unique(low, return_index=True)
        low, count = low[once], (high - low)[once]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        order = np.lexsort((self.place[at], self.item[at]))
        item, p = self.item[at][order], self.place[at][order]
        begin = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        out, body = [], words[first[text] : first[text + 1]]
        for a, b in zip(begin, np.append(begin[1:], len(item))):
            own = self.words[self.first[item[a]] : self.first[item[a] + 1]]
            if self._reached(p[a:b], len(own), share):
                covered, tiles = tile_by_length(body, own, self.seed)
                if covered >= share * len(own):
                    out.append((text, int(item[a]), len(own), covered, tiles))
        return out


def _portions(text: np.ndarray, count: np.ndarray, texts: int):
    """Slices of the seeds, whole texts each, with MOST_PAIRS places or one text."""
    ends = np.searchsorted(text, np.arange(texts), side="right")
    total = np.concatenate([[0], np.cumsum(count)])[ends]
    done = 0
    while done < texts:
        begin = int(ends[done - 1]) if done else 0
        so_far = total[done - 1] if done else 0
        last = max(done + 1, int(np.searchsorted(total, so_far + MOST_PAIRS, side="right")))
        yield slice(begin, int(ends[last - 1]))
        done = last


def tile_by_length(text: np.ndarray, item: np.ndarray, seed: int) -> tuple[int, int]:
    """`tile` of two lists of words, in room that grows with their lengths and not with the pairs of equal places.

    The longest match of what is free is searched for by its length: windows of that many words are compared by their
    fingerprints. All matches of that length are marked, from left to right, before the next length is looked for.
    """
    free_t, free_p = np.ones(len(text), bool), np.ones(len(item), bool)

    def windows(size):
        sides = []
        for words, free in ((text, free_t), (item, free_p)):
            taken = np.concatenate([[0], np.cumsum(~free)])
            at = np.flatnonzero(taken[size:] == taken[: len(words) - size + 1]) if len(words) >= size else np.zeros(0, np.int64)
            sides += [at, hash_runs(words, size)[at] if len(at) else np.zeros(0, np.uint64)]
        return sides

    covered = tiles = 0
    most = min(len(text), len(item))
    while most >= seed:
        low, high = seed - 1, most  # a match of `low` words is known, or low is too short to count
        while low < high:
            size = (low + high + 1) // 2
            _, x, _, y = windows(size)
            if np.isin(x, y).any():
                low = size
            else:
                high = size - 1
        if low < seed:
            break
        at, x, places, y = windows(low)
        order = np.argsort(y, kind="stable")
        places, y = places[order], y[order]
        turn = np.searchsorted(y, np.unique(y)) if len(y) else np.zeros(0, np.int64)
        names = np.unique(y)
        ends = np.append(turn[1:], len(y))
        where = np.searchsorted(names, x)
        for here, name, group in zip(at.tolist(), x.tolist(), where.tolist()):
            if group == len(names) or names[group] != name or not free_t[here : here + low].all():
                continue
            while turn[group] < ends[group]:
                there = places[turn[group]]
                if free_p[there : there + low].all():
                    free_t[here : here + low] = False
                    free_p[there : there + low] = False
                    covered, tiles = covered + low, tiles + 1
                    break
                turn[group] += 1
        most = low - 1
    return covered, tiles


def tile(t: np.ndarray, p: np.ndarray, seed: int) -> tuple[int, int]:
    """Words covered and number of tiles. t, p: places of the seeds in the text and the item, by diagonal t - p, then t."""
    new = np.flatnonzero(np.r_[True, (np.diff(t) != 1) | (np.diff(p) != 1)])
    length = np.diff(np.append(new, len(t))) + seed - 1
    queue = [(-n, int(x), int(y)) for n, x, y in zip(length.tolist(), t[new], p[new])]
    heapq.heapify(queue)
    in_text, in_item = set(), set()
    covered = tiles = 0
    while queue:
        n, x, y = heapq.heappop(queue)
        n = -n
        free = [x + i not in in_text and y + i not in in_item for i in range(n)]
        if all(free):
            in_text.update(range(x, x + n))
            in_item.update(range(y, y + n))
            covered += n
            tiles += 1
            continue
        i = 0
        while i < n:  # what the tiles left of it
            j = i
            while j < n and free[j]:
                j += 1
            if j - i >= seed:
                heapq.heappush(queue, (i - j, x + i, y + i))
            i = j + 1
    return covered, tiles


def _blocks(benchmark: DataFrame, seed: int):
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES)
    for k in range(count):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).toArrow()
        if block.num_rows:
            ids, texts = (block[x].combine_chunks() for x in ("item_id", "text"))
            yield items.sparkSession.sparkContext.broadcast(Items(ids, texts, seed))


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles) for every text that holds an item.

    Null and empty texts hold nothing; an item of fewer than `seed` words, or null, is never found. Of matches of equal length
    that with the smaller place in the text is marked first, then in the item. Texts may be long and repetitive: a task holds
    some MB for MOST_PAIRS equal places, and a few numbers for each word of one text. Repeated rows are reported each. Other columns are ignored. An empty table on either side gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, item_words long, covered_words long, n_tiles long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, seed):

        def work(batch, items=items):
            found = items.value.found(batch.column(1), share)
            rows = batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))
            ids = items.value.ids.take(pa.array([x[1] for x in found], pa.int64()))
            rest = [pa.array([x[k] for x in found], pa.int64()) for k in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([rows, ids, *rest], ["doc_id", "item_id", "item_words", "covered_words", "n_tiles"])

        out = out.union(map_texts(docs, work, schema))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, share: float = SHARE) -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no item. Rows go one by one, so null or repeated ids don't matter."""
    schema, at = docs.schema, docs.columns.index("text")
    for items in _blocks(benchmark, seed):

        def work(batch, items=items):
            keep = np.ones(len(batch), bool)
            keep[[x[0] for x in items.value.found(batch.column(at), share)]] = False
            yield batch.filter(pa.array(keep))

        docs = map_texts(docs, work, schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
