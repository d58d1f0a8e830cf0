"""Line dedup by deletion neighbourhoods, over words.

A line is what stands between \\n characters; its words are runs of characters other than space and 0x09-0x0D.
Lines with equal words are one class. Classes of `least` words or more are also near if one word more, less or
changed makes them equal. A line goes if the same line, or a near one that stays, stands earlier by (doc_id, line number).

Only classes that can have a near one emit their neighbourhood: one edit leaves the first or the last half of the
shorter line whole, so a class must share one of its halves with another. Each of these emits itself and all
variants with one word left out, as fingerprints. Two classes with equal variants at one place differ by a changed
word; a class that equals another's variant differs by a missing word. For each variant only the earliest class is
looked for, so a family of very many lines is reduced to its first before the shuffle and no pairs within it are made.
The edit distance of what is found is verified on the words.

Near isn't the same as equal: of a chain of lines, each near the next, the earliest may be near the second alone. So a class
goes only when one that is sure to stay is near, and what is open after that is decided in further rounds without the classes
that went. A round looks only at the variants of open classes; each decides at least the earliest of a chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.llm.frames import BROADCAST_ROWS, documents, map_texts
from floodsight.llm.text import _STEP, find_words, hash_spans, mix, signed, text_bytes
from floodsight.session import settle

LEAST = 3
_UP = np.multiply.accumulate(np.r_[np.uint64(1), np.full(1 << 12, _STEP, np.uint64)])
_DOWN = np.uint64(pow(_STEP, -1, 1 << 64))


class Lines:
    """The lines with words of a slice of texts: text, number in the text, number of words, fingerprint."""

    def __init__(self, texts: pa.Array):
        self.body = text_bytes(texts)
        found = find_words(self.body)
        self.start, self.end = found.start, found.end
        breaks = np.flatnonzero(self.body.data == 10)
        line = np.searchsorted(breaks, self.start)  # of each word, over the slice
        text = np.repeat(np.arange(len(found.first) - 1), found.counts)
        begin = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (text[1:] != text[:-1])]) if len(line) else np.zeros(0, np.int64)
        self.first = np.append(begin, len(line))
        self.text = text[begin]
        self.number = line[begin] - np.searchsorted(breaks, self.body.at[:-1])[self.text]
        self.n = np.diff(self.first)
        words = hash_spans(self.body.data, self.start, self.end)
        place = np.arange(len(words)) - np.repeat(begin, self.n)
        self.power = _UP[place] if not len(place) or place.max() < len(_UP) else _powers(place)
        self.place = place
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.power, dtype=np.uint64)])
        self.words = words
        self.plain = self.sums[self.first[1:]] - self.sums[begin]
        self.hash = mix(self.plain + self.n.astype(np.uint64))

    def halves(self) -> np.ndarray:
        """Fingerprints of the first and last h words of each line, a row each, for every h that is half of this or a neighbouring length."""
        out = []
        for h in ((self.n - 1) // 2, self.n // 2, (self.n + 1) // 2):
            begin, end = self.first[:-1], self.first[1:]
            head = self.sums[begin + h] - self.sums[begin]
            tail = (self.sums[end] - self.sums[end - h]) * _inverse(self.n - h)
            out += [mix(head + h.astype(np.uint64)), mix(tail * np.uint64(3) + h.astype(np.uint64))]
        return np.stack(out, axis=1)

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, place, fingerprint): the lines themselves (place -1), and each with one word left out."""
        n = self.n[lines]
        row = np.repeat(lines, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[lines], n)
        before = self.sums[at] - self.sums[self.first[row]]
        after = (self.sums[self.first[row + 1]] - self.sums[at + 1]) * _DOWN
        left = mix(before + after + (self.n[row] - 1).astype(np.uint64))
        places = np.concatenate([np.full(len(lines), -1), self.place[at]])
        return np.concatenate([lines, row]), places, np.concatenate([self.hash[lines], left])

    def words_of(self, line: int) -> bytes:
        a, b = self.first[line], self.first[line + 1] - 1
        return b" ".join(self.body.data[self.start[a] : self.end[b]].tobytes().split())


def _powers(place: np.ndarray) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(place.max()), _STEP, np.uint64)])[place]


def _inverse(count: np.ndarray) -> np.ndarray:
    table = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(count.max(initial=0)), _DOWN, np.uint64)])
    return table[count]


def within_one(x: list, y: list) -> int:
    """0, 1, or 2 for more edits."""
    if abs(len(x) - len(y)) > 1:
        return 2
    a = 0
    while a < min(len(x), len(y)) and x[a] == y[a]:
        a += 1
    if a == len(x) == len(y):
        return 0
    rest = x[a + 1 :] == y[a + 1 :] or x[a:] == y[a + 1 :] or x[a + 1 :] == y[a:]
    return 1 if rest else 2


def _line_rows(docs: DataFrame, halves: bool, least: int) -> DataFrame:
    def work(batch):
        lines = Lines(batch.column(1))
        columns = [batch.column(0).take(pa.array(lines.text)), pa.array(lines.number), pa.array(lines.n), pa.array(signed(lines.hash))]
        names = ["doc_id", "line_no", "n", "h"]
        if halves:
            keys = lines.halves()
            size = np.where(lines.n >= least, keys.shape[1], 0)
            flat = signed(keys[lines.n >= least].reshape(-1))
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat)))
            names.append("halves")
        yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, line_no long, n long, h long" + ", halves array<long>" * halves
    return map_texts(docs, work, schema)


def _neighbourhoods(docs: DataFrame) -> DataFrame:
    """Variants of the lines whose fingerprints are in `wanted`; the line itself carries its words."""

    def work(batch):
        lines, wanted = Lines(batch.column(1)), batch.column(2)
        found = []
        begin = np.searchsorted(lines.text, np.arange(len(batch) + 1))
        for i in range(len(batch)):
            keys = wanted[i].values.to_numpy().view(np.uint64)
            own = np.arange(begin[i], begin[i + 1])
            _, first = np.unique(lines.hash[own], return_index=True)
            own = own[np.sort(first)]
            found.append(own[np.isin(lines.hash[own], keys)])
        row, place, key = lines.variants(np.concatenate(found))
        texts = [lines.words_of(x) if p < 0 else None for x, p in zip(row.tolist(), place.tolist())]
        columns = [pa.array(signed(key)), pa.array(place), pa.array(signed(lines.hash[row])), batch.column(0).take(pa.array(lines.text[row])), pa.array(lines.number[row])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary())], ["v", "i", "h", "doc_id", "line_no", "words"])

    return map_texts(docs, work, "v long, i long, h long, doc_id long, line_no long, words binary")


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no) of every line that goes, and the earliest line that stays and that it repeats.

    Lines are counted from 0 in each text of `docs(doc_id, text, ...)`. Null and empty texts and lines without words take
    no part. A null doc_id counts as the smallest. Rows with equal doc_id are read as one text each; a line they have in common is
    reported once less than it is there. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    here = F.struct("doc_id", "line_no")
    rows = _line_rows(docs, True, least)
    classes = rows.groupBy("h", "n").agg(F.min(here).alias("first"), F.count("*").alias("copies"), F.first("halves").alias("halves"))
    classes = settle(classes, "line-classes")
    keys = classes.select("h", "first", F.explode(F.array_distinct("halves")).alias("half"))
    shared = keys.groupBy("half").agg(F.count("*").alias("k")).where("k > 1").select("half")
    live = keys.join(shared, "half").select("h", F.col("first.doc_id").alias("at")).distinct()
    live = settle(live.groupBy("at").agg(F.collect_set("h").alias("wanted")), "live-lines")
    if (live.agg(F.sum(F.size("wanted"))).first()[0] or 0) <= BROADCAST_ROWS:
        live = F.broadcast(live)
    near = docs.join(live, F.col("doc_id").eqNullSafe(F.col("at"))).select("doc_id", "text", "wanted")
    near = settle(_neighbourhoods(near), "variants")

    earliest = _nearest_kept(near)
    kept = classes.select("h", "n", "first", "copies").join(earliest, "h", "left").where("copies > 1 OR near IS NOT NULL")
    kept = kept.select("h", "n", F.coalesce("near", "first").alias("kept"))
    out = _line_rows(docs, False, least).join(kept, ["h", "n"]).where(~F.col("kept").eqNullSafe(here))
    return out.select("doc_id", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no"))


def _earlier(near: DataFrame, texts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(h, best): for each variant of a class (of those in `asked`) the earliest other class that has it, if that is earlier."""
    named = F.struct("doc_id", "line_no", "h")
    changed = near.where("i >= 0").groupBy("v", "i").agg(F.min(named).alias("best"), F.min("h").alias("x"), F.max("h").alias("y")).where("x <> y")
    missing = near.groupBy("v").agg(F.min(F.when(F.col("i") < 0, named)).alias("whole"), F.min(F.when(F.col("i") >= 0, named)).alias("less"))
    missing = missing.where("whole IS NOT NULL AND less IS NOT NULL")
    own = near if asked is None else near.join(asked, "h", "left_semi")
    found = own.join(changed.select("v", "i", "best"), ["v", "i"]).select("h", named.alias("own"), "best")
    found = found.union(own.join(missing, "v").select("h", named, F.when(F.col("i") < 0, F.col("less")).otherwise(F.col("whole"))))
    found = found.where("best < own AND best.h <> h").select("h", "best").distinct()
    pairs = found.withColumn("other", F.col("best.h")).join(texts, "h").join(texts.toDF("other", "others"), "other")
    verified = pairs.select("h", "best", "words", "others").mapInArrow(_verify, "h long, best struct<doc_id:long,line_no:long,h:long>")
    return verified.select("h", "best", F.col("best.h").alias("of"))


def _nearest_kept(near: DataFrame) -> DataFrame:
    """(h, near): each class that goes, and the earliest class that stays and is near it."""
    texts = near.where("i < 0").groupBy("h").agg(F.min("words").alias("words"))
    narrow = near.drop("words")
    pairs = settle(_earlier(narrow, texts), "near-lines")
    gone, going = None, []
    while True:
        # a class without an earlier near one stays
        waiting = pairs.select(F.col("h").alias("of")).distinct()
        sure = pairs.join(waiting, "of", "left_anti").groupBy("h").agg(F.min(F.struct("best.doc_id", "best.line_no")).alias("near"))
        going.append(settle(sure, "gone-lines"))
        now = going[-1].select("h")
        gone = now if gone is None else settle(gone.union(now), "gone")
        still = settle(pairs.select("h").distinct().join(now, "h", "left_anti"), "open-lines")
        if not still.take(1):
            break
        keys = narrow.join(still, "h", "left_semi").select("v").distinct()
        left = settle(narrow.join(keys, "v", "left_semi").join(gone, "h", "left_anti"), "open-variants")
        pairs = settle(_earlier(left, texts, still), "near-lines")
    out = going[0]
    for more in going[1:]:
        out = out.union(more)
    return out


def _verify(parts):
    for part in parts:
        rows = zip(part.column(2).to_pylist(), part.column(3).to_pylist())
        yield part.select([0, 1]).filter(pa.array([within_one(x.split(b" "), y.split(b" ")) < 2 for x, y in rows], pa.bool_()))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_lines(documents(spark, sf_dir))
