"""Quality rules with a line-labelling CRF.

Each line with a word gets binary features; a linear-chain conditional random field with the labels content and
boilerplate is trained on the lines of a bounded sample of labelled texts, and Viterbi decoding labels the lines of
every text. A text is kept if enough of its words are in content lines and its base rules hold.

Lines of the sample are labelled by their text: those of a bad text are boilerplate; those of a good one are content
but for repeated lines, lines without a letter and lines full of symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.llm.frames import documents, map_texts
from floodsight.llm.text import SPACE, code_points, find_runs, find_words, hash_runs, hash_spans, inside, mix, per_text, text_bytes

SAMPLE = 1500
SHARE = 0.5
CHAIN = 256  # lines of a training sequence
_SYMBOL, _LETTER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT[48:58] = True
_MARK[list(b".!?")] = True
FEATURES = 22


class TextLines:
    """Base counts of each text, and its lines with words: text, number of words, features, whether repeated, letterless or symbols."""

    def __init__(self, texts: pa.Array):
        body = text_bytes(texts)
        data, at = body.data, body.at
        found = find_words(body)
        words = hash_spans(data, found.start, found.end)
        self.n_words = found.counts
        self.word_chars = per_text(code_points(data) & ~SPACE[data], at)
        self.n_symbols = per_text(_SYMBOL[data], at)
        self.n_repeat_words = _repeat_words(words, found.first)
        start, end, _ = find_runs(data != 10, at)
        line = np.searchsorted(start, found.start, side="right") - 1
        held = np.unique(line)
        start, end = start[held], end[held]
        self.text = np.searchsorted(at, start, side="right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(at)))
        first_word = np.append(np.searchsorted(found.start, start), len(found.start))
        self.words = np.diff(first_word)
        self.repeated = _again(hash_spans(data, start, end), self.text)
        self.n_dup_lines = np.bincount(self.text[self.repeated], minlength=len(at) - 1)
        size = (end - start).astype(np.float64)
        part = {k: _within(flags[data], start, end) / np.maximum(size, 1) for k, flags in (("letter", _LETTER), ("digit", _DIGIT), ("symbol", _SYMBOL))}
        same = _again(words, line)
        fresh = 1 - np.add.reduceat(same, first_word[:-1]) / np.maximum(self.words, 1) if len(start) else np.zeros(0)
        length = size / np.maximum(self.words, 1)
        closed = _MARK[data[found.end[first_word[1:] - 1] - 1]] if len(start) else np.zeros(0, bool)
        tops = data[start] if len(start) else np.zeros(0, np.uint8)
        rows = [
            np.ones(len(start), bool), self.words == 1, self.words <= 3, self.words <= 8, self.words > 20, self.words > 200,
            closed, (tops >= 65) & (tops < 91) | (tops >= 128), self.repeated,
            part["letter"] == 0, part["letter"] < 0.5, part["letter"] > 0.75, part["digit"] > 0.05, part["digit"] > 0.2,
            part["symbol"] > 0, part["symbol"] > 0.03, part["symbol"] > 0.1,
            fresh < 0.3, fresh < 0.6, fresh > 0.9, length < 4, length > 10,
        ]
        self.features = np.stack(rows, axis=1).astype(np.float32).reshape(len(start), FEATURES)
        self.odd = self.repeated | (part["letter"] == 0) | (part["symbol"] > 0.1)


def _within(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[end] - sums[start]


def _again(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True where an equal entry of the same group comes earlier."""
    order = np.lexsort((np.arange(len(hashes)), hashes, group))
    out = np.zeros(len(hashes), bool)
    h, g = hashes[order], group[order]
    out[order[1:]] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    return out


def _repeat_words(words: np.ndarray, first: np.ndarray, size: int = 5) -> np.ndarray:
    start, text = inside(first, size)
    key = mix(hash_runs(words, size)[start] + mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
    twice = start[order[same[1:] | same[:-1]]] if len(start) else start
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + size, -1)
    return per_text(np.cumsum(cover[:-1]) > 0, first)


@dataclass
class Crf:
    emit: np.ndarray  # [FEATURES, 2], label 1 is content
    move: np.ndarray  # [2, 2]

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels of all lines; `first` has each text's first line. Texts are decoded side by side."""
        score = features @ self.emit
        steps = _Steps(first)
        back = np.zeros(score.shape, np.int8)
        best = None
        for rows in steps:
            if best is None:
                best = score[rows]
            else:
                way = best[: len(rows), :, None] + self.move
                back[rows] = way.argmax(axis=1)
                best = np.concatenate([way.max(axis=1) + score[rows], best[len(rows) :]])
        labels = np.zeros(len(score), np.int8)
        if best is None:
            return labels
        now = best.argmax(axis=1).astype(np.int8)
        for rows in reversed(steps.rows):
            labels[rows] = now[: len(rows)]
            now[: len(rows)] = back[rows, now[: len(rows)]]
        return labels


class _Steps:
    """Lines by their place in the text, the longest text first: step t has the line t of all texts that have one."""

    def __init__(self, first: np.ndarray):
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        starts, sizes = first[:-1][order], size[order]
        self.rows = []
        for t in range(int(sizes[0]) if len(sizes) else 0):
            self.rows.append(starts[: np.searchsorted(-sizes, -t)] + t)

    def __iter__(self):
        return iter(self.rows)


def train(features: np.ndarray, labels: np.ndarray, first: np.ndarray, rounds: int = 80, rate: float = 0.3, ridge: float = 1e-3) -> Crf:
    """Gradient ascent on the mean conditional log-likelihood of a line (Adagrad), by forward and backward sums."""
    emit, move = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    if not len(labels):
        return Crf(np.zeros((FEATURES, 2), np.float32), move)
    steps = _Steps(first).rows
    seen = [np.full_like(emit, 1e-6), np.full_like(move, 1e-6)]
    truth = np.eye(2)[labels]
    follows = np.ones(len(labels), bool)
    follows[first[:-1][np.diff(first) > 0]] = False
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (labels[:-1][follows[1:]], labels[1:][follows[1:]]), 1)
    for _ in range(rounds):
        score = features @ emit
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[steps[0]] = score[steps[0]]
        for t in range(1, len(steps)):
            rows = steps[t]
            ahead[rows] = np.logaddexp.reduce(ahead[rows - 1][:, :, None] + move, axis=1) + score[rows]
        for t in range(len(steps) - 1, 0, -1):
            rows = steps[t]
            behind[rows - 1] = np.logaddexp.reduce(move + (score[rows] + behind[rows])[:, None, :], axis=2)
        total = np.logaddexp.reduce(ahead + behind, axis=1)
        each = np.exp(ahead + behind - total[:, None])
        later = np.flatnonzero(follows)
        both = np.exp(ahead[later - 1][:, :, None] + move + (score[later] + behind[later])[:, None, :] - total[later][:, None, None])
        slopes = [features.T @ (truth - each) / len(labels) - ridge * emit, (pairs - both.sum(axis=0)) / len(labels) - ridge * move]
        for value, slope, sums in zip((emit, move), slopes, seen):
            sums += slope**2
            value += rate * slope / np.sqrt(sums)
    return Crf(emit.astype(np.float32), move.astype(np.float32))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf:
    """From the texts of up to `sample` labelled doc_ids, picked by a fingerprint of the id."""
    picked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")

    def work(batch):
        lines = TextLines(batch.column(2))
        good = batch.column(1).to_numpy(zero_copy_only=False)[lines.text] > 0
        bits = (lines.features @ (2.0 ** np.arange(FEATURES))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lines.text)), pa.array(bits), pa.array((good & ~lines.odd).astype(np.int64))], ["doc_id", "bits", "content"])

    found = map_texts(rows, work, "doc_id long, bits long, content long").toPandas()
    bits = found.bits.to_numpy(np.int64)
    features = (bits[:, None] >> np.arange(FEATURES) & 1).astype(np.float32)
    ids = found.doc_id.to_numpy()
    new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(ids))
    first = np.array([x for a, b in zip(new, ends) for x in range(a, b, CHAIN)] + [len(ids)], np.int64)
    return train(features, found.content.to_numpy(np.int64), first)


def line_quality(docs: DataFrame, model: Crf, share: float = SHARE) -> DataFrame:
    """A row for each row of `docs(doc_id, text, ...)`: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, content_share).

    Words are runs of characters other than space and 0x09-0x0D. Null, empty and blank texts have counts of 0, fail the base
    rules and have a content_share of 0. Where content and boilerplate score alike, a line is boilerplate. Lines of a text are
    decoded whole, however many there are. Repeated rows come back as often; null doc_ids stay null; other columns are ignored.
    An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(batch):
        lines = TextLines(batch.column(1))
        label = shared.value.decode(lines.features, lines.first)
        content = np.bincount(lines.text, weights=lines.words * label, minlength=len(batch)) / np.maximum(lines.n_words, 1)
        failed = (lines.n_words < 10) | (100 * lines.n_repeat_words > 20 * lines.n_words)
        columns = [pa.array(getattr(lines, x).astype(np.int64)) for x in names]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *columns, pa.array(failed), pa.array(~failed & (content >= share)), pa.array(content)], ["doc_id", *names, "base_failed", "kept", "content_share"]
        )

    return map_texts(rows, work, f"doc_id long, {', '.join(f'{x} long' for x in names)}, base_failed boolean, kept boolean, content_share double")


def op4_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return line_quality(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
