"""Masked pseudo-likelihood scores of whole texts.

A network in numpy predicts each word from the SIDE words before and after it, the word itself being hidden: one embedding
table for each place of the window, a hidden layer, and a softmax over symbols. A text's score is the sum of the log
probabilities of all its words. Symbols are the words that occur LEARNED times or more in all texts, up to MOST_WORDS of them
by frequency, and TAIL buckets for the others by their fingerprint. A word of a bucket has the bucket's probability times its
own share of the bucket's words, from the counts of all words of the corpus: n / (N + 1), and 1 / (N + 1) for a word that
wasn't counted.

The softmax has two steps, so that a word costs the square root of the vocabulary: symbols are put into classes by frequency,
and a symbol's probability is its class's times its own within the class.

The table of shares grows with the corpus. Words counted twice or more go to the tasks as arrays, the most frequent ones up to
HELD_WORDS; what is left of them is joined by fingerprint. Any other word was counted once or not at all, which is the same share.

Training reads all texts, every word being a target and the words around it its context. Texts are dealt by their hash to
shards of about SHARD_WORDS words, so their number grows with the corpus and doesn't depend on how rows lie; in a shard they
stand in the order of the hash. Each shard trains its own copy of the starting weights; the copies are averaged, weighted by
their targets, first on the executors and then over one row for each shuffle partition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.llm.frames import BROADCAST_ROWS, documents, map_texts, small_arrow_batches
from floodsight.llm.text import batches, find_words, hash_spans, signed, text_bytes
from floodsight.session import settle

LEARNED, MOST_WORDS, TAIL, SIDE, HIDDEN = 50, 1984, 64, 3, 16
BATCH, RATE = 8192, 0.05
LARGEST = 3.0  # of the weights behind the hidden layer, so that no exponential overflows
CHUNK = 1 << 12
SHARD_WORDS = 1 << 21
HELD = 2_000_000
HELD_WORDS = BROADCAST_ROWS


@dataclass
class Vocabulary:
    words: np.ndarray  # fingerprints in ascending order
    symbol: np.ndarray
    counts: np.ndarray  # of each symbol over the corpus; words by frequency, then the buckets

    @property
    def size(self) -> int:
        return len(self.counts)

    @property
    def top(self) -> int:
        return len(self.words)

    def symbols(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        hashes, first = fingerprints(texts)
        return self.of(hashes), first

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = self.top + (hashes % np.uint64(TAIL)).astype(np.int64)
        if len(self.words):
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            known = self.words[at] == hashes
            out[known] = self.symbol[at[known]]
        return out


@dataclass
class Shares:
    """Of each word in its bucket, as logarithms."""

    words: np.ndarray  # fingerprints in ascending order, of the held words
    counts: np.ndarray
    base: np.ndarray  # log(N + 1) of each bucket
    rest: DataFrame | None  # (word, n) of the words counted twice or more that aren't held

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log share of each word by the held ones, others counting as seen once; and which aren't held."""
        n, other = np.ones(len(hashes)), np.ones(len(hashes), bool)
        if len(self.words):
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            other = self.words[at] != hashes
            n = np.where(other, 1, self.counts[at])
        return np.log(n) - self.base[(hashes % np.uint64(TAIL)).astype(np.int64)], other


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    body = text_bytes(texts)
    found = find_words(body)
    return hash_spans(body.data, found.start, found.end), found.first


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word of all texts occurs."""

    def run(parts):
        held, size = [], 0

        def counted():
            words, which = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([n for _, n in held])).astype(np.int64)
            return words, n

        for part in parts:
            for piece in batches(part):
                body = text_bytes(piece.column(0))
                found = find_words(body)
                words, n = np.unique(hash_spans(body.data, found.start, found.end), return_counts=True)
                held.append((words, n))
                size += len(words)
                if size > HELD:
                    words, n = counted()
                    yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n)], ["word", "n"])
                    held, size = [], 0
        if size:
            words, n = counted()
            yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n)], ["word", "n"])

    return settle(docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """The frequent words of all texts, and how often each symbol occurs. Of words that occur equally often at the bound, those
    with the smaller fingerprints are in."""
    counts = word_counts(docs) if counts is None else counts
    top = counts.where(F.col("n") >= LEARNED).orderBy(F.desc("n"), "word").limit(MOST_WORDS).toPandas()
    words = top.word.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    rest = ((counts.agg(F.sum("n")).first()[0] or 0) - top.n.sum()) / TAIL
    return Vocabulary(words[order], order, np.concatenate([top.n.to_numpy(float), np.full(TAIL, float(rest))]))


def shares(counts: DataFrame, words: Vocabulary, most: int = HELD_WORDS) -> Shares:
    """The shares of the words that aren't among the most frequent ones of `words`."""
    bucket, total = F.pmod("word", F.lit(TAIL)), np.zeros(TAIL)
    for row in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():
        total[row.bucket] = row.n
    np.subtract.at(total, (words.words % np.uint64(TAIL)).astype(np.int64), words.counts[words.symbol])
    again, least, size = counts.where("n > 1"), 2, 0
    steps = again.groupBy("n").agg(F.count("*").alias("k")).toPandas().sort_values("n", ascending=False)
    for n, k in zip(steps.n.tolist(), steps.k.tolist()):
        size += k
        if size > most:
            least = n + 1
            break
    held = again.where(F.col("n") >= least).toArrow()
    hashes = held["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Shares(hashes[order], held["n"].to_numpy()[order], np.log(total + 1), again.where(F.col("n") < least) if size > most else None)


def _errors(logits: np.ndarray, chosen: np.ndarray, size: int) -> np.ndarray:
    """The slope of the logits: probabilities less one for what was chosen, over `size`."""
    np.exp(logits, out=logits)
    logits *= (1 / (logits @ np.ones(logits.shape[1], np.float32)) / size)[:, None]
    logits[np.arange(len(chosen)), chosen] -= 1 / size
    return logits


def _log_chosen(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    own = logits[np.arange(len(chosen)), chosen].astype(np.float64)
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], np.float32))


class Net:
    """Weights: place [2 SIDE, symbols + 1, HIDDEN], the last symbol standing for what is beyond the text; a bias of the hidden
    layer; out and base of the classes; out and base of the symbols in each class, filled up to whole classes."""

    def __init__(self, counts: np.ndarray, seed: int = 11):
        random = np.random.default_rng(seed)
        symbols = len(counts)
        self.width = width = int(np.ceil(np.sqrt(symbols)))
        classes = -(-symbols // width)
        share = np.full((classes, width), 1e-9)
        share.reshape(-1)[:symbols] = (counts + 1) / (counts + 1).sum()
        each = share.sum(axis=1, keepdims=True)
        self.parts = [
            random.normal(0, 0.3, (2 * SIDE, symbols + 1, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            np.zeros((HIDDEN, classes), np.float32),  # so that it starts from the frequencies
            np.log(each[:, 0]).astype(np.float32),
            np.zeros((classes, HIDDEN, width), np.float32),
            np.log(share / each).astype(np.float32),
        ]

    def bytes(self) -> bytes:
        return b"".join(x.tobytes() for x in self.parts)

    def load(self, flat: np.ndarray) -> Net:
        at = 0
        for k, x in enumerate(self.parts):
            self.parts[k] = flat[at : at + x.size].astype(np.float32).reshape(x.shape)
            at += x.size
        return self

    def hidden(self, context: np.ndarray) -> np.ndarray:
        place, bias = self.parts[:2]
        total = place[0][context[0]] + bias
        for k in range(1, 2 * SIDE):
            total += place[k][context[k]]
        return np.tanh(total, out=total)

    def _by_class(self, target: np.ndarray):
        """(class, the rows of its targets) of each class that occurs."""
        kind = (target // self.width).astype(np.int16)
        order = np.argsort(kind, kind="stable")  # by radix
        ordered = kind[order]
        begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
            yield int(ordered[a]), order[a:b]

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, _, out, base, inner_out, inner_base = self.parts
        hidden = self.hidden(context)
        result = _log_chosen(hidden @ out + base, target // self.width)
        for kind, rows in self._by_class(target):
            result[rows] += _log_chosen(hidden[rows] @ inner_out[kind] + inner_base[kind], target[rows] % self.width)
        return result

    def learn(self, context: np.ndarray, target: np.ndarray, seen: list[np.ndarray]) -> None:
        """One Adagrad step on a batch; only the weights that it touches change."""
        place, bias, out, base, inner_out, inner_base = self.parts
        hidden, size = self.hidden(context), len(target)
        error = hidden @ out
        error += base
        error = _errors(error, target // self.width, size)
        back = error @ out.T
        for kind, rows in self._by_class(target):
            own = hidden[rows]
            wrong = own @ inner_out[kind]
            wrong += inner_base[kind]
            wrong = _errors(wrong, target[rows] % self.width, size)
            back[rows] += wrong @ inner_out[kind].T
            _step(inner_out[kind], own.T @ wrong, seen[4][kind], LARGEST)
            _step(inner_base[kind], wrong.sum(axis=0), seen[5][kind])
        back *= 1 - hidden**2
        for k in range(2 * SIDE):
            order = np.argsort(context[k].astype(np.int16), kind="stable")
            ordered = context[k][order]
            at = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            rows, slope = ordered[at], np.add.reduceat(back[order], at, axis=0)
            seen[0][k][rows] += slope**2
            place[k][rows] -= RATE * slope / np.sqrt(seen[0][k][rows])
        _step(bias, back.sum(axis=0), seen[1])
        _step(out, hidden.T @ error, seen[2], LARGEST)
        _step(base, error.sum(axis=0), seen[3])


def _step(weights: np.ndarray, slope: np.ndarray, seen: np.ndarray, largest: float | None = None) -> None:
    seen += slope**2
    weights -= RATE * slope / np.sqrt(seen)
    if largest:
        np.clip(weights, -largest, largest, out=weights)


def contexts(symbols: np.ndarray, first: np.ndarray, target: np.ndarray, beyond: int) -> np.ndarray:
    """Symbols at the 2 SIDE places around each target word, in its own text; `beyond` outside of it."""
    text = np.searchsorted(first, target, side="right") - 1
    low, high = first[text], first[text + 1]
    out = np.empty((2 * SIDE, len(target)), np.int64)
    for k, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = target + shift
        inside = (at >= low) & (at < high)
        out[k] = np.where(inside, symbols[np.where(inside, at, 0)], beyond)
    return out


def train(docs: DataFrame, words: Vocabulary) -> Net:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    size = sum(x.size for x in Net(words.counts).parts)
    shards = max(1, round(words.counts.sum() / SHARD_WORDS))

    def local(parts):
        net, seen, targets, now = None, [], 0, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([targets], pa.int64()), pa.array([net.bytes()], pa.binary())], ["n", "weights"])

        for part in parts:
            for piece in batches(part):
                shard = piece.column(0).to_numpy()
                begin = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(shard)]):
                    if shard[a] != now:
                        if targets:
                            yield done()
                        net, targets, now = Net(shared.value.counts), 0, shard[a]
                        seen = [np.full_like(x, 1e-4) for x in net.parts]
                    symbols, first = shared.value.symbols(piece.column(1).slice(a, b - a))
                    for c in range(0, len(symbols), BATCH):
                        target = np.arange(c, min(c + BATCH, len(symbols)))
                        net.learn(contexts(symbols, first, target, shared.value.size), symbols[target], seen)
                    targets += len(symbols)
        if targets:
            yield done()

    def average(parts):
        total, n = np.zeros(size), 0
        for part in parts:
            for count, weights in zip(part.column(0).to_pylist(), part.column(1)):
                total += count * np.frombuffer(weights.as_buffer(), np.float32)
                n += count
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["n", "weights"])

    key = F.xxhash64("text")
    dealt = docs.where("text IS NOT NULL").select(F.pmod(key, F.lit(shards)).alias("shard"), "text", key.alias("key"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "key").select("shard", "text")
    copies = dealt.mapInArrow(local, "n long, weights binary")
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = copies.repartition(groups).mapInArrow(average, "n long, weights binary").toLocalIterator()
    total, n = np.zeros(size), 0
    for row in rows:
        total += row.n * np.frombuffer(row.weights, np.float32)
        n += row.n
    return Net(words.counts).load(total / n) if n else Net(words.counts)


def scores(docs: DataFrame, words: Vocabulary, net: Net, within: Shares | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) for each row of `docs(doc_id, text, ...)`.

    Words are runs of characters other than space and 0x09-0x0D. Null, empty and blank texts have 0 tokens, a log_prob of 0 and
    a null mean. Texts of any length are scored CHUNK words at a time. Repeated rows come back as often; null doc_ids stay null;
    other columns are ignored; an empty table gives no rows. Without `within` the log probabilities are those of the symbols alone.
    """
    joined = within is not None and within.rest is not None
    held = within and Shares(within.words, within.counts, within.base, None)
    shared = docs.sparkSession.sparkContext.broadcast((words, net, held))

    def work(batch):
        known, model, share = shared.value
        hashes, first = fingerprints(batch.column(1))
        symbols = known.of(hashes)
        each = np.empty(len(symbols))
        for a in range(0, len(symbols), CHUNK):
            target = np.arange(a, min(a + CHUNK, len(symbols)))
            each[target] = model.log_probability(contexts(symbols, first, target, known.size), symbols[target])
        other = np.zeros(len(symbols), bool)
        if share:
            tail = np.flatnonzero(symbols >= known.top)
            own, other[tail] = share.of(hashes[tail])
            each[tail] += own
        sums = np.concatenate([[0.0], np.cumsum(each)])
        total, n = sums[first[1:]] - sums[first[:-1]], np.diff(first)
        columns = [batch.column(0), pa.array(n), pa.array(total)]
        if joined:
            at = np.concatenate([[0], np.cumsum(other)])[first].astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(signed(hashes[other]))))
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "log_prob", "rare"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    out = map_texts(rows, work, "doc_id long, n_tokens long, log_prob double" + ", rare array<long>" * joined)
    if joined:
        out = settle(out.withColumn("row", F.monotonically_increasing_id()), "scored")
        found = out.select("row", F.explode("rare").alias("word")).join(within.rest, "word")
        found = found.groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        out = out.join(found, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def score_texts(docs: DataFrame) -> DataFrame:
    small_arrow_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = word_counts(docs)
    words = vocabulary(docs, counts)
    return scores(docs, words, train(docs, words), shares(counts, words))


def op6_pseudo_likelihood(spark, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))
