"""Token ids in fixed-width bit-packed blocks.

Texts are put in doc_id order by a range shuffle, encoded, and written as blocks of about BLOCK_TOKENS ids.
A block is one binary value:

    8 bytes   b"TOKBITS1"
    uint32    bits for each id, enough for the vocabulary and no more
    uint32    number of texts d
    uint64    number of ids n
    uint64    [d + 1] place of each text's first id, from the block's first
    uint32    the ids, `bits` each, lowest bit first, padded to a multiple of 32 ids

32 ids fill exactly `bits` 32-bit words, so numpy unpacks whole columns of such rows at once, and any text
can be unpacked without the rest. Blocks are rows of a Parquet table (shard, block, n_tokens, doc_ids,
data), which Spark's committer writes, so a lost executor leaves no half-written file. `block_starts`
turns the blocks' lengths into places in the whole sequence.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodsight.llm.frames import documents, give_back, small_arrow_batches
from floodsight.llm.text import SPACE, batches, text_bytes
from floodsight.session import scratch_path

MAGIC = b"TOKBITS1"
BLOCK_TOKENS = 1 << 18
END_ID = 2
CACHED = 150_000  # pieces remembered; twice as many while old ones are let go
PIECES = 4096  # encoded at once
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!#$%&()*+,./:;=?@[]^{}")] = True


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """uint32 words with `bits` bits for each id."""
    rows = np.zeros((-(-len(ids) // 32), 32), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), bits + 1), np.uint64)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        value = rows[:, j] << np.uint64(shift)
        out[:, word] |= value & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= value >> np.uint64(32)
    return out[:, :bits].astype("<u4").reshape(-1)


def unpack(words: np.ndarray, bits: int, first: int, last: int) -> np.ndarray:
    """Ids first..last-1; only the rows of 32 that hold them are touched."""
    low, high = first // 32, -(-last // 32)
    rows = np.zeros((high - low, bits + 1), np.uint64)
    rows[:, :bits] = words[low * bits : high * bits].reshape(-1, bits)
    out = np.empty((high - low, 32), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        out[:, j] = ((rows[:, word] | rows[:, word + 1] << np.uint64(32)) >> np.uint64(shift)) & mask
    return out.reshape(-1)[first - low * 32 : last - low * 32]


def write_block(ids: np.ndarray, at: np.ndarray, bits: int) -> bytes:
    head = MAGIC + np.array([bits, len(at) - 1], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    return head + at.astype("<u8").tobytes() + pack(ids, bits).tobytes()


class Block:
    """A block for reading: `ids(i)` are those of text i, `all_ids()` those of all."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a block of packed token ids")
        self.bits, self.texts = (int(x) for x in np.frombuffer(data, "<u4", 2, 8))
        self.at = np.frombuffer(data, "<u8", self.texts + 1, 24).astype(np.int64)
        self._words = np.frombuffer(data, "<u4", offset=24 + 8 * (self.texts + 1))

    def ids(self, text: int) -> np.ndarray:
        return unpack(self._words, self.bits, int(self.at[text]), int(self.at[text + 1]))

    def all_ids(self) -> np.ndarray:
        return unpack(self._words, self.bits, 0, int(self.at[-1]))


class Encoder:
    """Whole texts to ids with the tokenizers library.

    A byte-level pre-tokenizer never joins a character to the white space after it, nor a letter to the mark
    after it, so a text may be cut before any white space that follows other characters and between letters
    and marks, and its pieces encoded by themselves. Equal pieces are encoded once for each slice of texts,
    and those seen lately are remembered. If an added token would itself be cut, texts are encoded uncut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # ids as uint32
        self.older: dict[str, bytes] = {}
        self.bits = max(1, max(self.tokenizer.get_vocab(with_added_tokens=True).values()).bit_length())
        added = text_bytes(pa.array([x.content for x in self.tokenizer.get_added_tokens_decoder().values()], pa.string()))
        self.whole = bool(self._inner_cuts(added.data, added.at).any())

    def _inner_cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """True where a text may be cut between its ends `at`."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data) > 2:
            letter = _LETTER[data]
            latin = (data[1:] >= 0x80) & (data[:-1] == 0xC3)  # U+00C0 to U+00FF, no white space among them
            letter[1:] |= latin & (data[1:] != 0x97) & (data[1:] != 0xB7)  # signs of multiplication and division
            plain = (data > 0x20) & (data < 0x7F)
            plain[1:] |= latin
            cut[1:-1] = SPACE[data[1:]] & plain[:-1] | _MARK[data[1:]] & letter[:-1]
        cut[at] = False
        return cut

    def _encoded(self, kinds: list[str]) -> list[bytes]:
        """uint32 ids of each piece."""
        found = [self.known.get(x) for x in kinds]
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            found[i] = self.older.get(kinds[i])
        new = [i for i in missing if found[i] is None]
        for k in range(0, len(new), PIECES):
            some = new[k : k + PIECES]
            for i, code in zip(some, self.tokenizer.encode_batch_fast([kinds[i] for i in some], add_special_tokens=False)):
                found[i] = array("I", code.ids).tobytes()
        self.known.update((kinds[i], found[i]) for i in missing if len(kinds[i]) <= 40)
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the place of each text's first."""
        body = text_bytes(texts)
        cut = np.zeros(len(body.data) + 1, bool) if self.whole else self._inner_cuts(body.data, body.at)
        cut[body.at] = True
        cuts = np.flatnonzero(cut)
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(body.at), np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body.data))])
        coded = pc.dictionary_encode(pieces)
        found = self._encoded(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        which = coded.indices.to_numpy()
        count = sizes[which]
        ends = np.concatenate([[0], np.cumsum(count)])
        begin = (np.cumsum(sizes) - sizes)[which]
        ids = flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, count)]
        return ids, ends[np.searchsorted(cuts, body.at)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that what is remembered serves the next task too."""
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the ids of all texts, `end_id` after each, in ascending doc_id order as a table of blocks at `path`.

    Null text: only the end id. Null doc_id: first. Rows with equal doc_id stand together, in the order of a
    fingerprint of their text. Other columns are left out. An empty table gives a table without blocks. A text of any length is
    encoded piece by piece and lies in one block, which then is larger than others.
    """
    small_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(parts: Iterator[pa.RecordBatch]):
        own, number, shard = _encoder(tokenizer), 0, TaskContext.get().partitionId()
        names, ids, sizes, held = [], [], [], 0

        def block():
            at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            data = write_block(np.concatenate(ids), at, bits)
            doc_ids = pa.concat_arrays(names)
            lists = pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids)
            columns = [pa.array([shard]), pa.array([number]), pa.array([int(at[-1])]), lists, pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "block", "n_tokens", "doc_ids", "data"])

        bits = max(own.bits, int(end_id).bit_length())
        for part in parts:
            for piece in batches(part):
                code, at = own.encode(piece.column(1))
                names.append(piece.column(0))
                ids.append(np.insert(code, at[1:], end_id))
                sizes.append(np.diff(at) + 1)
                held += len(ids[-1])
                if held >= block_tokens:
                    yield block()
                    number += 1
                    names, ids, sizes, held = [], [], [], 0
            give_back()
        if names:
            yield block()

    rows.mapInArrow(run, "shard long, block long, n_tokens long, doc_ids array<long>, data binary").write.parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(shard, block, start): ids before each block. The one-task window sees a row for each shard."""
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    sizes = blocks.select("shard", "block", "n_tokens").join(shards.select("shard", before.alias("base")), "shard")
    return sizes.select("shard", "block", (F.col("base") + F.coalesce(within, F.lit(0))).alias("start"))


def read_digests(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each text, from the blocks at `path`."""
    blocks = spark.read.parquet(path)

    def run(parts):
        for part in parts:
            for i in range(len(part)):
                block = Block(part.column(3)[i].as_py())
                ids = block.all_ids().astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(block.at[:-1], block.at[1:])]
                n = block.texts
                columns = [
                    part.column(2)[i].values,
                    pa.array(np.full(n, part.column(0)[i].as_py(), np.int64)),
                    pa.array(np.full(n, part.column(1)[i].as_py(), np.int64)),
                    pa.array(block.at[:-1]),
                    pa.array(np.diff(block.at)),
                    pa.array(crc, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "shard", "block", "at", "n_tokens", "ids_crc32"])
            give_back()

    schema = "doc_id long, shard long, block long, at long, n_tokens long, ids_crc32 long"
    texts = blocks.select("shard", "block", "doc_ids", "data").mapInArrow(run, schema)
    out = texts.join(block_starts(blocks), ["shard", "block"])
    return out.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write `docs` as packed token ids in the shared folder and read the digests back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_digests(docs.sparkSession, path)


def op2_token_output(spark, sf_dir: str) -> DataFrame:
    return token_digests(documents(spark, sf_dir))
