"""Grouping spelling variants by permuterm rotations.

A word of n letters is closed by a mark and rotated to every cut. Cut behind a letter, the rotation ends with that letter,
and the range of rotations that share all but their last letter holds the word with any other letter at that place. So
with the rotations sorted by length and letters, words that differ by one replaced letter stand together, and a word
stands with those that have one letter more at a cut if its own rotation at that cut, last letter and all, is what the
longer ones begin with. One scan of the sorted rotations meets each pair of near words once: of a run of equal letters
only the first is taken as inserted.

A range holds one shorter word at most and a word for each letter of the alphabet, so the scan keeps a few rows, and from
a range of k words come k rows of counts and best neighbours, not its pairs.

Rotations of words beyond LONG letters are told apart by two fingerprints of 61 bits, which come for all cuts at once;
written out they would take the square of the word's length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.llm.crc_sql import CRC_SQL, crc32_sql
from floodsight.llm.frames import documents, map_texts, small_arrow_batches
from floodsight.llm.text import find_runs, text_bytes
from floodsight.session import settle

LEAST, TWICE, DELETE, FACTOR = 7, 2, 31, 10
MARK, LONG = "$", 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LATIN = 0xC3  # the first byte of U+00C0 to U+00FF, and of no other character
_PRIME = (1 << 61) - 1
_BASES = (1_000_003, 805_306_457)


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n): the words of at least LEAST code points, with how often they occur in all texts, TWICE or more.

    Runs are found for a slice of texts at once, on bytes. Where DELETE divides the crc32 of `<doc_id>:<run>`, the run has
    lost a code point; a null doc_id is written as nothing.
    """

    def work(batch):
        body = text_bytes(batch.column(1))
        data = np.frombuffer(body.data.tobytes().translate(_LOWER), np.uint8)
        lead = data == _LATIN
        letter = (data >= 97) & (data <= 122) | lead
        letter[1:] |= lead[:-1]
        start, end, first = find_runs(letter, body.at)
        starts = np.concatenate([[0], np.cumsum(letter & ((data & 0xC0) != 0x80))])
        length = starts[end] - starts[start]
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        raw, found = data.tobytes(), Counter()
        names = [zlib.crc32(b"%s:" % (b"" if d is None else str(d).encode())) for d in batch.column(0).to_pylist()]
        pick = np.flatnonzero(length >= LEAST)
        for a, b, of, n in zip(start[pick].tolist(), end[pick].tolist(), text[pick].tolist(), length[pick].tolist()):
            run = raw[a:b]
            h = zlib.crc32(run, names[of])
            if h % DELETE:
                found[run] += 1
            elif n > LEAST:
                word = run.decode()
                found[(word[: h % n] + word[h % n + 1 :]).encode()] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counts = map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), work, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TWICE)


def rotations(word: str) -> list[tuple[int, str, int, bool]]:
    """(length, key, skipped, first) for all rotations of `word` and MARK.

    `skipped` is the code point of the last letter that the key leaves out, and `first` says that it begins a run of equal
    ones; -1 for the whole rotation, the key of a word with a letter less.
    """
    n = len(word)
    whole = _keys(word, n + 1, range(n + 1), 0)
    less = _keys(word, n, range(1, n + 1), 1)
    out = [(n + 1, key, -1, True) for key in whole]
    return out + [(n, key, ord(word[i]), i == 0 or word[i] != word[i - 1]) for i, key in enumerate(less)]


def _keys(word: str, length: int, cuts: range, drop: int) -> list[str]:
    """The rotations that begin at the cuts, without their last `drop` letters."""
    if length <= LONG:
        return [f"{word[i:]}{MARK}{word[: i - drop] if i else ''}" for i in cuts]
    return ["%x.%x" % pair for pair in zip(*(_fingerprints(word, base, cuts, drop) for base in _BASES))]


def _fingerprints(word: str, base: int, cuts: range, drop: int) -> Iterator[int]:
    """Of each rotation as a number in the base, modulo a prime: from the numbers of the word's beginnings."""
    heads, powers = [0], [1]
    for letter in word:
        heads.append((heads[-1] * base + ord(letter)) % _PRIME)
        powers.append(powers[-1] * base % _PRIME)
    for i in cuts:
        tail = (heads[-1] - heads[i] * powers[len(word) - i]) % _PRIME
        front = i - drop
        yield ((tail * base + ord(MARK)) * powers[front] + heads[front]) % _PRIME


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): for each of `words(word, n)` that has a near one, how many it has and the most frequent of
    them, of equal ones the first in code-point order.
    """
    small_arrow_batches(words.sparkSession)
    names = ["length", "key", "skipped", "first", "word", "n"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]

    def turn(parts: Iterator[pa.RecordBatch]):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names)

        for part in parts:
            rows: list[tuple] = []
            for word, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for rotation in rotations(word):
                    rows.append((*rotation, word, n))
                    if len(rows) >= 1 << 15:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    turned = words.select("word", "n").mapInArrow(turn, "length int, key string, skipped int, first boolean, word string, n long")
    ranges = turned.repartition("length", "key").sortWithinPartitions("length", "key")

    def scan(parts: Iterator[pa.RecordBatch]):
        carried: list[tuple] = []
        for part in parts:
            length, key = part.column(0).to_numpy(), part.column(1)
            keys = key.to_pylist()
            size = part.num_rows
            same = np.zeros(size, bool)
            same[1:] = (length[1:] == length[:-1]) & np.asarray([a == b for a, b in zip(keys[1:], keys[:-1])], bool)
            begins = np.flatnonzero(~same)
            rest = [column.to_pylist() for column in part.columns[2:]]
            out: list[tuple] = []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), size]):
                group = [(length[a], keys[a], *(column[i] for column in rest)) for i in range(a, b)] if b - a > 1 or not a or b == size else []
                if a == 0 and carried:
                    if carried[0][:2] == group[0][:2]:
                        group = carried + group
                    else:
                        out += met(carried)
                    carried = []
                if b == size:
                    carried = group
                else:
                    out += met(group)
            yield found(out)
        yield found(met(carried))

    def met(group: list[tuple]) -> list[tuple]:
        """What the words of one range know of each other: (word, number of near ones, count and name of the best)."""
        if len(group) < 2:
            return []
        shorter = next((row for row in group if row[2] < 0), None)
        longer = [row for row in group if row[2] >= 0]
        ranked = sorted((-row[5], row[4]) for row in longer)
        out = []
        for row in longer:
            others = [x for x in ranked[:2] if x[1] != row[4]][:1]
            count = len(longer) - 1
            if shorter and row[3]:
                others.append((-shorter[5], shorter[4]))
                count += 1
            if count:
                out.append((row[4], count, *min(others)))
        if shorter:
            grown = [(-row[5], row[4]) for row in longer if row[3]]
            if grown:
                out.append((shorter[4], len(grown), *min(grown)))
        return out

    def found(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "k", "less", "best"])

    pairs = ranges.mapInArrow(scan, "word string, k long, less long, best string")
    best = F.min(F.struct("less", "best"))
    near = pairs.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b"))
    return near.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last. Each round doubles the way; a way is as long as counts can
    grow by FACTOR, so a few rounds do.
    """
    ways = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = settle(ways.join(on, "root", "left"), "further")
        if not further.where("further IS NOT NULL").take(1):
            return ways
        ways = settle(further.select("word", F.coalesce("further", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `counted_words`.

    Near words differ by one inserted, deleted or replaced code point. `form` is the most frequent near word, if it occurs
    FACTOR times as often as the word; `root` follows the forms to the last, and is the word itself where there is none.

    `docs(doc_id, text, ...)`; null text: no words; repeated rows count as often as they occur; other columns are ignored. A
    text or a word may be of any length. An empty table gives no words.
    """
    words = settle(counted_words(docs), "words")
    known = words.join(near_words(words), "word", "left")
    form = F.when(F.col("best_n") >= F.col("n") * FACTOR, F.struct(F.col("best").alias("form"), F.col("best_n").alias("form_n")))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("f"))
    known = settle(known.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    found = roots(known.where("form IS NOT NULL"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


OP13_SQL = f"""WITH RECURSIVE {CRC_SQL},
  runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
  hashed AS (SELECT run, doc_id, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc WHERE length(run) >= {LEAST}),
  dealt AS (SELECT CASE WHEN h % {DELETE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
  words AS (SELECT word, count(*) AS n FROM dealt WHERE length(word) >= {LEAST} GROUP BY word HAVING count(*) >= {TWICE}),
  places AS (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM words),
  gaps AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS key FROM places WHERE i < length(word)),
  holes AS (SELECT word, n, left(word, i) || ' ' || substr(word, i + 2) AS key FROM places WHERE i < length(word)),
  pairs AS (SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.key = b.key AND a.word <> b.word
    UNION ALL SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.key UNION ALL SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.key),
  near AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM pairs GROUP BY word),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {FACTOR} * w.n THEN best END AS form, CASE WHEN best_n >= {FACTOR} * w.n THEN best_n END AS form_n
    FROM words w LEFT JOIN near USING (word)),
  ways AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT v.word, f.form, step + 1 FROM ways v JOIN forms f ON f.word = v.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, step) FROM ways v WHERE v.word = f.word) AS root, n, n_near, form_n FROM forms f"""
