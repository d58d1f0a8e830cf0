"""The prefix trie, the slots and the spelling variants against plain versions, on small tables and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from floodsight.llm import permuterm, prefix_trie, slots

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, node long, depth long, rep long, parent string"
DOCS = "doc_id long, text string, size long, shard int, slot string, word string, n long, place int"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- 11 -----------------------------------------------------------------------------------


def plain_trie(turns):
    """turns: (conv_id, turn, role, text)"""
    own = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + mine[h:]) if c % 5 else tuple(mine)
    members = collections.defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k)))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), children[k], sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(rng, convs):
    out = []
    for c in convs:
        for turn in range(rng.randrange(0, 11)):
            text = rng.choice(["hi", "ho", "été", "", None])
            out.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", "assistant", None]), text, 1, 2, 3, "x"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_the_plain_one(spark, seed):
    rng = random.Random(seed)
    turns = turns_of(rng, rng.sample(range(120), 60))
    turns += [(c, 0, "user", "one and the same", 1, 2, 3, "x") for c in range(200, 260, 5)]  # a large group of copies
    turns += [(None, 0, "user", "of nobody", 1, 2, 3, "x"), turns[0], (300, 0, "user", "long " * 50_000, 1, 2, 3, "x")]
    got = prefix_trie.conversation_trie(spark.createDataFrame(turns, TURNS).repartition(4))
    assert rows(got, *NODE) == plain_trie([t[:4] for t in turns])


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.conversation_trie(empty).count() == 0
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", 1, 2, 3, "x")], TURNS)).count() == 0


def test_a_long_end_list_is_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    ends = spark.range(1000).select(F.lit(b"x" * 16).alias("node"), F.col("id").alias("conv_id")).repartition(7)
    want = hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()
    assert [tuple(r) for r in prefix_trie.end_digests(ends).select("ends_sha256").collect()] == [(want,)]


# --- 12 -----------------------------------------------------------------------------------

ODD = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None), (2, None), (3, ""), (4, "été " * 9), (5, "x" * 200_000)]


def odd_docs(spark):
    rng = random.Random(5)
    more = [(n, "w" * rng.randrange(300)) for n in range(10, 900)] + [(n, "a copy of one text") for n in range(900, 1300)] + [(7, "again")] * 300
    return spark.createDataFrame([(*r, 1, 2, "s", "w", 3, 4) for r in ODD + more], DOCS).repartition(5)


def test_shards_hold_every_record_once_and_evenly(spark, tmp_path):
    docs = odd_docs(spark)
    placed, slot_map = slots.shard_documents(docs)
    got = placed.collect()
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, len(t) + 1, zlib.crc32(t)) for d, t in texts)
    bytes_of, numbers = collections.Counter(), collections.defaultdict(list)
    for r in got:
        bytes_of[r.shard] += r.size
        numbers[r.shard].append(r.slot)
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())
    share = sum(bytes_of.values()) / slots.SHARDS
    large = max(r.bytes for r in slot_map.collect())
    assert max(bytes_of.values()) - min(bytes_of.values()) <= large and large > share
    versions = slot_map.groupBy("version").agg(F.count("*"), F.sum("bytes")).orderBy("version").collect()
    assert [tuple(v) for v in versions] == [(v, slots.SLOTS, sum(bytes_of.values())) for v in (1, 2)]
    again, _ = slots.shard_documents(docs.repartition(2))
    assert rows(again, "doc_id", "text_crc32", "shard", "slot") == rows(placed, "doc_id", "text_crc32", "shard", "slot")
    slots.write_shards(docs, slot_map, str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.columns == [*docs.columns, "shard_"]
    assert rows(stored, "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "shard_") == rows(placed, "doc_id", "text_crc32", "shard")


def test_one_more_shard_takes_slots_only_into_itself(spark):
    rows_ = slots.records(odd_docs(spark).where("coalesce(length(text), 0) < 1000"))
    eight = slots.rebalanced(slots.first_map(slots.slot_loads(rows_)))
    nine = slots.newest(slots.grown(eight, 8)).collect()
    before = {r.virtual_slot: r.shard for r in slots.newest(eight).collect()}
    assert all(r.shard in (before[r.virtual_slot], 8) for r in nine) and {r.version for r in nine} == {3}
    load = collections.Counter()
    for r in nine:
        load[r.shard] += r.bytes
    assert len(load) == 9 and max(load.values()) - min(load.values()) < 1000


def test_copies_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(slots, "COPIES", 7)
    docs = spark.createDataFrame([(7, "again")] * 100 + [(8, "other")], "doc_id long, text string")
    got = slots.shard_documents(docs)[0].collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(len(v) for v in by.values()) == [1, 100] and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_of_nothing(spark):
    placed, slot_map = slots.shard_documents(spark.createDataFrame([], DOCS))
    assert placed.count() == 0 and slot_map.count() == 2 * slots.SLOTS


def test_the_main_path_of_sharding_has_no_python(spark):
    plan = slots.op12_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- 13 -----------------------------------------------------------------------------------

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_variants(texts):
    counts = collections.Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if v != w and distance_one(v, w)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


WORD = ["word", "form", "root", "n", "n_near", "form_n"]


def variant_texts(rng):
    """Words with edits of edits, runs of one letter, letters of two bytes, and very long words."""
    base = ["spelling", "variant", "aaaaaaa", "Économie", "señoritaÿ", "abcabcabc"]
    words = []
    for word in base:
        words += [word] * 300
        for _ in range(12):
            i, c = rng.randrange(len(word)), rng.choice("aéz×")
            edited = rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])
            words += [edited] * rng.choice([2, 3, 25])
            words += [edited[:2] + "q" + edited[2:]] * 2
    longest = "lang" * 40
    words += [longest] * 22 + [longest[:80] + "x" + longest[80:]] * 2 + [longest[:-1]] * 2 + [longest[1:]] * 2 + ["y" + longest[1:]] * 2
    rng.shuffle(words)
    texts = [(n, " ".join(words[n * 50 : n * 50 + 50])) for n in range(len(words) // 50 + 1)]
    return texts + [(None, "spelling SPELLING spellings spellings"), (None, None), (3, ""), (4, "1234 -- ..."), texts[0], texts[0]]


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_the_plain_version(spark, seed):
    texts = variant_texts(random.Random(seed))
    docs = spark.createDataFrame([(*t, 1, 2, "s", "w", 3, 4) for t in texts], DOCS).repartition(3)
    assert rows(permuterm.spelling_variants(docs), *WORD) == plain_variants(texts)


@pytest.mark.parametrize("long", [1, 8, 1000])
def test_fingerprints_and_rotations_find_the_same_words(spark, monkeypatch, long):
    words = sorted({w for _, t in variant_texts(random.Random(9)) for w in (t or "").split()})
    monkeypatch.setattr(permuterm, "LONG", long)
    pairs = collections.Counter()
    keys = collections.defaultdict(list)
    for word in words:
        for length, key, skipped, first in permuterm.rotations(word):
            keys[length, key].append((word, skipped, first))
    for group in keys.values():
        for a, skipped, first in group:
            for b, other, at_first in group:
                if a < b and (skipped >= 0 and other >= 0 or (first if other < 0 else at_first)):
                    pairs[a, b] += 1
    assert pairs == {(a, b): 1 for a in words for b in words if a < b and distance_one(a, b)}


def test_a_very_long_word_takes_room_by_its_length(spark):
    word = "abcdefg" * 3000
    keys = permuterm.rotations(word)
    assert len(keys) == 2 * len(word) + 1 and max(len(k) for _, k, _, _ in keys) < 40


def test_variants_of_nothing(spark):
    assert permuterm.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
