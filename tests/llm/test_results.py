"""Every operator against a plain version, an exact round trip or held-out accuracy, on small tables and odd rows."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from floodsight.llm import bit_pack, chat, decontaminate, language, line_crf, line_dedup, mixing, ngram_join, pseudo_likelihood, repeats
from floodsight.llm.catalog import QUERIES
from floodsight.llm.text import find_words, hash_runs, hash_spans, text_bytes
from tests.llm import plain

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, token long, anchor long, key long, row_id long, domain string, place string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r[:2], *(r[2:4] if len(r) > 2 else ("en", "src1")), 0, 1, 2, 3, 4, 5, 6, "x", "y") for r in rows], COLUMNS)


LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "the quick brown fox jumps over the lazy dog near the old river bank today"),
    (3, None, None, None),
    (4, "", "de", None),
    (5, " \n\t ", None, "src2"),
    (6, LONG, "en", "src0"),
    (7, LONG + " end", "en", "src0"),
    (None, "A text without a name, and nothing else of note in it at all.", "en", "src3"),
    (None, None),
    (8, "été à la plage\x0bavec\x0cdes amis <|endoftext|> é è x", "fr", "src3"),
    (9, "x " * 300, "en", "src0"),
    (10, "12 34 $$$", "es", "src9"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_words_and_fingerprints():
    texts = [t for _, t, *_ in ODD] + ["a" * 3_000_000 + " b"]
    body = text_bytes(pa.array(texts))
    found = find_words(body)
    got = [body.data[a:b].tobytes().decode() for a, b in zip(found.start, found.end)]
    assert got == [w for t in texts for w in plain.words(t)]
    hashes = hash_spans(body.data, found.start, found.end)
    assert len(set(zip(got, hashes.tolist()))) == len(set(got)) == len(set(hashes.tolist()))
    runs = hash_runs(hashes, 7)
    again = [tuple(got[i : i + 7]) for i in range(len(runs))]
    assert len(set(zip(again, runs.tolist()))) == len(set(again)) == len(set(runs.tolist()))


def test_ngram_join(spark, docs, odd, nothing):
    for hot in (2, 6):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs, hot_count=hot, hot_tokens=500).collect()}
        assert got == plain.components(texts_of(docs), 4, 85)
    rows = ngram_join.ngram_components(odd).collect()
    assert len(rows) == len(ODD)
    named = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert named == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10}
    assert ngram_join.ngram_components(nothing).count() == 0


def test_ngram_join_of_a_crowd(spark):
    random = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(60):
        w = list(base)
        for k in random.integers(0, 60, random.integers(0, 4)):
            w[k] = f"x{random.integers(0, 50)}"
        texts[d] = " ".join(w[: 60 - int(random.integers(0, 4))])
    got = ngram_join.ngram_components(table(spark, list(texts.items())), hot_count=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain.components(texts, 4, 85)


@pytest.mark.parametrize("hot", [3, 20_000])
def test_repeats(spark, docs, odd, nothing, hot):
    for df, rows in ((docs, list(texts_of(docs).items())), (odd, [r[:2] for r in ODD])):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept) for r in repeats.strip_repeats(df, hot=hot).collect())
        kept = plain.stripped([t for _, t in rows], 35)
        want = sorted((d is None, d or 0, len(plain.words(t)), len(plain.words(t)) - len(k), " ".join(k)) for (d, t), k in zip(rows, kept))
        assert got == want
    assert repeats.strip_repeats(nothing).count() == 0


def test_line_dedup(spark, docs, nothing):
    some = {d: t for d, t in texts_of(docs).items() if d < 80}
    line = "one two three four five six seven eight nine ten"
    some |= {900: line, 901: f"{line} eleven\n\n  \n{line}", 902: line.replace("five", "5"), 903: line.replace("five ", ""), 904: None, 905: "ab cd", 906: "ab ce\nab cd"}
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in line_dedup.repeated_lines(table(spark, list(some.items()))).collect()}
    assert got == plain.near_lines(some, line_dedup.LEAST, line_dedup.within_one)
    assert got[902, 0] == got[903, 0] == got[901, 0] == (900, 0) and (906, 0) not in got and got[906, 1] == (905, 0)
    rows = line_dedup.repeated_lines(table(spark, [(None, line), (1, line), (1, line)])).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in rows} == {(1, None)}
    assert line_dedup.repeated_lines(nothing).count() == 0


def test_line_dedup_of_short_lines(spark):
    """Headers of three to seven words with one word changed, added or left out."""
    texts = {1: "Page 1 of 9\nall rights reserved", 2: "Page 2 of 9\nall rights kept", 3: "Page 3 of 9\nall rights reserved here", 4: "Anat with by reen of nteres are.", 5: "Anat with by|reen of nteres are."}
    texts |= {6: "Anat with by reen of atre are.", 7: "two words\nno, more words\nnone", 8: "two swords\nmore words\nsome"}
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in line_dedup.repeated_lines(table(spark, list(texts.items()))).collect()}
    assert got == plain.near_lines(texts, 3, line_dedup.within_one)
    assert got[2, 0] == got[3, 0] == (1, 0) and got[2, 1] == got[3, 1] == (1, 1) and got[6, 0] == (4, 0)


def test_decontamination(spark, docs, benchmark, odd, nothing):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    moved = "Iota, KAPPA lambda mu. in between; alpha beta gamma delta epsilon zeta! eta theta iota kappa lambda"
    rows = [(1, moved), (2, "alpha beta gamma delta"), (3, None), (4, ""), (None, f"so {item} it"), (5, item), (5, item)]
    found = decontaminate.contaminated(table(spark, rows), bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.covered_words) for r in found) == [(0, 1, 12), (1, 1, 11), (5, 1, 12), (5, 1, 12)]
    clean = decontaminate.clean_documents(table(spark, rows), bench)
    assert clean.columns == odd.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    assert decontaminate.contaminated(nothing, bench).count() == decontaminate.contaminated(odd, bench.where("false")).count() == 0
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    items = {r.item_id: r.text for r in benchmark.collect()}
    whole = {(d, i) for d, t in texts_of(docs).items() for i, x in items.items() if " ".join(plain.words(x)) in " ".join(plain.words(t))}
    assert whole and whole <= got


def test_tiles_are_longest_first():
    # items 0..9; the text has 0..4, then 3..9: the longer match wins and the other is cut back
    t = np.array([20, 21, 22, 0, 1])
    p = np.array([3, 4, 5, 0, 1])
    assert decontaminate.tile(t, p, 5) == (7, 1)


@pytest.mark.parametrize("most", [0, 1 << 19])
def test_tiles_equal_the_plain_tiling(monkeypatch, most):
    """Words of few kinds, so that seeds stand in many places, written out or not."""
    rng = random.Random(11)
    monkeypatch.setattr(decontaminate, "MOST_PAIRS", most)
    for _ in range(150):
        kinds, seed = rng.choice([1, 2, 4]), rng.choice([2, 3, 5])
        lists = [[f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(25))] for _ in range(5)]
        items = decontaminate.Items(pa.array([7, 8]), pa.array([" ".join(x) for x in lists[:2]]), seed)
        found = items.found(pa.array([" ".join(x) for x in lists[2:]]), 0.3)
        want = []
        for n, text in enumerate(lists[2:]):
            for k, item in enumerate(lists[:2]):
                covered, tiles = plain.tiles(text, item, seed)
                if tiles and covered >= 0.3 * len(item):
                    want.append((n, k, len(item), covered, tiles))
        assert sorted(found) == want


def test_very_repetitive_texts_take_little_room():
    items = decontaminate.Items(pa.array([1, 2]), pa.array(["ha " * 20_000, "ha ho " * 10_000]), 5)
    tracemalloc.start()
    found = items.found(pa.array(["ha " * 20_000, "ha ho " * 9_000 + "ha " * 2_000]), 0.5)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert (0, 0, 20_000, 20_000, 1) in found and {(t, i) for t, i, *_ in found} == {(0, 0), (1, 1)}


def test_lines_go_only_for_lines_that_stay(spark):
    """Chains of lines, each near the next one."""
    rng = random.Random(2)
    texts = {1: "a b c d e", 2: "a b c d f", 3: "a b c g f", 4: "a b h g f", 5: "a b h g f\na b c d e"}
    texts |= {n: "\n".join(" ".join(rng.choice("xyz") for _ in range(rng.randrange(2, 7))) for _ in range(6)) for n in range(10, 30)}
    got = {(r.doc_id, r.line_no): (r.kept_doc_id, r.kept_line_no) for r in line_dedup.repeated_lines(table(spark, list(texts.items()))).collect()}
    assert got == plain.near_lines(texts, line_dedup.LEAST, line_dedup.within_one)
    assert got[2, 0] == (1, 0) and (3, 0) not in got and got[4, 0] == (3, 0) and not set(got.values()) & set(got)


def test_near_texts_with_one_doc_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    for rows in ([(1, a), (1, b), (2, a + " x"), (3, "y " + b)], [(1, b), (1, a), (3, "y " + b), (2, a + " x")]):
        found = ngram_join.ngram_components(table(spark, rows)).collect()
        assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1)]
        kept = corpus_pipeline.near_duplicate_stage(spark, table(spark, [*rows, rows[0]]).withColumnRenamed("n", "kept_id"), SF).collect()
        assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b)]


def test_encoding_of_cut_texts():
    """Pieces give the ids that whole texts give, while remembered pieces come and go."""
    own = bit_pack.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    parts = ["a", "Be", "é", "×", "÷", "ß", " ", "  ", "\n", "\u00a0", "'s", "'", ".", ",", "!!", "*", "|", "<|endoftext|>", "<|", "12", "中", "😀", "\u0301", "(", "\r\n"]
    pick = random.Random(5)
    kept, bit_pack.CACHED = bit_pack.CACHED, 200
    try:
        for _ in range(5):
            texts = ["".join(pick.choices(parts, k=pick.randint(0, 30))) for _ in range(400)] + [None, ""]
            ids, at = own.encode(pa.array(texts, pa.string()))
            for i, code in enumerate(own.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)):
                assert ids[at[i] : at[i + 1]].tolist() == code.ids
    finally:
        bit_pack.CACHED = kept


def test_bit_packing():
    random = np.random.default_rng(1)
    for bits in (1, 7, 16, 17, 31):
        ids = random.integers(0, 1 << bits, 1000)
        at = np.array([0, 0, 10, 999, 1000])
        block = bit_pack.Block(bit_pack.write_block(ids, at, bits))
        assert (block.all_ids() == ids).all() and all((block.ids(i) == ids[at[i] : at[i + 1]]).all() for i in range(4))


def test_token_output(spark, docs, odd, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, odd):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        got = sorted(bit_pack.token_digests(df).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [r.doc_id for r in rows]
        want = {}
        for r in rows:
            ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
            want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
        seen, start = {}, 0
        for r in got:
            assert r.start == start
            start += r.n_tokens
            seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
        assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    assert bit_pack.token_digests(nothing).count() == 0


def test_language(spark, docs, odd, nothing):
    model = language.learn(docs)
    rows = language.predictions(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.9 and all(0 <= r.score <= 1 for r in rows)
    got = language.predictions(odd, model).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id in (3, 4, 5, 10):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred in model.langs
    kept = language.known_language(odd, model)
    assert kept.columns == odd.columns and not {3, 4, 5, 10} & {r.doc_id for r in kept.collect()}
    unlearned = language.learn(nothing)
    assert {r.lang_pred for r in language.predictions(odd, unlearned).collect()} == {"und"} and language.predictions(nothing, model).count() == 0


def test_language_rejects_what_is_far(spark):
    """Foreign letters and gibberish go at any length; short pieces of held-out texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, pick = language.learn(docs), random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", *("".join(map(chr, range(a, b))) for a, b in ((0x430, 0x450), (0x3B1, 0x3CA), (0x4E00, 0x5E00)))]
    word = lambda letters: "".join(pick.choices(letters, k=pick.randint(2, 9)))
    foreign = [" ".join(word(x) for _ in range(n)) for n in (10, 30, 100, 300, 1000, 5000) for x in alphabets for _ in range(3)]
    held = docs.where(language.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("text").collect()
    short = [" ".join(r.text.split()[:n]) for r in held for n in (1, 2, 3, 5, 10)]
    ids = {r.doc_id: r.rejected for r in language.predictions(table(spark, list(enumerate(foreign + short))), model).collect()}
    assert all(ids[k] for k in range(len(foreign)))
    assert np.mean([ids[k] for k in range(len(foreign), len(ids))]) <= 0.02
    assert language.known_language(table(spark, list(enumerate(foreign))), model).count() == 0


def test_line_quality(spark, docs, odd, nothing):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = line_crf.learn(docs, labels)
    for df in (docs, odd):
        texts = sorted((plain.base_counts(r.text) for r in df.select("text").collect()))
        got = line_crf.line_quality(df, model).collect()
        assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
        assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    good = line_crf.line_quality(docs, model).join(labels.where("quality = 1"), "doc_id").where("NOT base_failed")
    assert good.agg(F.avg(F.col("kept").cast("int"))).first()[0] >= 0.95
    empty = line_crf.learn(nothing, labels)
    assert line_crf.line_quality(nothing, model).count() == 0 and line_crf.line_quality(odd, empty).count() == len(ODD)


def test_viterbi_is_the_best_path():
    import itertools

    random = np.random.default_rng(2)
    model = line_crf.Crf(random.normal(size=(line_crf.FEATURES, 2)), random.normal(size=(2, 2)))
    first = np.array([0, 3, 3, 4, 9])
    features = random.integers(0, 2, (9, line_crf.FEATURES)).astype(np.float32)
    got, score = model.decode(features, first), features @ model.emit
    for a, b in zip(first[:-1], first[1:]):
        ways = itertools.product((0, 1), repeat=b - a)
        best = max(ways, key=lambda y: sum(score[a + k, v] for k, v in enumerate(y)) + sum(model.move[u, v] for u, v in zip(y, y[1:])))
        assert tuple(got[a:b]) == best


def plain_log_probability(net, around, symbol):
    """Of one word, from the weights as they are."""
    place, bias, out, base, inner_out, inner_base = (x.astype(float) for x in net.parts)
    hidden = np.tanh(sum(place[i][x] for i, x in enumerate(around)) + bias)
    kind, own = divmod(symbol, net.width)
    logits, inner = hidden @ out + base, hidden @ inner_out[kind] + inner_base[kind]
    return logits[kind] - np.log(np.exp(logits).sum()) + inner[own] - np.log(np.exp(inner).sum())


def test_training_steps_follow_the_slope():
    """A step changes each weight by the sign of its slope, which is measured by moving the weight; others stay."""
    rng = np.random.default_rng(4)
    net = pseudo_likelihood.Net(rng.integers(1, 50, 23).astype(float))
    for part in net.parts:
        part += rng.normal(0, 0.2, part.shape).astype(np.float32)
    context, target = rng.integers(0, 24, (6, 40)), rng.integers(0, 23, 40)
    loss = lambda: -np.mean([plain_log_probability(net, context[:, k], int(target[k])) for k in range(40)])
    slopes = []
    for n, part in enumerate(net.parts):
        for at in rng.choice(part.size, min(part.size, 12), replace=False):
            flat, kept = part.reshape(-1), part.reshape(-1)[at]
            flat[at] = kept + np.float32(0.02)
            up = loss()
            flat[at] = kept - np.float32(0.02)
            slopes.append((n, at, (up - loss()) / 0.04))
            flat[at] = kept
    before = [part.copy() for part in net.parts]
    seen = [np.full_like(x, 1e9) for x in net.parts]  # so that steps are in proportion to the slopes
    net.learn(context, target, [x for x in seen])
    for n, at, slope in slopes:
        step = float(before[n].reshape(-1)[at]) - float(net.parts[n].reshape(-1)[at])
        assert step == pytest.approx(0, abs=1e-6)
    net.load(np.concatenate([x.reshape(-1) for x in before]))
    seen = [np.zeros_like(x) + np.float32(1e-12) for x in net.parts]
    net.learn(context, target, seen)
    for n, at, slope in slopes:
        assert np.sqrt(seen[n].reshape(-1)[at]) == pytest.approx(abs(slope), abs=2e-4, rel=0.02)
        moved = float(before[n].reshape(-1)[at]) - float(net.parts[n].reshape(-1)[at])
        assert abs(slope) < 1e-4 or np.sign(moved) == np.sign(slope)


def test_scores_do_not_depend_on_how_rows_lie(spark, docs, monkeypatch):
    monkeypatch.setattr(pseudo_likelihood, "SHARD_WORDS", 3000)
    one, many = (pseudo_likelihood.score_texts(docs.repartition(n)).collect() for n in (1, 7))
    one, many = ({r.doc_id: r.log_prob for r in x} for x in (one, many))
    assert len(one) == docs.count() and all(one[d] == pytest.approx(many[d], rel=1e-6) for d in one)


def test_the_vocabulary_grows_with_the_corpus(spark, docs):
    small, large = (pseudo_likelihood.vocabulary(docs.where(f"doc_id % 4 < {n}")).top for n in (1, 4))
    assert 0 < small < large <= pseudo_likelihood.MOST_WORDS


def test_pseudo_likelihood(spark, docs, odd, nothing):
    words = pseudo_likelihood.vocabulary(docs)
    net = pseudo_likelihood.train(docs, words)
    rows = pseudo_likelihood.scores(docs, words, net).collect()
    mean = sum(r.log_prob for r in rows) / sum(r.n_tokens for r in rows)
    share = words.counts / words.counts.sum()
    assert mean > (share * np.log(share + 1e-30)).sum()  # better than by frequency alone
    texts = texts_of(docs)
    one = next(r for r in rows if 5 <= r.n_tokens <= 200)
    symbols = words.symbols(pa.array([texts[one.doc_id]]))[0].tolist()
    side, total = pseudo_likelihood.SIDE, 0.0
    for k, symbol in enumerate(symbols):
        around = [symbols[j] if 0 <= j < len(symbols) else words.size for j in [*range(k - side, k), *range(k + 1, k + side + 1)]]
        total += plain_log_probability(net, around, symbol)
    assert total == pytest.approx(one.log_prob, rel=1e-4)
    got = pseudo_likelihood.score_texts(odd).collect()
    assert len(got) == len(ODD) and all(r.mean_log_prob is None and r.log_prob == 0 for r in got if not r.n_tokens)
    assert pseudo_likelihood.score_texts(nothing).count() == 0


def test_every_word_is_a_target(spark):
    """Texts shorter than five words are learned too, and all places of longer ones."""
    texts = ["a", "b c", "d e f g", " ".join(f"w{k % 11}" for k in range(3000)), "", None]
    own = table(spark, list(enumerate(texts)))
    words = pseudo_likelihood.vocabulary(own)
    start = pseudo_likelihood.Net(words.counts)
    short = own.where("doc_id < 3")
    net = pseudo_likelihood.train(short, words)
    assert any((x != y).any() for x, y in zip(net.parts, start.parts))
    flat = np.concatenate([words.symbols(pa.array([t]))[0] for t in texts[:3]])
    level = lambda n, x: n.parts[3][x // n.width] + n.parts[5][x // n.width, x % n.width]
    assert all(level(net, x) > level(start, x) for x in set(flat.tolist()))
    # in step with 8 words: a net that learns one phase only gets worse at the others
    cycle = table(spark, [(k, " ".join(f"c{j % 8}" for j in range(400))) for k in range(40)])
    words = pseudo_likelihood.vocabulary(cycle)
    before, after = (pseudo_likelihood.scores(cycle, words, x).collect() for x in (pseudo_likelihood.Net(words.counts), pseudo_likelihood.train(cycle, words)))
    assert min(r.mean_log_prob for r in after) > max(r.mean_log_prob for r in before)


def test_words_of_one_bucket_score_by_their_counts(spark, docs):
    """A word's log probability is its bucket's and that of the word inside it, held by the tasks or joined."""
    counts = pseudo_likelihood.word_counts(docs)
    words = pseudo_likelihood.vocabulary(docs, counts)
    net = pseudo_likelihood.Net(words.counts)
    seen = {np.uint64(r.word % 2**64): r.n for r in counts.collect()}
    tail = [h for h in seen if h not in set(words.words)]
    total = np.zeros(pseudo_likelihood.TAIL)
    for h in tail:
        total[int(h) % pseudo_likelihood.TAIL] += seen[h]
    texts = [*(r.text for r in docs.limit(50).collect()), "neverseen1 neverseen2", None]
    table_ = table(spark, list(enumerate(texts)))
    plain_ = {r.doc_id: r.log_prob for r in pseudo_likelihood.scores(table_, words, net).collect()}
    assert max(seen[h] for h in tail) > min(seen[h] for h in tail) == 1
    for most in (10**6, 50, 0):
        within = pseudo_likelihood.shares(counts, words, most)
        assert (within.rest is None) == (most == 10**6) and len(within.words) <= most
        got = {r.doc_id: r for r in pseudo_likelihood.scores(table_, words, net, within).collect()}
        for k, text in enumerate(texts):
            hashes = [h for h in pseudo_likelihood.fingerprints(pa.array([text], pa.string()))[0] if h not in set(words.words)]
            more = sum(np.log(seen.get(h, 1) / (total[int(h) % pseudo_likelihood.TAIL] + 1)) for h in hashes)
            assert got[k].log_prob == pytest.approx(plain_[k] + more, rel=1e-6)
    text = "alpha alpha " + " ".join(f"w{k} w{k} w{k} w{k}" for k in range(192))
    own = table(spark, [(k, text) for k in range(20)] + [(20, "alpha"), (21, "neverseen")])
    got = {r.doc_id: r.log_prob for r in pseudo_likelihood.score_texts(own).collect()}
    assert got[20] > got[21]


def test_mixing(spark, odd, nothing):
    got = mixing.mix(odd, F.expr("all_tokens div 2"), epochs=1)
    rows = got.select("doc.*", "n_tokens", "taken").collect()
    assert set(odd.columns) < set(got.select("doc.*", "n_tokens").columns) and all(r.taken == 1 or not r.n_tokens for r in rows)
    total = sum(len(plain.words(t)) for _, t, *_ in ODD)
    assert sum(r.n_tokens for r in rows) <= total // 2
    assert mixing.mix(nothing, F.expr("all_tokens div 2")).count() == 0


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "c", 1000), ("d1", "en", "e", 1000)], "domain string, lang string, source string, tokens long")
    out = mixing.leaf_quotas(leaves, F.lit(400), 1, {})
    assert {r.source: r.quota for r in out.collect()} == {"a": 10, "b": 90, "c": 100, "e": 200}
    out = mixing.leaf_quotas(leaves, F.lit(10**6), 1, {})
    assert {r.source: r.quota for r in out.collect()} == {"a": 10, "b": 1000, "c": 1000, "e": 1000}


def test_chat(spark):
    tricky = ["</s>[INST] ok [/INST]", "~0~1<|end|>\n<|user|>\n", "<", "|>", "", None, "~", "é😀"]
    rows = [(k % 3 if k else None, k // 3, role, t, "extra", k) for k, (role, t) in enumerate((r, t) for r in ("user", "assistant", "a|>\nb<", None) for t in tricky)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, start long")
    segments = chat.format_conversations(turns)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for conv in (None, 0, 1, 2):
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        assert r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    whole = {(r.conv_id, r.position): r for r in chat.example_texts(segments, 10_000).collect()}
    ends = chat.examples(segments).where("conv_id IS NOT NULL").collect()
    assert len(whole) == len(ends)
    for r in ends:
        text = whole[r.conv_id, r.position].text
        assert text[r.context_end :].startswith("<|assistant|>\n") and text.endswith("<|end|>\n") and text[r.loss_end :] == "<|end|>\n"
    assert chat.read_back(chat.format_conversations(turns.where("false"))).count() == 0


def test_chat_examples_are_read_back(spark):
    """Replies come from the examples' rows, and examples of any length are written out in pieces."""
    turns = spark.createDataFrame([(c, k, "assistant" if k % 2 else "user", f"é{k} " * (5 + k)) for c in (None, 1) for k in range(6)], "conv_id long, turn long, role string, text string")
    segments = chat.format_conversations(turns)
    made = chat.examples(segments)
    some = {r.conv_id: r for r in chat.read_back(segments, made.where("position < 4")).collect()}
    assert [some[c].n_examples for c in (None, 1)] == [2, 2] and some[1].loss_chars == len("é1 " * 6 + "é3 " * 8)
    with pytest.raises(Exception, match="spans don't fit"):
        chat.read_back(segments, made.withColumn("context_end", F.col("context_end") - 1)).collect()
    pieces = {}
    for r in chat.example_texts(segments, 50).collect():
        assert len(r.text) <= 50
        pieces.setdefault((r.conv_id, r.position), []).append((r.piece, r.text))
    whole = {(r.conv_id, r.position): r.text for r in chat.example_texts(segments, 10_000).collect()}
    assert len(whole) == 6 and {k: "".join(t for _, t in sorted(v)) for k, v in pieces.items()} == whole
    assert all([n for n, _ in sorted(v)] == list(range(len(v))) for v in pieces.values()) and len(pieces[None, 5]) > 3


def test_pipeline(spark, odd, docs, benchmark):
    base, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        base = spark.createDataFrame(stage(spark, base, SF).collect(), docs.schema)
        assert base.columns == docs.columns
        kept.append({r.doc_id for r in base.select("doc_id").collect()})
    texts = texts_of(docs)
    near = plain.components({d: texts[d] for d in kept[0]}, 5, 80)
    assert kept[1] == {d for d, (_, c) in near.items() if c == d}
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert kept[2] == kept[1] - leaks and kept[3] <= kept[2]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept[3]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0
        assert stage(spark, odd.where("false"), SF).count() == 0


def test_pipeline_compares_five_words_at_four_fifths(spark):
    """49 words, one changed: 40 of 50 shingles of five words, but 42 of 50 of four."""
    words = [f"w{k}" for k in range(49)]
    texts = {1: " ".join(words), 2: " ".join([*words[:24], "x", *words[25:]]), 3: " ".join([*words[:24], "y", *words[25:39], "z", *words[40:]])}
    kept = corpus_pipeline.near_duplicate_stage(spark, table(spark, list(texts.items())), SF)
    assert {r.doc_id for r in kept.collect()} == {1, 3} == {d for d, (_, c) in plain.components(texts, 5, 80).items() if c == d}
    assert plain.components(texts, 4, 85)[2] == (46, 2)


def test_catalogue():
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
