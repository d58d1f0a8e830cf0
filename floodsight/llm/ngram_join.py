"""N-gram Jaccard join by grouped prefixes.

A text's set holds its distinct shingles of `size` words, as 64-bit fingerprints. Two sets that reach the similarity t
share at least ceil(t n) shingles, n being the larger size, and so share `common` of the first n - ceil(t n) + common
of each, in any order that all sets follow; of the smaller set fewer are enough, as it has to be matched more fully. The order puts frequent shingles last: shingles are counted over all
texts, first those that a prefix is likely to have, then all of texts that have many frequent ones among these. The
most frequent (a table of bounded size) go behind all others by their count. The table changes only how many
candidates come up, never the result.

Texts with one set are one class, and classes with the same prefix and size are one group, so exact copies and most near
copies of equal length are looked up once. Groups whose prefixes share `common` shingles are candidates. Where a shingle is
shared by CROWD groups or more, they are first compared in two stars: one around the group that has least of its own (of
copies with changes of their own that is the text they were made from) and one around a group picked at random. That links
a cluster of copies in a number of comparisons that grows with its size, not with its square. All remaining pairs between
components are then looked at, so no link between components is lost; of these, a pair is dropped at a shared shingle if what
both can share up to there and from there on is too little. Members of a group are expanded and verified by the same rule.
Every link is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floodsight.llm.components import components
from floodsight.llm.frames import broadcast_checked, documents, map_texts
from floodsight.llm.text import find_words, hash_runs, hash_spans, inside, mix, signed, text_bytes
from floodsight.session import settle

SIZE, PERCENT, COMMON = 4, 85, 2
HOT_COUNT, HOT_TOKENS = 4, 500_000
CROWD = 8


def text_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (A-Z lowered) of each text in ascending order, and where each text's begin."""
    body = text_bytes(texts)
    words = find_words(body)
    hashes = hash_spans(body.data, words.start, words.end, lower=True)
    start, text = inside(words.first, size)
    shingles = hash_runs(hashes, size)[start]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):  # a text of fewer words is one shingle of its own
        whole = np.array([_whole(hashes[words.first[i] : words.first[i + 1]]) for i in short], np.uint64)
        shingles, text = np.concatenate([shingles, whole]), np.concatenate([text, short])
    order = np.lexsort((shingles, text))
    shingles, text = shingles[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (text[1:] != text[:-1])
    shingles, text = shingles[new], text[new]
    return shingles, np.searchsorted(text, np.arange(len(words.counts) + 1))


def _whole(words: np.ndarray) -> int:
    return int(hash_runs(words, len(words))[0] ^ np.uint64(len(words)))


def _prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    least = (percent * n + 99) // 100
    return n - least + np.minimum(least, COMMON)


def _take(at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the first sizes[i] entries of each list."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(at[:-1], sizes)


def _first_shingles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The shingles from which prefixes are likely to be made, counted slice by slice."""

    def work(batch):
        sets, at = text_sets(batch.column(1), size)
        n = np.diff(at)
        wide = np.minimum(n, _prefix_sizes(n, percent) * 5 // 4 + 2)
        token, count = np.unique(sets[_take(at, wide)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(count)], ["token", "n"])

    return map_texts(docs, work, "token long, n long")


def _crowded_shingles(docs: DataFrame, crowded, size: int, percent: int) -> DataFrame:
    """All shingles of the texts whose first shingles are mostly frequent ones: members of large groups of copies.

    Only their whole sets tell the shingles that the group has in common from those of one member.
    """

    def work(batch):
        sets, at = text_sets(batch.column(1), size)
        n = np.diff(at)
        wide = np.minimum(n, _prefix_sizes(n, percent) * 5 // 4 + 2)
        text = np.repeat(np.arange(len(n)), n)
        place = _take(at, wide)
        known = np.bincount(text[place], weights=np.isin(sets[place], crowded.value), minlength=len(n))
        token, count = np.unique(sets[(known * 4 > wide)[text]], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(count)], ["token", "n"])

    return map_texts(docs, work, "token long, n long")


def _prefixes(docs: DataFrame, hot, size: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, prefix_id, prefix, set_a, set_b): equal set_a, set_b and size mean equal sets."""

    def work(batch):
        sets, at = text_sets(batch.column(1), size)
        n = np.diff(at)
        text = np.repeat(np.arange(len(n)), n)
        tokens, counts = hot.value
        place = np.searchsorted(tokens, sets)
        place[place == len(tokens)] = 0
        count = np.where(tokens[place] == sets, counts[place], 0) if len(tokens) else np.zeros(len(sets), np.int64)
        order = np.lexsort((sets, count, text))
        prefix = _prefix_sizes(n, percent)
        picked = sets[order][_take(at, prefix)]
        ends = np.concatenate([[0], np.cumsum(prefix)]).astype(np.int64)
        columns = [
            batch.column(0),
            batch.column(2),
            pa.array(n.astype(np.int64)),
            pa.array(signed(_sums(mix(picked * np.uint64(3)), ends))),
            pa.LargeListArray.from_arrays(pa.array(ends), pa.array(signed(picked))).cast(pa.list_(pa.int64())),
            *_set_names(sets, at),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "prefix_id", "prefix", "set_a", "set_b"])

    schema = "doc_id long, text_key long, n_shingles long, prefix_id long, prefix array<long>, set_a long, set_b long"
    return map_texts(docs, work, schema)


def _set_names(sets: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    return [pa.array(signed(_sums(sets, at))), pa.array(signed(_sums(mix(sets), at)))]


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def _node():
    """The class of texts with one set: what links are between, whatever doc_ids the texts have."""
    return F.xxhash64("n_shingles", "set_a", "set_b").alias("node")


def _whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of each text."""

    def work(batch):
        sets, at = text_sets(batch.column(1), size)
        lists = pa.LargeListArray.from_arrays(pa.array(at.astype(np.int64)), pa.array(signed(sets))).cast(pa.list_(pa.int64()))
        columns = [pa.array(np.diff(at).astype(np.int64)), *_set_names(sets, at), lists]
        yield pa.RecordBatch.from_arrays(columns, ["n_shingles", "set_a", "set_b", "shingles"])

    found = map_texts(docs, work, "n_shingles long, set_a long, set_b long, shingles array<long>")
    return found.select(_node(), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def ngram_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, hot_count: int = HOT_COUNT, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of `docs(doc_id, text, ...)`.

    component_id is the smallest doc_id reachable by links of at least `percent` % similarity. doc_ids are whole numbers
    (others are cast). Null, empty or blank text: no shingles and no links. Rows that share a doc_id are linked by their own
    texts, and repeated rows come back as often. A null doc_id takes part in no link and is named by itself. Other columns
    are ignored. An empty table gives an empty result.
    """
    return text_components(docs, size, percent, hot_count, hot_tokens).select("doc_id", "n_shingles", "component_id")


def text_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, hot_count: int = HOT_COUNT, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """The rows of `ngram_components` with `text_key` (xxhash64 of the text) and `component`, a number that only texts of one
    component share (null without links).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))

    def most_frequent(counted: DataFrame):
        top = counted.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_count)
        return top.orderBy(F.desc("n"), "token").limit(hot_tokens).toPandas()

    top = most_frequent(_first_shingles(docs, size, percent))
    crowded = spark.sparkContext.broadcast(np.sort(top.token[top.n >= CROWD].to_numpy(np.int64).view(np.uint64)))
    top = pd.concat([top, most_frequent(_crowded_shingles(docs, crowded, size, percent))]).groupby("token", as_index=False).n.max()
    tokens = top.token.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    hot = spark.sparkContext.broadcast((tokens[order], top.n.to_numpy(np.int64)[order]))
    prefixes = _prefixes(docs, hot, size, percent).withColumn("node", _node())
    rows = settle(prefixes.select("doc_id", "text_key", "n_shingles", "prefix_id", "node"), "sets")

    def least(n):  # shingles that a set of n has in common with any larger one it reaches the similarity with
        return F.expr(f"({percent} * {n} + 99) div 100")

    def common(n):
        return F.least(F.lit(COMMON), least(n))

    def low(n):
        return F.col(n) - F.expr(f"(2 * {percent} * {n} + {99 + percent}) div {100 + percent}") + common(n)

    both_need = F.expr(f"({percent} * (n + m) + {99 + percent}) div {100 + percent}")
    linked = "n_shingles > 0 AND doc_id IS NOT NULL"
    key = ["n_shingles", "prefix_id"]
    classes = settle(rows.where(linked).groupBy(*key, "node").agg(F.min("doc_id").alias("rep")), "classes")
    # a group is named by one of its classes
    groups = prefixes.where(linked).groupBy(*key).agg(F.min("node").alias("g"), F.first("prefix").alias("prefix"))
    groups = settle(groups, "groups")
    # the smaller or equal set of a pair is found by its first `low` shingles
    entries = groups.select(F.posexplode("prefix").alias("pos", "token"), "g", F.col("n_shingles").alias("n"))
    entries = entries.select("token", "g", "n", "pos", (F.col("pos") < low("n")).alias("lower"))
    shared = entries.groupBy("token").agg(F.count("*").alias("k"), F.count(F.when(F.col("lower"), 1)).alias("lows"))
    shared = shared.where("k > 1 AND lows > 0").select("token", "lows")
    # `known` entries stand before this one that another prefix has too; no others can be shared so far
    own = Window.partitionBy("g").orderBy("pos")
    entries = entries.join(shared, "token").withColumns({"known": F.row_number().over(own) - 1, "last": F.max("pos").over(Window.partitionBy("g")), "all_known": F.count("*").over(Window.partitionBy("g"))})
    # the centre of a cluster of copies is the text that has least of its own
    strange = F.col("last") + 1 - F.col("all_known")
    turn = F.when(F.col("lower") & (F.col("lows") >= CROWD), F.struct(strange.alias("strange"), F.xxhash64("token", "g").alias("turn"), F.col("g").alias("c"), F.col("n").alias("cn")))
    entries = settle(entries.select("token", "g", "n", "pos", "lower", "known", turn.alias("turn")), "entries")
    stars = entries.where("turn IS NOT NULL").groupBy("token").agg(F.array(F.min("turn"), F.max_by("turn", F.col("turn.turn"))).alias("stars"))
    repeated = classes.groupBy(*key).agg(F.min("node").alias("g"), F.count("*").alias("k")).where("k > 1")
    spread = settle(classes.join(repeated, key).select("g", F.col("node").alias("rep")), "members")  # of the groups with several

    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent

    def likely(pairs: DataFrame) -> DataFrame:
        """Of rows (g, h, n, m), n <= m, one for each shingle shared by the prefixes, the pairs that share enough of them:
        what they share in all is no more than that and the longer of the two rests."""
        beyond = F.greatest(F.col("n") - low("n"), least("m") - common("m"))
        enough = F.greatest(F.least(common("n"), common("m")), both_need - beyond)
        return pairs.where(fits).groupBy("g", "h", "n", "m").agg(F.count("*").alias("k")).where(F.col("k") >= enough).select("g", "h")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs, "pairs")
        live = settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "live")
        if not live.take(1):
            return pairs
        ids = settle(classes.join(live, "node").select("node", F.col("rep").alias("doc_id")), "live-ids")
        texts = docs.join(broadcast_checked(ids.select("doc_id").distinct()), "doc_id", "left_semi")
        sets = _whole_sets(texts, size).join(broadcast_checked(live), "node", "left_semi").dropDuplicates(["node"])
        return settle(_verified(pairs, settle(sets, "sets"), percent), "edges")

    arms = entries.where("lower").join(stars, "token").select("g", "n", F.explode("stars").alias("s"))
    arms = arms.select("g", F.col("s.c").alias("h"), "n", F.col("s.cn").alias("m"))
    arms = arms.where((F.col("g") != F.col("h")) & fits).select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
    inner = spread.where("g <> rep").select(F.col("g").alias("a"), F.col("rep").alias("b"))
    first = verified(_members(arms, spread).union(inner).distinct())
    label = components(first)
    named = entries.select("token", "g", "n", "pos", "lower", "known").join(broadcast_checked(label).withColumnRenamed("node", "g"), "g", "left")
    named = settle(named.select("token", "g", "n", "pos", "lower", "known", F.coalesce("component", "g").alias("comp")), "named")
    open_tokens = named.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    rest = named.join(open_tokens, "token", "left_semi")
    other = rest.select("token", *[F.col(old).alias(new) for old, new in (("g", "h"), ("n", "m"), ("comp", "comp2"), ("lower", "also"), ("pos", "pos2"), ("known", "known2"))])
    smaller = "lower AND comp <> comp2 AND (n < m OR n = m AND g < h AND also)"
    # two sets share no more than what is known before a shared shingle, and what is left from there on
    near = F.least("known", "known2") + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("pos2")) >= both_need
    pairs = likely(rest.where("lower").join(other, "token").where(smaller).where(near & fits).select("g", "h", "n", "m"))
    # members of a group go by their own components: only those that are still apart are compared
    parts = spread.join(broadcast_checked(label).withColumnRenamed("node", "rep"), "rep", "left")
    parts = settle(parts.select("g", "rep", F.coalesce("component", "rep").alias("comp")), "parts")
    torn = parts.groupBy("g").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("g")
    torn = parts.join(torn, "g", "left_semi")
    within = torn.alias("s").join(torn.alias("t"), (F.col("s.g") == F.col("t.g")) & (F.col("s.comp") != F.col("t.comp")) & (F.col("s.rep") < F.col("t.rep")))
    more = _members(pairs, spread).union(within.select(F.col("s.rep").alias("a"), F.col("t.rep").alias("b"))).distinct()
    for side in ("a", "b"):
        more = more.join(broadcast_checked(label).select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    more = verified(more.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b"))
    if more.take(1):
        label = components(first.union(more))
    final = classes.join(label, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    final = settle(final, "final")
    smallest = final.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = final.join(smallest, "component").select("node", "component", "component_id")
    out = rows.where(linked).join(final, "node").select("doc_id", "n_shingles", "component_id", "text_key", "component")
    alone = rows.where(f"NOT coalesce({linked}, false)")
    return out.union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key", F.lit(None).cast("long").alias("component")))


def _members(pairs: DataFrame, spread: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes for pairs (g, h) of groups: each with all members of both groups."""
    left = pairs.join(spread.select("g", F.col("rep").alias("a")), "g", "left")
    both = left.join(spread.select(F.col("g").alias("h"), F.col("rep").alias("b")), "h", "left")
    return both.select(F.coalesce("a", "g").alias("a"), F.coalesce("b", "h").alias("b"))


def op9_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir))
