"""Mixing sources to target weights with a budget that goes down a tree.

The tree is domain, language, source. A node's budget is shared among its children by weight; a child that
can't use its share gives the rest to its siblings, and only what a whole family can't use goes back to
the next family. A leaf can use its tokens in up to `epochs` passes. With capacities known from below this is one
share level for each level of the tree, worked out with window sums over siblings ordered by capacity per weight.

A leaf's quota is a number of whole epochs and a rest. For the rest, its texts are put in the seeded order of
the next epoch and taken from the front while their tokens fit. To find the cut without ordering a whole leaf in
one task, tokens are summed by slices of the order; only the slice that holds the cut is ordered by text.

All of it is DataFrame operations; budgets and quotas are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodsight.llm.frames import broadcast_checked, documents
from floodsight.session import settle

LEVELS = ("domain", "lang", "source")
EPOCHS, SEED = 2, 7
SLICE = 4  # hexadecimal digits of the order that name a slice
#: parts of the whole; what isn't named has weight 1
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\u000B\\f\\r]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Sources are dealt to four domains by the number at the end of their name; d0 without one."""
    number = F.regexp_extract(source, "[0-9]{1,9}$", 0).try_cast("long")
    return F.concat(F.lit("d"), F.pmod(F.coalesce(number, F.lit(0).cast("long")), F.lit(4)).cast("string"))


def weight(column: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, value in weights.items():
        out = F.when(column == name, value).otherwise(out)
    return out.cast("long")


def shares(children: DataFrame, parent: list[str], child: str, capacity: str, budget: str) -> DataFrame:
    """Add `quota` to children with columns `w` and `capacity`, and their parent's `budget`.

    Children are filled in the order of capacity per weight. The first k of them are full for the smallest k with
    which the next child's share of the rest, by weight, is within its capacity; the others share by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col(capacity) / F.col("w"), child)
    before = F.coalesce(F.sum(capacity).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = children.withColumns({"before": before, "left": left}).withColumn("rest", F.expr(f"greatest({budget} - before, 0L)"))
    fits = F.when(F.expr(f"rest * w <= {capacity} * left"), F.struct(F.col(capacity) / F.col("w"), F.col(child).alias("c"), "rest", "left"))
    ranked = ranked.withColumn("level", F.min(fits).over(Window.partitionBy(*parent)))
    shared = F.coalesce(F.expr("level.rest * w div level.left"), F.col(capacity))  # no level: all of them are full
    return ranked.withColumn("quota", F.least(F.col(capacity), shared)).drop("before", "left", "rest", "level")


def leaf_quotas(leaves: DataFrame, budget: Column, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """(domain, lang, source, tokens, quota) from leaves (domain, lang, source, tokens)."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.agg(F.sum("tokens").alias("all_tokens"))
    domains = domains.crossJoin(F.broadcast(total)).withColumn("root", F.lit(0)).withColumn("budget", budget.cast("long"))
    domains = shares(domains.withColumn("w", weight(F.col("domain"), weights.get("domain", {}))), ["root"], "domain", "capacity", "budget")
    langs = langs.join(domains.select("domain", F.col("quota").alias("budget")), "domain").withColumn("w", weight(F.col("lang"), weights.get("lang", {})))
    langs = shares(langs, ["domain"], "lang", "capacity", "budget")
    leaves = leaves.join(langs.select("domain", "lang", F.col("quota").alias("budget")), ["domain", "lang"])
    leaves = leaves.withColumn("w", weight(F.col("source"), weights.get("source", {})))
    return shares(leaves, ["domain", "lang"], "source", "capacity", "budget").select(*LEVELS, "tokens", "quota")


def mix(docs: DataFrame, budget: Column, epochs: int = EPOCHS, seed: int = SEED, weights: dict | None = None) -> DataFrame:
    """(doc, domain, n_tokens, full, taken) for each row that is taken: `doc` holds all columns of the row, `full` counts
    the whole passes over its leaf, `taken` the passes it is in.

    `docs(doc_id, text, lang, source, ...)`. Tokens are the words of the text: runs of other characters than space and
    0x09-0x0D. `budget` is an expression over `all_tokens`. Null lang or source counts as ''. Texts without words take no
    budget; they are in wherever the cut comes after them. Rows that agree in doc_id and text have the same place in the
    order and stay or go together. A text is taken whole, however long it is. An empty table gives no rows. Siblings are filled in
    the order of capacity per weight as a double; ratios that differ only beyond its 53 bits go by name.
    """
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS} if weights is None else weights
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.concat_ws("-", empty("doc_id"), F.md5(empty("text")))
    keyed = docs.select(
        F.struct("*").alias("doc"), domain_of(empty("source")).alias("domain"), empty("lang").alias("lang"), empty("source").alias("source"), words_in(F.col("text")).alias("n_tokens"), row.alias("row")
    )
    leaf = list(LEVELS)
    narrow = settle(keyed.select(*leaf, "n_tokens", "row"), "tokens")
    leaves = settle(narrow.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    quotas = leaf_quotas(leaves, budget, epochs, weights).withColumn("full", F.expr("CASE WHEN tokens = 0 THEN 0L ELSE quota div tokens END"))
    quotas = settle(quotas.select(*leaf, "full", F.expr("quota - full * tokens").alias("rest")), "quotas")
    order = F.md5(F.concat_ws("-", F.lit(seed), "full", "row"))
    placed = narrow.join(broadcast_checked(quotas), leaf).withColumn("place", order).withColumn("slice", F.substring("place", 1, SLICE))

    # tokens before each slice of the order; a leaf has at most 16^SLICE of them
    slices = placed.groupBy(*leaf, "slice", "rest").agg(F.sum("n_tokens").alias("n"))
    slices = slices.withColumn("upto", F.sum("n").over(Window.partitionBy(*leaf).orderBy("slice")))
    cut = slices.where("upto > rest").groupBy(*leaf).agg(F.min(F.struct("slice", F.expr("upto - n").alias("base"))).alias("cut"))
    cut = settle(cut.select(*leaf, F.col("cut.slice").alias("at"), F.col("cut.base").alias("base")), "cuts")
    edge = placed.join(broadcast_checked(cut), leaf).where("slice = at")
    edge = edge.groupBy(*leaf, "place", "base", "rest").agg(F.sum("n_tokens").alias("n"))
    reach = F.col("base") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("place"))
    last = edge.withColumn("reach", reach).where("reach <= rest").groupBy(*leaf).agg(F.max("place").alias("last"))
    # where nothing of the cut slice is taken, the slice's own name is below all places in it
    bounds = settle(cut.join(last, leaf, "left").select(*leaf, F.coalesce("last", "at").alias("last")), "bounds")
    rows = keyed.join(broadcast_checked(quotas), leaf).withColumn("place", order).join(broadcast_checked(bounds), leaf, "left")
    taken = F.col("full") + (F.col("last").isNull() | (F.col("place") <= F.col("last"))).cast("long")
    return rows.withColumn("taken", taken).where("taken > 0").select("doc", "domain", "n_tokens", "full", "taken")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """Half of the corpus by weight: a row for each text and pass it is taken in."""
    taken = mix(documents(spark, sf_dir), F.expr("all_tokens div 2"))
    rows = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)))
    return rows.select("doc.doc_id", "domain", "doc.lang", "doc.source", "n_tokens", "epoch")


def _case(column: str, weights: dict[str, int]) -> str:
    return f"(CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END)"


def _share_sql(name: str, source: str, parent: str, child: str, keep: str) -> str:
    """The same sharing in SQL, over `source` with columns w, capacity and budget."""
    return f"""{name}_ranked AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / w, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    sum(w) OVER (PARTITION BY {parent} ORDER BY capacity / w, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS remaining FROM {source}),
  {name}_first AS (SELECT {parent}, arg_min(greatest(budget - before, 0), before) AS rest, arg_min(remaining, before) AS remaining FROM {name}_ranked
    WHERE greatest(budget - before, 0) * w <= capacity * remaining GROUP BY {parent}),
  {name} AS (SELECT {keep}, least(capacity, coalesce((f.rest * w) // f.remaining, capacity)) AS quota FROM {name}_ranked LEFT JOIN {name}_first f USING ({parent}))"""


def mixing_sql(source: str, budget: str, epochs: int, seed: int = SEED) -> str:
    """Common table expressions up to `taken`, over `source(doc_id, text, lang, source)`."""
    return f"""keyed AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS n_tokens, coalesce(lang, '') AS l, coalesce(source, '') AS s,
    'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '[0-9]{{1,9}}$') AS BIGINT), 0) % 4) AS domain FROM {source}),
  leaves AS (SELECT domain, l, s, sum(n_tokens)::BIGINT AS tokens FROM keyed GROUP BY ALL),
  leaf_caps AS (SELECT *, tokens * {epochs} AS capacity FROM leaves),
  domain_in AS (SELECT 0 AS root, domain, sum(capacity)::BIGINT AS capacity, {_case("domain", DOMAIN_WEIGHTS)} AS w, (SELECT {budget} FROM (SELECT sum(tokens)::BIGINT AS all_tokens FROM leaves)) AS budget FROM leaf_caps GROUP BY domain),
  {_share_sql("domain_out", "domain_in", "root", "domain", "domain")},
  lang_in AS (SELECT domain, l, sum(capacity)::BIGINT AS capacity, {_case("l", LANG_WEIGHTS)} AS w, any_value(quota) AS budget FROM leaf_caps JOIN domain_out USING (domain) GROUP BY domain, l),
  {_share_sql("lang_out", "lang_in", "domain", "l", "domain, l")},
  leaf_in AS (SELECT c.*, 1 AS w, quota AS budget FROM leaf_caps c JOIN lang_out USING (domain, l)),
  {_share_sql("leaf_out", "leaf_in", "domain, l", "s", "domain, l, s, tokens")},
  quotas AS (SELECT domain, l, s, CASE WHEN tokens = 0 THEN 0 ELSE quota // tokens END AS epochs_full, quota - CASE WHEN tokens = 0 THEN 0 ELSE quota // tokens END * tokens AS rest FROM leaf_out),
  placed AS (SELECT k.*, epochs_full, rest, md5(concat_ws('-', '{seed}', epochs_full::VARCHAR, coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS o FROM keyed k JOIN quotas USING (domain, l, s)),
  taken AS (SELECT *, epochs_full + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY o) <= rest THEN 1 ELSE 0 END AS passes FROM placed)"""


OP7_SQL = f"""WITH {mixing_sql("documents", "all_tokens // 2", EPOCHS)}
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(passes::BIGINT)) AS epoch FROM taken WHERE passes > 0"""
