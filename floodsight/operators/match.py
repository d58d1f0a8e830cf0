"""Rule matching: first match wins, with fall-through past `next` rules.

A rule is known by one LONG, its `rule_id`: the book it stands in, its list and its number. A book is one version of one
ruleset. Each book is walked on its own, so rules of any number of rulesets and versions can lie in one table; a book with a
time span meets the packets of that span only.

Three ways with one answer, by size of the rule table:

* compiled: rules become constants in generated code; row-local, no join, no shuffle;
* indexed: rules lie in broadcast tables by the prefix of their narrower side; row-local, no packet shuffle;
* joined: for rule tables past the broadcast bound; shuffles by prefix or salt, and by packet.

The last two test rules of a book with the same tests once, by one code for those that go on. What such a code stands for is
looked up after the hits are cut, so ids of crowded tests are neither collected nor sorted nor stored for each packet.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from floodsight.functions.predicates import compiled_match, flags_match, packet_value, range_tests, rule_columns_match, rule_range, time_range, time_value
from floodsight.operators.generated import own_method
from floodsight.schemas import PROTO, RULE_TESTS, TYPE_ORDER
from floodsight.session import broadcast_if_small, settle

# rule_id = book, two bits for the list, 31 bits for the rule number, so that ids sort as books and lists do.
LIST_SHIFT = 31
BOOK_SHIFT = 33
MOST_BOOKS = 2**30
COMPILED_RULES = 256
# Rules per generated projection.
CHUNK = 32
INDEX_ENTRIES = 200_000
# Levels of the index that a packet is looked up in, and the widest range that gets a place, in bits.
LEVELS = 16
WIDEST_BITS = 24
# The span of rules whose time has an open end, or that have none.
OPEN = -1
# Rules of one key that are tested by generated code.
LANES = 4
# Keys per protocol over which the packets are spread that meet the rules without a place.
SALTS = 64
# Rules of one list of the join, and ids in one row of those with the same tests.
LISTED = 256
CODES = 256


def rule_id_of(rule_type: Column, rule_no: Column, book: Column | int = 0) -> Column:
    rank = F.lit(None).cast("bigint")
    for position, name in enumerate(TYPE_ORDER):
        rank = F.when(rule_type == name, F.lit(position).cast("bigint")).otherwise(rank)
    book = (F.lit(book) if isinstance(book, int) else book).cast("bigint")
    beyond = F.raise_error(F.concat(F.lit("book number out of range: "), book.cast("string"))).cast("bigint")
    book = F.when(book.between(0, MOST_BOOKS - 1), book).otherwise(beyond)
    return F.shiftleft(book, BOOK_SHIFT) + F.shiftleft(rank, LIST_SHIFT) + rule_no.cast("bigint")


def with_rule_id(rules: DataFrame) -> DataFrame:
    book = F.col("book") if "book" in rules.columns else 0
    return rules.withColumn("rule_id", rule_id_of(F.col("rule_type"), F.col("rule_no"), book))


def book_of(rule_id: Column) -> Column:
    return F.shiftright(rule_id, BOOK_SHIFT)


def with_rule_names(df: DataFrame, book: bool = False) -> DataFrame:
    """`rule_id` back to `rule_type` and `rule_no`, and to `book` if that is wanted."""
    rank = F.shiftright("rule_id", LIST_SHIFT).bitwiseAND(F.lit(3)).cast("int")
    names = F.array(*map(F.lit, TYPE_ORDER))
    columns = {"rule_type": F.get(names, rank), "rule_no": F.col("rule_id").bitwiseAND(F.lit(2**LIST_SHIFT - 1)).cast("int")}
    if book:
        columns["book"] = book_of(F.col("rule_id"))
    return df.withColumns(columns).drop("rule_id")


def spans(rule) -> bool:
    return "from_us" in rule


def in_force(ts: Column, from_us: Column, to_us: Column) -> Column:
    """Whether a packet's time lies in the span of a book; a missing end is open."""
    micros = F.unix_micros(ts)
    return (from_us.isNull() | (micros >= from_us)) & (to_us.isNull() | (micros < to_us))


@dataclass
class RuleSet:
    """Rules on the driver, in list order; at most `COMPILED_RULES` of them."""

    rows: list[Row]

    def only(self, rule_type: str) -> "RuleSet":
        return RuleSet([row for row in self.rows if row["rule_type"] == rule_type])

    def of_type(self, rule_type: str) -> list[tuple[int, Row]]:
        rank = TYPE_ORDER.index(rule_type)
        return [((_book(row) << BOOK_SHIFT) + (rank << LIST_SHIFT) + row["rule_no"], row) for row in self.rows if row["rule_type"] == rule_type]

    def books(self) -> "list[RuleSet]":
        """One ruleset for each book."""
        numbers = sorted({_book(row) for row in self.rows})
        return [RuleSet([row for row in self.rows if _book(row) == number]) for number in numbers]


def _book(row: Row) -> int:
    return row["book"] if "book" in row else 0


def collect_rules(rules: DataFrame, limit: int = COMPILED_RULES) -> RuleSet | None:
    """Bring a small rule table to the driver, or None when it has more than `limit` rows."""
    rows = rules.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return RuleSet(sorted(rows, key=lambda r: (_book(r), TYPE_ORDER.index(r["rule_type"]), r["rule_no"])))


def _by_proto(choices: dict[str, Column]) -> Column | None:
    result = None
    for rule_type, value in choices.items():
        if value is not None:
            test = F.col("proto") == PROTO[rule_type]
            result = F.when(test, value) if result is None else result.when(test, value)
    return result


def _chain(items: list[tuple[Column, Column]]) -> Column | None:
    result = None
    for test, value in items:
        result = F.when(test, value) if result is None else result.when(test, value)
    return result


# Zero never matches an enabled range, so NULL may be read as 0 there; it saves the NULL checks.
_ZERO_FOR_NULL = ["src_ip", "dst_ip", "sport", "dport"]


def _with_plain(packets: DataFrame) -> DataFrame:
    return packets.withColumns({f"_{name}": F.coalesce(F.col(name), F.lit(0)) for name in _ZERO_FOR_NULL})


def _without_plain(df: DataFrame) -> DataFrame:
    return df.drop(*[f"_{name}" for name in _ZERO_FOR_NULL])


def _packet_field(name: str) -> Column:
    return F.col(f"_{name}") if name in _ZERO_FOR_NULL else F.col(name)


def _chunks(tests: dict[str, list], size: int = CHUNK) -> list[dict[str, list]]:
    """The n-th chunk of every list side by side."""
    longest = max(map(len, tests.values()), default=0)
    return [{name: items[at : at + size] for name, items in tests.items()} for at in range(0, longest, size)]


def _reachable(ruleset: RuleSet) -> Column:
    """A test that every matching packet passes, simple enough for the file scan to use."""
    result = F.lit(False)
    for rule_type in TYPE_ORDER:
        rows = [row for _, row in ruleset.of_type(rule_type)]
        if rows:
            test = F.col("proto") == PROTO[rule_type]
            for side in ("src", "dst"):
                if all(row[f"{side}_lo"] is not None for row in rows):
                    lo = max(1, min(row[f"{side}_lo"] for row in rows))
                    hi = max(row[f"{side}_hi"] for row in rows)
                    test &= F.col(f"{side}_ip").between(lo, hi)
            result |= test
    starts = [row["from_us"] for row in ruleset.rows if spans(row)]
    if starts and len(starts) == len(ruleset.rows) and None not in starts:
        result &= F.col("ts") >= F.timestamp_micros(F.lit(min(starts)))
    return result


def _test(row: Row) -> Column:
    """The tests of one rule as constants, with the span of its book."""
    test = compiled_match(row, _packet_field)
    if spans(row):
        for bound, holds in ((row["from_us"], lambda t: F.col("ts") >= t), (row["to_us"], lambda t: F.col("ts") < t)):
            if bound is not None:
                test = holds(F.timestamp_micros(F.lit(bound))) & test
    return test


def route_proto(packets: DataFrame) -> DataFrame:
    """Add `rule_type`, the list a packet goes to; packets of other protocols go to none and are dropped."""
    rule_type = _by_proto({name: F.lit(name) for name in TYPE_ORDER})
    return packets.filter(F.col("proto").isin(list(PROTO.values()))).withColumn("rule_type", rule_type)


def with_stop(packets: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Add `stop_rule`: the id of the terminal rule that took the packet, or NULL; with several books the first one's that took it."""
    df, stops = _with_stops(_with_plain(packets), ruleset)
    first = F.coalesce(*map(F.col, stops)) if stops else F.lit(None).cast("bigint")
    return _without_plain(df.withColumn("stop_rule", first).drop(*stops))


def _with_stops(df: DataFrame, ruleset: RuleSet) -> tuple[DataFrame, list[str]]:
    """Add a column per book: the id of its terminal rule that took the packet."""
    names = []
    for n, book in enumerate(ruleset.books()):
        names.append(f"_stop{n}")
        df = _stop_column(df, book, names[-1], apart=len(ruleset.rows) > CHUNK)
    return df, names


def _stop_column(df: DataFrame, ruleset: RuleSet, column: str, apart: bool) -> DataFrame:
    ends = {name: [(_test(row), F.lit(i)) for i, row in ruleset.of_type(name) if not row["next_rule"]] for name in TYPE_ORDER}
    chunks = _chunks(ends)
    if not chunks:
        return df.withColumn(column, F.lit(None).cast("bigint"))
    for step, chunk in enumerate(chunks):
        found = _by_proto({name: _chain(items) for name, items in chunk.items()}).cast("bigint")
        if step:
            found = F.when(F.col(column).isNotNull(), F.col(column)).otherwise(found)
        df = own_method(df, {column: found}) if apart else df.withColumn(column, found)
    return df


def _with_slots(df: DataFrame, tests: dict[str, list[Column]]) -> tuple[DataFrame, list[str]]:
    """Add a column per place in the lists, holding the rule id where the test of the packet's list holds.

    A packet has one protocol, so the lists share the places.
    """
    places = max(map(len, tests.values()), default=0)
    names = [f"_slot{place}" for place in range(places)]
    for at in range(0, places, CHUNK):
        columns = {}
        for place in range(at, min(at + CHUNK, places)):
            choices = {name: items[place] for name, items in tests.items() if place < len(items)}
            columns[names[place]] = _by_proto(choices).cast("bigint")
        df = own_method(df, columns) if places > CHUNK else df.withColumns(columns)
    return df, names


def _explode_hits(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column that holds an id. The array has no place for the others: ids are never negative."""
    hits = F.array_remove(F.array(*[F.coalesce(name, F.lit(-1).cast("bigint")) for name in columns]), F.lit(-1).cast("bigint"))
    return _without_plain(df.withColumn("rule_id", F.explode(hits)).drop(*columns))


def first_match(packets: DataFrame, ruleset: RuleSet) -> DataFrame:
    """One row per (packet, rule that counts it), as `rule_id` next to the packet's columns."""
    df, stops = _with_stops(_with_plain(packets.filter(_reachable(ruleset))), ruleset)
    passed: dict[str, list[Column]] = {name: [] for name in TYPE_ORDER}
    for stop, book in zip(map(F.col, stops), ruleset.books()):
        for name in TYPE_ORDER:
            passed[name] += [
                F.when((stop.isNull() | (stop > i)) & _test(row), F.lit(i)) for i, row in book.of_type(name) if row["next_rule"]
            ]
    df, slots = _with_slots(df, passed)
    if len(stops) == 1 and not slots:
        return _without_plain(df.filter(F.col(stops[0]).isNotNull()).withColumnRenamed(stops[0], "rule_id"))
    return _explode_hits(df, [*stops, *slots]) if stops else _without_plain(df.withColumn("rule_id", F.lit(None).cast("bigint")).limit(0))


def all_matches(packets: DataFrame, ruleset: RuleSet) -> DataFrame:
    """One row per (packet, matching rule), as if every rule had `next`."""
    tests = {name: [F.when(_test(row), F.lit(i)) for i, row in ruleset.of_type(name)] for name in TYPE_ORDER}
    df, slots = _with_slots(_with_plain(packets.filter(_reachable(ruleset))), tests)
    return _explode_hits(df, slots)


def captured(packets: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Packets ended by a terminal rule."""
    ended = with_stop(packets.filter(_reachable(ruleset)), ruleset)
    return ended.filter("stop_rule IS NOT NULL").drop("stop_rule")


def unmatched(packets: DataFrame, ruleset: RuleSet) -> DataFrame:
    """Packets no terminal rule ended, those of other protocols included."""
    return with_stop(packets, ruleset).filter("stop_rule IS NULL").drop("stop_rule")


# --- rule tables too long to compile -------------------------------------------------------

_RULE_FIELDS = ["rule_id", "next_rule", *[f.name for f in RULE_TESTS.fields]]
_PORT_BITS = 16


@dataclass(frozen=True, order=True)
class Level:
    """A table of the index: rules keyed by `side` at the prefix that leaves `shift` bits (not by address if it is `any`), by
    destination port if `port`, and by the prefix of the Unix second that leaves `span` bits, unless that is OPEN."""

    side: str
    shift: int
    port: bool
    span: int

    def key(self, address: Column, dport: Column, rank: Column) -> Column:
        """Protocol, prefix and port in one LONG."""
        key = F.shiftleft(rank.cast("bigint"), 32) + (F.lit(0) if self.side == "any" else F.shiftright(address, self.shift))
        return F.shiftleft(key, _PORT_BITS) + dport if self.port else key

    def packet_key(self) -> Column:
        address = F.lit(0) if self.side == "any" else F.col(f"{self.side}_ip")
        return self.key(address, F.col("dport").cast("bigint"), F.col("proto"))

    def when(self, second: Column) -> Column:
        """The time prefix; 0 for rules whose time has an open end."""
        return F.lit(0).cast("bigint") if self.span == OPEN else F.shiftright(second, self.span)


def placed_rules(rules: DataFrame) -> DataFrame:
    """Rules with `proto`, `rule_id` and their place: the narrower side (`side`), how many bits its range spans (`shift`),
    whether they ask for one destination port (`port`) and how many bits the seconds of their time span (`span`, see OPEN). Rules
    that are wide on both sides have `any` side if their time has both ends, and none otherwise. Rules with an empty range or
    an empty time match nothing and are left out.
    """
    df = with_rule_id(rules)
    proto = F.lit(None).cast("int")
    for name, number in PROTO.items():
        proto = F.when(F.col("rule_type") == name, F.lit(number)).otherwise(proto)

    def alive(side):
        return F.col(f"{side}_lo").isNull() | ((F.col(f"{side}_hi") >= F.col(f"{side}_lo")) & (F.col(f"{side}_hi") > 0))

    def bits(side):
        wide = F.col(f"{side}_hi") - F.col(f"{side}_lo")
        return F.when(F.col(f"{side}_lo").isNull(), F.lit(33)).when(wide > 0, F.length(F.bin(wide))).otherwise(F.lit(0))

    df = df.filter(alive("src") & alive("dst")).withColumns({"proto": proto, "_src": bits("src"), "_dst": bits("dst")})
    span = F.lit(OPEN)
    if "from_us" in rules.columns:
        df = df.filter("from_us IS NULL OR to_us IS NULL OR to_us > from_us")
        first, last = _seconds_in_force()
        span = F.when(first.isNull() | last.isNull(), span).when(last > first, F.length(F.bin(last - first))).otherwise(F.lit(0))
    df = df.withColumn("span", span)
    wide = F.least("_src", "_dst") > WIDEST_BITS
    side = F.when(wide & (F.col("span") == OPEN), F.lit(None)).when(wide, F.lit("any")).when(F.col("_src") < F.col("_dst"), F.lit("src")).otherwise(F.lit("dst"))
    port = F.coalesce((F.col("dport_lo") == F.col("dport_hi")) & (F.col("dport_lo") > 0), F.lit(False))
    shift = F.when(wide, F.lit(0)).otherwise(F.least("_src", "_dst"))
    return df.withColumns({"side": side, "shift": shift, "port": port}).drop("_src", "_dst")


def _seconds_in_force() -> tuple[Column, Column]:
    """The first and the last Unix second of a rule's time."""
    return F.unix_seconds(F.timestamp_micros("from_us")), F.unix_seconds(F.timestamp_micros(F.col("to_us") - 1))


def _levels(placed: DataFrame) -> tuple[list[Level], DataFrame]:
    """The levels that occur, and the rules with the level (`level`), the keys (`keys`) and the time prefixes (`whens`) they are
    listed under.

    A range that spans n bits lies under one or two prefixes that leave n, and so does a span of time. Beyond LEVELS levels both
    are rounded up to whole bytes, which leaves LEVELS at most without times.
    """
    found = _occurring(placed)
    if len(found) > LEVELS:
        placed = placed.withColumn("shift", (F.ceil(F.col("shift") / 8) * 8).cast("int"))
        placed = placed.withColumn("span", F.when(F.col("span") == OPEN, F.col("span")).otherwise(F.ceil(F.col("span") / 8) * 8).cast("int"))
        found = _occurring(placed)
    # One expression for all levels; one for each of them would be beyond what the JVM compiles.
    place = ["side", "shift", "port", "span"]
    known = F.array(*[F.struct(*[F.lit(value).alias(name) for name, value in zip(place, (x.side, x.shift, x.port, x.span))]) for x in found]) if found else None
    number = F.array_position(known, F.struct(*place)).cast("int") - 1 if found else F.lit(None).cast("int")
    ends = [F.when(F.col("side") == "src", F.col(f"src_{end}")).when(F.col("side") == "dst", F.col(f"dst_{end}")) for end in ("lo", "hi")]
    prefixes = [F.shiftleft(F.col("proto").cast("bigint"), 32) + _shifted(F.coalesce(end, F.lit(0)).cast("bigint"), F.col("shift")) for end in ends]
    keys = [F.when(F.col("port"), F.shiftleft(prefix, _PORT_BITS) + F.col("dport_lo")).otherwise(prefix) for prefix in prefixes]
    times = [F.when(F.col("span") == OPEN, 0).otherwise(_shifted(second, F.col("span"))) for second in _seconds_in_force()] if "from_us" in placed.columns else [F.lit(0).cast("bigint")]
    placed = placed.withColumns({"level": number, "keys": F.array_distinct(F.array(*keys)), "whens": F.array_distinct(F.array(*times))})
    return found, placed.withColumns({name: F.when(F.col("side").isNotNull(), F.col(name)) for name in ("level", "keys", "whens")})


def _shifted(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _occurring(placed: DataFrame) -> list[Level]:
    return sorted(Level(*row) for row in placed.filter("side IS NOT NULL").select("side", "shift", "port", "span").distinct().collect())


def index_entries(rules: DataFrame) -> int:
    """Entries of the broadcast index: one or two for each rule with a place and tests of its own, twice as many at most with times."""
    timed = ["from_us", "to_us"] if "from_us" in rules.columns else []
    tested = _tested_rules(folded_rules(placed_rules(rules), [*_RULE_FIELDS[2:], *timed]))
    _, placed = _levels(tested.filter("side IS NOT NULL"))
    return placed.agg(F.coalesce(F.sum(F.size("keys") * F.size("whens") * F.size("codes")), F.lit(0))).first()[0]


def _unplaced(rules: DataFrame) -> DataFrame:
    """The rules that are wide on both sides and open in time; they are looked at for every packet of their protocol."""
    return placed_rules(rules).filter("side IS NULL").select(*rules.columns)


def _code(rule_id: Column, next_rule: Column) -> Column:
    """An id that goes on is written as its complement, which is negative."""
    return F.when(next_rule, F.bitwise_not(rule_id)).otherwise(rule_id)


def _id(code: Column) -> Column:
    return F.when(code < 0, F.bitwise_not(code)).otherwise(code)


def first_match_indexed(packets: DataFrame, rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`first_match` against a rule table of at most `INDEX_ENTRIES` index entries and `COMPILED_RULES` rules that are wide on
    both sides (checked).

    A packet is looked up once for each level that occurs, by one LONG. The rules of a key are dealt to lanes, so that a lane
    has one rule a key and its tests are generated code, with only the tests that occur there; a crowded key's rules beyond
    the lanes come as a list. Wide rules are compiled. With `keys` (say, `version`) each packet meets the rules that agree
    with it on them.
    """
    index = build_index(rules, keys)
    if index is None:
        raise ValueError("too many index entries or wide rules to broadcast; use first_match_joined")
    return match_index(packets, index)


@dataclass
class RuleIndex:
    """A stored table of rules by level, key and lane; what is known of each level; the wide rules; and the ids of codes that
    stand for several rules (see `_ids_of`)."""

    levels: list[Level]
    listed: DataFrame
    about: dict[int, Row]
    wide: RuleSet
    keys: list[str]
    fields: list[str]
    timed: list[str]
    ids: DataFrame | None


def build_index(rules: DataFrame, keys: list[str] | None = None) -> RuleIndex | None:
    """The index of a rule table, or None if it would be too large to broadcast. It can be used for any number of matches."""
    wide = collect_rules(_unplaced(rules))
    if wide is None:
        return None
    keys = keys or []
    timed = ["from_us", "to_us"] if "from_us" in rules.columns else []
    fields = [*_RULE_FIELDS[2:], *timed]
    folded = settle(folded_rules(placed_rules(rules), fields, keys).filter("side IS NOT NULL"), "folded-rules")
    levels, placed = _levels(_tested_rules(folded))
    placed = placed.withColumn("_when", F.explode("whens")).withColumn("_key", F.explode("keys"))
    listed = placed.select(*keys, "level", "_when", "_key", F.explode("codes").alias("code"), "rule_type", *fields)
    if listed.limit(INDEX_ENTRIES + 1).count() > INDEX_ENTRIES:
        return None
    lane = F.row_number().over(Window.partitionBy(*keys, "level", "_key", "_when").orderBy(_id(F.col("code")))) - 1
    listed = settle(listed.withColumn("lane", lane), "rule-index")
    return RuleIndex(levels, listed, _about(listed, fields), wide, keys, fields, timed, _ids_of(folded, keys))


def match_index(packets: DataFrame, index: RuleIndex) -> DataFrame:
    """`first_match` against an index."""
    levels, listed, about, wide = index.levels, index.listed, index.about, index.wide
    keys, fields, timed = index.keys, index.fields, index.timed

    found, codes, lists = packets, [], []
    listed_used = [{name for name in fields if row[name]} for row in about.values() if row["lanes"] > (0 if timed else LANES)]
    found = _with_values(found, set().union(*listed_used), timed)
    second = F.unix_seconds("ts") if timed else None
    # Times make many levels with few rules a key; these come as one list a level, for a join a lane would be a plan too long.
    lanes = 0 if timed else LANES
    for n, row in about.items():
        here = listed.filter(F.col("level") == n)
        used = {name for name in fields if row[name]}
        place = [*keys, "_key", *(["_when"] if levels[n].span != OPEN else [])]
        found = found.withColumn("_key", levels[n].packet_key())
        if "_when" in place:
            found = found.withColumn("_when", levels[n].when(second))
        for lane in range(min(row["lanes"], lanes)):
            table = here.filter(F.col("lane") == lane).select(*place, *[F.col(name).alias(f"_r_{name}") for name in ("code", *sorted(used))])
            found = found.join(F.broadcast(table), place, "left")
            hit = F.when(F.col("_r_code").isNotNull() & _rule_matches(used, timed, lambda name: F.col(f"_r_{name}")), F.col("_r_code"))
            codes.append(f"_code{n}_{lane}")
            found = own_method(found, {codes[-1]: hit}).drop(*[c for c in found.columns if c.startswith("_r_")])
        if row["lanes"] > lanes:
            rest = here.filter(F.col("lane") >= lanes).groupBy(*place).agg(F.collect_list(F.struct("code", *_range_columns(used, timed))).alias(f"_rest{n}"))
            found = found.join(F.broadcast(rest), place, "left")
            hits = F.filter(f"_rest{n}", lambda rule: _ranges_match(used, timed, rule))
            lists.append(F.when(F.col(f"_rest{n}").isNotNull(), F.transform(hits, lambda rule: rule["code"])))
    found = found.drop("_key", "_when")
    if wide.rows:
        found, slots = _wide_codes(found, wide, keys)
        codes += slots
    numbers = {book for row in about.values() for book in (row["first_book"], row["last_book"])} | {_book(row) for row in wide.rows}
    if index.ids is None and not lists and (len(numbers) <= 1 or len(codes) <= 2 * LEVELS):
        cut = _cut_codes(found, codes, len(numbers) > 1)
    else:
        cut = _with_ids(_cut_lists(found, codes, lists), index.ids, keys)
    return cut.select(*packets.columns, "rule_id")


def _about(listed: DataFrame, fields: list[str]) -> dict[int, Row]:
    """Of each level: how many lanes it has, between which books its rules lie, and which tests occur. At most LEVELS rows."""
    book = book_of(_id(F.col("code")))
    occur = [F.max(F.col(name).isNotNull()).alias(name) for name in fields]
    rows = listed.groupBy("level").agg((F.max("lane") + 1).alias("lanes"), F.min(book).alias("first_book"), F.max(book).alias("last_book"), *occur).collect()
    return {row["level"]: row for row in sorted(rows, key=lambda row: row["level"])}


def _cut_codes(found: DataFrame, codes: list[str], many: bool) -> DataFrame:
    """Hits in columns: each counts unless a terminal one of its book stands before it."""
    if not codes:
        return found.withColumn("rule_id", F.lit(None).cast("bigint")).limit(0)
    found = own_method(found, {name: F.col(name) for name in codes})
    ends = [F.when(F.col(name) >= 0, F.col(name)) for name in codes]
    kept = {}
    if many:
        for name in codes:
            own = _id(F.col(name))
            before = F.lit(False)
            for other in codes:
                if other != name:
                    before |= F.coalesce((F.col(other) >= 0) & (F.col(other) < own) & (book_of(F.col(other)) == book_of(own)), F.lit(False))
            kept[name] = F.when(~before, own)
    else:
        found = found.withColumn("_end", F.least(*ends) if len(ends) > 1 else ends[0])
        for name in codes:
            own = _id(F.col(name))
            kept[name] = F.when(F.col("_end").isNull() | (own <= F.col("_end")), own)
    none = F.lit(-1).cast("bigint")
    hits = F.array_remove(F.array(*[F.coalesce(column, none) for column in kept.values()]), none)
    return found.withColumn("rule_id", F.explode(hits))


def _cut_lists(found: DataFrame, codes: list[str], lists: list[Column]) -> DataFrame:
    """The same with some hits in lists, as `_code` next to `_ends`."""
    none, nothing = F.array().cast("array<bigint>"), F.lit(-(2**63)).cast("bigint")
    hits = [F.coalesce(part, none) for part in lists]
    if codes:
        hits.append(F.array_remove(F.array(*[F.coalesce(name, nothing) for name in codes]), nothing))
    # A generator keeps what follows from being merged with it, which would work the hits out again for each use.
    found = _with_ends(own_method(found, {"_hits": F.concat(*hits)}).filter(F.size("_hits") > 0))
    counted = F.when(F.size("_hits") == 1, F.col("_hits")).otherwise(_counted("_hits", "_ends"))
    return found.withColumn("_code", F.explode(counted))


def _with_ends(found: DataFrame) -> DataFrame:
    """Add `_ends`, the first terminal hit of each book in `_hits`."""
    # Ids sort by book, so the first terminal hit of each book is the one whose neighbour before is of another book.
    found = own_method(found, {"_sorted": F.array_sort(F.filter("_hits", lambda code: code >= 0))})
    first = F.filter("_sorted", lambda end, n: (n == 0) | (book_of(F.get("_sorted", n - 1)) != book_of(end)))
    return own_method(found, {"_ends": first}).drop("_sorted")


def _counted(hits: str, ends: str) -> Column:
    """The hits without those that stand after a terminal hit of their book."""
    after = lambda code: F.exists(ends, lambda end: (end < _id(code)) & (book_of(end) == book_of(_id(code))))
    return F.when(F.size(ends) == 0, F.col(hits)).otherwise(F.filter(hits, lambda code: ~after(code)))


def _wide_codes(df: DataFrame, wide: RuleSet, keys: list[str]) -> tuple[DataFrame, list[str]]:
    def test(row):
        agrees = _test(row)
        for key in keys:
            agrees = (F.col(key) == row[key]) & agrees
        return agrees

    tests = {name: [F.when(test(row), F.lit(~i if row["next_rule"] else i)) for i, row in wide.of_type(name)] for name in TYPE_ORDER}
    df, slots = _with_slots(_with_plain(df), tests)
    return _without_plain(df), slots


def first_match_joined(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """`first_match` for rule tables of any size.

    Packets are read once and spread by a row number made for this, so `pkt_id` may repeat or be absent, and no flood can skew
    it. They meet lists of rules in one join: at each level that occurs by its key, and the rules that are wide on both sides by
    protocol and salt. A list is tested inside its row and cut by its own terminal hits, so what goes on is one row for each
    list that was hit. Lists of a checked size are broadcast; the join with more is left to Spark, whose adaptive joins split a
    flooded address.
    """
    timed = ["from_us", "to_us"] if "from_us" in rules.columns else []
    fields = [*_RULE_FIELDS[2:], *timed]
    listed, levels, used, ids = _rule_lists(rules, fields)
    at = lambda level, place, when: F.struct(F.lit(level).alias("level"), place.cast("bigint").alias("place"), when.alias("when"))
    spark = packets.sparkSession
    spread = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = packets.filter(F.col("proto").isin(list(PROTO.values()))).withColumn("_row", F.monotonically_increasing_id()).repartition(spread, "_row")
    numbered = _with_values(numbered, used, timed)
    nowhere = F.lit(-1).cast("bigint")
    places = [at(n, F.coalesce(level.packet_key(), nowhere), F.coalesce(level.when(F.unix_seconds("ts")), nowhere)) for n, level in enumerate(levels)]
    places.append(at(-1, F.pmod(F.xxhash64("_row"), F.lit(SALTS)) + F.col("proto") * SALTS, F.lit(0).cast("bigint")))
    met = numbered.withColumn("_at", F.explode(F.array(*places))).join(broadcast_if_small(listed), "_at")
    hits = F.flatten(F.transform(F.filter("_rules", lambda rule: _ranges_match(used, timed, rule)), lambda rule: rule["codes"]))
    met = own_method(met, {"_hits": hits}).drop("_at", "_rules").filter(F.size("_hits") > 0)
    met = _with_ends(met).withColumn("_hits", _counted("_hits", "_ends"))
    met = met.withColumn("_ends", F.flatten(F.collect_list("_ends").over(Window.partitionBy("_row"))))
    met = met.withColumn("_code", F.explode(_counted("_hits", "_ends")))
    return _with_ids(met, ids, []).select(*packets.columns, "rule_id")


def _rule_matches(used: set[str], timed: list[str], rule) -> Column:
    """The tests in `used` of a rule of the packet's list, and its time."""
    test = _by_proto({name: rule_columns_match(name, F.col, rule, used) for name in TYPE_ORDER})
    if timed and used & set(timed):
        test &= in_force(F.col("ts"), *[rule(name) if name in used else F.lit(None).cast("bigint") for name in timed])
    return F.coalesce(test, F.lit(False))


def _range_columns(used: set[str], timed: list[str]) -> list[Column]:
    """The tests in `used` of a rule of a list, as ranges of numbers.

    Functions over lists are interpreted, a column at a time, so a list is tested by comparing LONGs only.
    """
    columns = []
    for name in range_tests(used):
        columns += [end.alias(f"{name}_{which}") for which, end in zip(("lo", "hi"), rule_range(name))]
    if used & set(timed):
        columns += [end.alias(f"time_{which}") for which, end in zip(("lo", "hi"), time_range(F.col("from_us"), F.col("to_us")))]
    if "flag_mask" in used:
        columns += [F.when(F.col("rule_type") == "tcp", F.col(name)).alias(name) for name in ("flag_bits", "flag_mask")]
    return columns


def _with_values(packets: DataFrame, used: set[str], timed: list[str]) -> DataFrame:
    """Add what the ranges of `_range_columns` are compared with. A join must follow, or the values would be worked out for each rule."""
    values = {f"_v_{name}": packet_value(name) for name in range_tests(used)}
    if used & set(timed):
        values["_v_time"] = time_value(F.col("ts"))
    return packets.withColumns(values)


def _ranges_match(used: set[str], timed: list[str], rule) -> Column:
    """Whether a rule of a list lets the packet through."""
    test = F.lit(True)
    for name in [*range_tests(used), *(["time"] if used & set(timed) else [])]:
        test &= (F.col(f"_v_{name}") >= rule[f"{name}_lo"]) & (F.col(f"_v_{name}") <= rule[f"{name}_hi"])
    if "flag_mask" in used:
        test &= F.coalesce(flags_match(F.col("tcp_flags"), rule["flag_bits"], rule["flag_mask"]), F.lit(False))
    return test


def folded_rules(placed: DataFrame, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rules with a place, those of one book and list with the same tests as one row with their `codes`, CODES at most.

    They are hit together, so none counts that stands after a terminal one of them: these are left out. Of them all, `_first` is
    the first, `_end` the terminal one, and `_nexts` is how many go on. Where ids stand for more than one rule `_known` is false.
    """
    keys = keys or []
    same = [*keys, "book", "rule_type", "proto", "side", "shift", "port", "span", *fields]
    goes_on = F.coalesce("next_rule", F.lit(False))
    placed = placed.withColumns({"book": book_of(F.col("rule_id")), "_next": goes_on}).filter("rule_id IS NOT NULL")
    placed = placed.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy(*keys, "rule_id")))
    together = Window.partitionBy(*same)
    end = F.min(F.when(~F.col("_next"), F.col("rule_id"))).over(together)
    alive = placed.withColumn("_end", end).filter("_end IS NULL OR rule_id <= _end")
    alive = alive.withColumns({
        "_first": F.min("rule_id").over(together), "_nexts": F.sum(F.col("_next").cast("int")).over(together),
        "_known": F.max("_many").over(together) == 1,
        "_part": F.floor((F.row_number().over(together.orderBy("rule_id")) - 1) / CODES),
    })
    whole = ["_first", "_end", "_nexts", "_known", "_part"]
    return alive.groupBy(*same, *whole).agg(F.collect_list(_code(F.col("rule_id"), F.col("_next"))).alias("codes"))


def _tested_rules(folded: DataFrame) -> DataFrame:
    """Folded rules as packets meet them: a row with two `codes` at most, the first of those that go on and the terminal one."""
    first = F.when(F.col("_nexts") > 0, F.bitwise_not("_first"))
    codes = F.when(F.col("_known"), F.array_compact(F.array(first, "_end"))).otherwise(F.col("codes"))
    return folded.filter("NOT _known OR _part = 0").withColumn("codes", codes)


def _ids_of(folded: DataFrame, keys: list[str]) -> DataFrame | None:
    """A stored table of `_code` and the `_ids` it stands for, of codes that stand for several rules; None if there are none."""
    several = folded.filter("_known AND _nexts > 1")
    ids = F.transform(F.filter("codes", lambda code: code < 0), lambda code: F.bitwise_not(code))
    listed = several.select(*keys, F.bitwise_not("_first").alias("_code"), ids.alias("_ids")).filter(F.size("_ids") > 0)
    return None if listed.isEmpty() else settle(listed, "rule-ids")


def _with_ids(met: DataFrame, ids: DataFrame | None, keys: list[str]) -> DataFrame:
    """`rule_id` for each rule that `_code` stands for, unless it stands after the terminal hit of its book in `_ends`.

    Row-local where the table of ids is small enough to be broadcast; nothing is stored or sorted for a packet's rules.
    """
    if ids is None:
        return met.withColumn("rule_id", _id(F.col("_code")))
    book = book_of(_id(F.col("_code")))
    met = met.withColumn("_stop", F.array_min(F.filter("_ends", lambda end: book_of(end) == book))).drop("_ends", "_hits")
    met = met.join(broadcast_if_small(ids), [*keys, "_code"], "left")
    met = met.withColumn("rule_id", F.explode(F.coalesce("_ids", F.array(_id(F.col("_code"))))))
    return met.filter("_stop IS NULL OR rule_id <= _stop")


def _rule_lists(rules: DataFrame, fields: list[str]) -> tuple[DataFrame, list[Level], set[str], DataFrame | None]:
    """A stored table of rule lists (`_at`, `_rules`), LISTED rules with their codes at most in each; the levels that occur; the
    columns of the tests that do; and the ids of codes that stand for several rules."""
    folded = settle(folded_rules(placed_rules(rules), fields), "folded-rules")
    row = folded.agg(*[F.max(F.col(name).isNotNull()).alias(name) for name in fields]).first()
    used = {name for name in fields if row[name]}
    levels, placed = _levels(_tested_rules(folded))
    at = lambda level, place, when: F.struct(level.alias("level"), place.cast("bigint").alias("place"), when.cast("bigint").alias("when"))
    salted = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda salt: at(F.lit(-1), salt + F.col("proto") * SALTS, F.lit(0)))
    where = F.when(F.col("level").isNull(), salted).otherwise(
        F.flatten(F.transform("keys", lambda key: F.transform("whens", lambda when: at(F.col("level"), key, when))))
    )
    timed = [name for name in ("from_us", "to_us") if name in fields]
    listed = placed.select(F.explode(where).alias("_at"), F.struct("codes", *_range_columns(used, timed)).alias("rule"))
    part = F.floor((F.row_number().over(Window.partitionBy("_at").orderBy(F.col("rule.codes")[0])) - 1) / LISTED)
    listed = listed.withColumn("_part", part).groupBy("_at", "_part").agg(F.collect_list("rule").alias("_rules")).drop("_part")
    return settle(listed, "rule-lists"), levels, used, _ids_of(folded, [])


def match_packets(packets: DataFrame, rules: DataFrame) -> DataFrame:
    """First match of `packets` against a rule table, in the way that its size calls for."""
    ruleset = collect_rules(rules)
    if ruleset is not None:
        return first_match(packets, ruleset)
    index = build_index(rules)
    return first_match_joined(packets, rules) if index is None else match_index(packets, index)
