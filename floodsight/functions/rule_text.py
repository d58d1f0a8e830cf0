"""Rule texts: tokens, options, flags, actions, and the texts written about alarms."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag letters in bit order, and the kinds of action.
FLAG_LETTERS = ["U", "A", "P", "R", "S", "F"]
ACTION_TYPES = ["log", "script", "syslog"]

# Option names by list, with their one-letter forms. Only `next` takes no value.
BASE_OPTIONS = ["pps-th", "bps-th", "pps-th-period", "bps-th-period", "action", "comment", "next", "dstip", "srcip"]
OPTIONS = {
    "tcp": BASE_OPTIONS + ["dport", "sport", "seq", "win", "ack", "hlen", "tcp-flag"],
    "udp": BASE_OPTIONS + ["dport", "sport", "hlen"],
    "icmp": BASE_OPTIONS + ["type", "code"],
}
SHORT_OPTIONS = {"a": "action", "c": "comment", "d": "dstip", "s": "srcip"}

def tokenize(text: Column, separator: str = " ") -> Column:
    """Split on `separator`; quotes keep it, a backslash escapes; empty tokens are dropped."""
    sep = separator
    raw = F.regexp_extract_all(
        text,
        F.lit(rf"""(?s)(?:\\.|["'](?:\\.|[^"'\\])*(?:["']|$)|[^{sep}"'\\])+"""),
        F.lit(0),
    )

    def plain(token):
        token = F.regexp_replace(token, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
        return F.regexp_replace(token, r"""(?s)\\(.)|["']""", "$1")

    return F.filter(F.transform(raw, plain), lambda token: token != "")


def has_bad_escape(text: Column, separator: str = " ") -> Column:
    """A backslash may stand only before a backslash, a quote, the separator or ``n``."""
    return F.regexp_replace(text, rf"""\\[\\"'n{separator}]""", "").contains("\\")


def allowed_options(rule_type: Column) -> Column:
    """Option names of a list, as an array; empty for an unknown list."""
    allowed = None
    for name, options in OPTIONS.items():
        names = F.array(*map(F.lit, options))
        allowed = F.when(rule_type == name, names) if allowed is None else allowed.when(rule_type == name, names)
    return allowed.otherwise(F.array().cast("array<string>"))


def parse_options(tokens: Column, allowed: Column) -> Column:
    """Option tokens to struct(names, args, error).

    Long options may be shortened while they stay unambiguous, and take their value from
    ``--name=value`` or from the next token; short options from ``-dvalue`` or the next token.
    Every step below reads fields of the step before, which keeps the expressions small.
    """
    no_text = F.lit(None).cast("string")

    def split(token):
        is_long, is_short = token.rlike("(?s)^--[^=]"), token.rlike("(?s)^-[^-]")
        typed = F.when(is_long, F.regexp_extract(token, "(?s)^--([^=]+)", 1))
        inline = F.when(is_long & token.contains("="), F.regexp_extract(token, "(?s)=(.*)$", 1)).when(
            is_short & (F.length(token) > 2), F.substring(token, 3, 2147483647)
        )
        letter = F.when(is_short, F.substring(token, 2, 1))
        return F.struct(
            token.alias("token"), typed.alias("typed"), inline.alias("inline"), letter.alias("letter")
        )

    def fit(part):
        fitting = F.filter(allowed, lambda option: option.startswith(part["typed"]))
        exact = F.filter(allowed, lambda option: option == part["typed"])
        short = no_text
        for key, option in SHORT_OPTIONS.items():
            short = F.when(part["letter"] == key, F.lit(option)).otherwise(short)
        return F.struct(
            part["token"].alias("token"),
            part["inline"].alias("inline"),
            (part["typed"].isNotNull() | part["letter"].isNotNull()).alias("is_option"),
            F.when(part["letter"].isNotNull(), F.array_compact(F.array(short)))
            .when(F.size(exact) == 1, exact)
            .otherwise(fitting)
            .alias("fitting"),
        )

    def name(part):
        count = F.size(part["fitting"])
        error = (
            F.when(~part["is_option"], F.lit("bad option: "))
            .when(count == 0, F.lit("unknown option: "))
            .when(count > 1, F.lit("ambiguous option: "))
        )
        return F.struct(
            part["token"].alias("token"),
            part["inline"].alias("inline"),
            F.when(count == 1, F.get(part["fitting"], F.lit(0))).alias("name"),
            F.concat(error, part["token"]).alias("error"),
        )

    def step(state, part):
        """`wants` says that the last option still waits for its value."""
        flag = part["name"] == "next"
        fresh = ~state["wants"]
        done = flag | part["inline"].isNotNull()
        own = F.when(flag, F.lit("")).otherwise(part["inline"])
        error = F.coalesce(
            part["error"],
            F.when(flag & part["inline"].isNotNull(), F.lit("option next takes no value")),
            F.when(
                F.array_contains(state["names"], part["name"]), F.concat(F.lit("repeated option: "), part["name"])
            ),
        )
        return F.struct(
            (fresh & ~F.coalesce(done, F.lit(False))).alias("wants"),
            F.when(fresh, F.concat(state["names"], F.array(part["name"])))
            .otherwise(state["names"])
            .alias("names"),
            F.when(~fresh, F.concat(state["args"], F.array(part["token"])))
            .when(done, F.concat(state["args"], F.array(own)))
            .otherwise(state["args"])
            .alias("args"),
            F.when(state["error"].isNull() & fresh, error).otherwise(state["error"]).alias("error"),
        )

    def finish(state):
        missing = F.when(
            state["wants"], F.concat(F.lit("no value for option: "), F.get(state["names"], F.size(state["names"]) - 1))
        )
        return F.struct(
            state["names"].alias("names"),
            state["args"].alias("args"),
            F.coalesce(state["error"], missing).alias("error"),
        )

    start = F.struct(
        F.lit(False).alias("wants"),
        F.array().cast("array<string>").alias("names"),
        F.array().cast("array<string>").alias("args"),
        no_text.alias("error"),
    )
    parts = F.transform(F.transform(F.transform(tokens, split), fit), name)
    return F.aggregate(parts, start, step, finish)


def flags_parse(text: Column) -> Column:
    """``S:1,A:0`` to struct(bits, mask); the last of repeated flags wins; NULL when wrong."""
    flags = tokenize(text, ",")
    letters = "".join(FLAG_LETTERS)
    good = (F.size(flags) > 0) & F.forall(flags, lambda flag: flag.rlike(f"^[{letters}]:[01]$"))

    def bit_of(flag):
        bit = F.lit(0)
        for position, letter in enumerate(FLAG_LETTERS):
            bit = F.when(flag.startswith(letter), F.lit(1 << position)).otherwise(bit)
        return bit

    def step(state, flag):
        bit = bit_of(flag)
        cleared = state["bits"].bitwiseAND(F.bitwise_not(bit))
        return F.struct(
            F.when(flag.endswith("1"), cleared.bitwiseOR(bit)).otherwise(cleared).alias("bits"),
            state["mask"].bitwiseOR(bit).alias("mask"),
        )

    start = F.struct(F.lit(0).alias("bits"), F.lit(0).alias("mask"))
    return F.when(good, F.aggregate(flags, start, step))


def action_parse(text: Column) -> Column:
    """``type[:param]`` to struct(type, param); NULL for another type or more parts."""
    parts = tokenize(text, ":")
    param = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(F.lit(""))
    good = F.size(parts).between(1, 2) & F.get(parts, F.lit(0)).isin(ACTION_TYPES)
    return F.when(good, F.struct(F.get(parts, F.lit(0)).alias("type"), param.alias("param")))


def joined(tokens: Column) -> Column:
    """Tokens as one text, each followed by a space."""
    return F.concat(F.array_join(tokens, " "), F.lit(" "))


def alarm_text(rule_type: Column, dst: Column, comment: Column) -> Column:
    """``type|dst[|comment]``."""
    return F.concat_ws("|", rule_type, dst, F.nullif(comment, F.lit("")))
