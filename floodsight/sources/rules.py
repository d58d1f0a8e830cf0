"""Rule texts to a rules table and a table of rejected lines."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floodsight.functions.addresses import cidr_range, port_range
from floodsight.functions.rule_text import (
    action_parse,
    allowed_options,
    flags_parse,
    has_bad_escape,
    joined,
    parse_options,
    tokenize,
)
from floodsight.functions.sizes import compare_parse, size_parse
from floodsight.operators.segments import running_sum
from floodsight.schemas import RULE_REJECTS, RULES, TYPE_ORDER
from floodsight.session import broadcast_if_small, settle

DEFAULT_PERIOD = 10
DEFAULT_ACTION = "syslog"

# The largest number of each compared field, per list.
_BYTE, _SHORT, _WORD = 2**8 - 1, 2**16 - 1, 2**32 - 1
_COMPARED = {"seq": _WORD, "ack": _WORD, "win": _SHORT, "hlen": _SHORT, "type": _BYTE, "code": _BYTE}


def read_rule_files(spark: SparkSession, path: str) -> DataFrame:
    """Rule files to (ruleset_id = file name, line_no, line), lines numbered from 0.

    A large file is read by many tasks. Each line is stored with the split it is in and its place there; the lines before a
    split are the sum of the splits before it.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        F.col("_metadata.file_name").alias("ruleset_id"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    lines = settle(lines, "rule-lines")
    splits = lines.groupBy("ruleset_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.partitionBy("ruleset_id").orderBy("split")) - F.col("n")
    numbered = lines.join(broadcast_if_small(settle(splits.withColumn("before", before), "rule-splits")), ["ruleset_id", "split"])
    return numbered.select("ruleset_id", (F.col("before") + F.col("place") - F.col("first")).alias("line_no"), "line")


def parse_rules(texts: DataFrame) -> DataFrame:
    """One row per rule line: every rules column but `rule_no`, with `reason` set when it is rejected.

    Blank lines, comments and lines of one token are skipped. All of it is row-local.
    """
    lines = texts.withColumn("_all", tokenize(F.col("line")))
    lines = lines.filter((F.size("_all") > 1) & ~F.get("_all", F.lit(0)).startswith("#"))
    lines = lines.select(
        "ruleset_id",
        "line_no",
        "line",
        F.get("_all", F.lit(0)).alias("_list"),
        F.slice("_all", 2, 2147483647).alias("_tokens"),
    ).withColumn("rule_type", F.when(F.col("_list").isin([t.upper() for t in TYPE_ORDER]), F.lower("_list")))
    lines = lines.withColumn("_allowed", allowed_options(F.col("rule_type")))
    lines = lines.withColumn("_parsed", parse_options(F.col("_tokens"), F.col("_allowed")))
    lines = lines.withColumn(
        "_opts",
        F.when(F.col("_parsed.error").isNull(), F.map_from_arrays("_parsed.names", "_parsed.args")),
    )

    def option(name):
        return F.try_element_at("_opts", F.lit(name))

    values = {
        "_src": cidr_range(option("srcip")),
        "_dst": cidr_range(option("dstip")),
        "_pps": size_parse(option("pps-th"), bits=False),
        "_bps": size_parse(option("bps-th"), bits=True),
        "_pps_period": option("pps-th-period").try_cast("bigint"),
        "_bps_period": option("bps-th-period").try_cast("bigint"),
        "_action": action_parse(option("action")),
        "_sport": port_range(option("sport")),
        "_dport": port_range(option("dport")),
        "_flags": flags_parse(option("tcp-flag")),
    }
    values |= {f"_{name}": compare_parse(option(name), most) for name, most in _COMPARED.items()}
    lines = lines.withColumns(values)

    def wrong(name, column):
        return F.when(
            option(name).isNotNull() & F.col(column).isNull(), F.concat(F.lit(f"bad {name}: "), option(name))
        )

    def wrong_period(name, column):
        bad = ~option(name).rlike("^[0-9]+$") | F.col(column).isNull()
        return F.when(option(name).isNotNull() & bad, F.concat(F.lit(f"bad {name}: "), option(name)))

    pps_th = F.coalesce("_pps", F.lit(0).cast("bigint"))
    bps_th = F.coalesce("_bps", F.lit(0).cast("bigint"))
    pps_period = F.coalesce("_pps_period", F.lit(DEFAULT_PERIOD).cast("bigint"))
    bps_period = F.coalesce("_bps_period", F.lit(DEFAULT_PERIOD).cast("bigint"))
    reason = F.coalesce(
        F.when(has_bad_escape(F.col("line")), F.lit("unknown escape")),
        F.when(F.col("rule_type").isNull(), F.concat(F.lit("unknown rule type: "), F.col("_list"))),
        F.col("_parsed.error"),
        wrong("srcip", "_src"),
        wrong("dstip", "_dst"),
        F.when(option("srcip").isNull() & option("dstip").isNull(), F.lit("no srcip or dstip")),
        wrong("pps-th", "_pps"),
        wrong("bps-th", "_bps"),
        wrong_period("pps-th-period", "_pps_period"),
        wrong_period("bps-th-period", "_bps_period"),
        wrong("action", "_action"),
        F.when((pps_th == 0) & (bps_th == 0), F.lit("no pps or bps threshold")),
        F.when((pps_th > 0) & (pps_period < 1), F.lit("pps period below 1")),
        F.when((bps_th > 0) & (bps_period < 1), F.lit("bps period below 1")),
        wrong("sport", "_sport"),
        wrong("dport", "_dport"),
        *[wrong(name, f"_{name}") for name in _COMPARED],
        wrong("tcp-flag", "_flags"),
    )
    columns = {"reason": reason, "text_rule": joined(F.col("_tokens"))}
    for side in ("src", "dst", "sport", "dport"):
        columns |= {f"{side}_{end}": F.col(f"_{side}.{end}") for end in ("lo", "hi")}
    for name in _COMPARED:
        columns |= {f"{name}_op": F.col(f"_{name}.op"), f"{name}_num": F.col(f"_{name}.num")}
    columns |= {
        "flag_bits": F.col("_flags.bits"),
        "flag_mask": F.col("_flags.mask"),
        "pps_th": pps_th,
        "bps_th": bps_th,
        "pps_period": pps_period,
        "bps_period": bps_period,
        "next_rule": option("next").isNotNull(),
        "action_type": F.coalesce(F.col("_action.type"), F.lit(DEFAULT_ACTION)),
        "action_param": F.coalesce(F.col("_action.param"), F.lit("")),
        "comment": F.coalesce(option("comment"), F.lit("")),
    }
    kept = [field.name for field in RULES.fields if field.name not in ("rule_no", *columns)]
    columns = {name: F.col(name) for name in ("line_no", "line", *kept)} | columns
    parsed = F.struct(*[value.alias(name) for name, value in columns.items()])
    # Filters on `reason` stop at the generator; pushed further down they would copy the whole parse.
    return lines.select(F.explode(F.array(parsed)).alias("_rule")).select("_rule.*")


def valid_rules(parsed: DataFrame) -> DataFrame:
    """Accepted rules, numbered from 0 in line order within each list of each ruleset."""
    good = parsed.filter("reason IS NULL").withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running_sum(good, ["ruleset_id", "rule_type"], "line_no", {"_n": "_one"})
    numbered = numbered.withColumn("rule_no", (F.col("_n") - 1).cast("int"))
    return numbered.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in RULES.fields])


def rule_rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason IS NOT NULL").select([f.name for f in RULE_REJECTS.fields])


def load_rules(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rule texts to (`rules`, `rule_rejects`). The parsed lines are stored, so each is parsed once."""
    parsed = settle(parse_rules(texts), "rules")
    return valid_rules(parsed), rule_rejects(parsed)
