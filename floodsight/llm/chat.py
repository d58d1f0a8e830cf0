"""Chat formatting by prefix-target expansion.

A turn is formatted as `<|role|>\\n`, its text, `<|end|>\\n`; a conversation is its turns in order. Every assistant turn is
an example of its own: all turns before it are its context, and only its text is trained on. All examples of a
conversation are prefixes of the same formatted text, so they are kept as spans over it: expanding a conversation of n
turns costs n rows, not n^2 texts. `op8_chat_format` stores the turns and the examples and reads the replies back by the
examples' spans. `example_texts` writes the examples out where the whole texts are wanted, long ones in pieces.

Control strings inside texts and roles are escaped: `~` becomes `~0`, and the first character of `<|`, `<s>`, `</s>`
(`~1`) and of `[INST]`, `[/INST]` (`~2`) is replaced, in roles also every `|` (`~3`), so nothing in a text can be read
as a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodsight.session import settle

TRAINED = "assistant"
_MARK = re.compile(r"~|<(?=\||s>|/s>)|\[(?=/?INST\])")
_CODE = {"~": "~0", "<": "~1", "[": "~2", "|": "~3"}
_BACK = {code: char for char, code in _CODE.items()}
_TURN = re.compile(r"<\|(.*?)\|>\n(.*)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _MARK.sub(lambda m: _CODE[m[0]], text)


def unescape(text: str) -> str:
    return re.sub("~[0123]", lambda m: _BACK[m[0]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head, body = f"<|{escape(role).replace('|', '~3')}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


_SEGMENTS = "conv_id long, position long, formatted string, start long, loss_start long, loss_end long"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """A row for each turn: (conv_id, position, formatted, start, loss_start, loss_end), places in code points of the
    conversation's formatted text; loss_start and loss_end are null but for assistant turns.

    `conversations(conv_id, turn, role, text)`; null role or text: empty; null conv_id: one more conversation; null turn:
    before all others. Turns with equal numbers are ordered by role and text, and repeated rows are turns of their own.
    Other columns are ignored. A task reads a conversation turn by turn and holds one Arrow batch of it. An empty table gives no
    rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(parts: Iterator[pa.RecordBatch]):
        current, position, start = object(), 0, 0
        for part in parts:
            out = []
            for conv, role, body in zip(*(part.column(k).to_pylist() for k in range(3))):
                if conv != current:
                    current, position, start = conv, 0, 0
                formatted, a, b = format_turn(role, body)
                loss = (start + a, start + b) if role == TRAINED else (None, None)
                out.append((conv, position, formatted, start, *loss))
                position, start = position + 1, start + len(formatted)
            yield _batch(out, ["conv_id", "position", "formatted", "start", "loss_start", "loss_end"], {"formatted": pa.string()})

    return rows.mapInArrow(run, _SEGMENTS)


def _batch(rows: list[tuple], names: list[str], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], kinds.get(name, pa.int64())) for k, name in enumerate(names)]
    return pa.RecordBatch.from_arrays(columns, names)


def examples(segments: DataFrame) -> DataFrame:
    """(conv_id, position, n_context, context_end, loss_start, loss_end): a row for each assistant turn.

    The example's text is the conversation's formatted text up to the turn's end; its context are the `n_context` turns
    up to `context_end`; the loss span is the reply.
    """
    rows = segments.where("loss_start IS NOT NULL")
    return rows.select("conv_id", "position", F.col("position").alias("n_context"), F.col("start").alias("context_end"), "loss_start", "loss_end")


def example_texts(segments: DataFrame, most: int) -> DataFrame:
    """(conv_id, position, text, loss_start, loss_end, piece): the examples written out, each in ordered pieces of `most` code
    points, the last one shorter. loss_start and loss_end are places in the whole example.

    This is quadratic in the length of a conversation; the bound keeps a row within memory.
    """
    own = examples(segments).select(F.col("conv_id").alias("conv"), F.col("position").alias("at"), F.col("loss_start").alias("a"), F.col("loss_end").alias("b"))
    parts = segments.select("conv_id", F.col("position").alias("p"), "formatted", "start")
    last = F.floor((F.col("start") + F.length("formatted") - 1) / most)
    parts = parts.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / most), last)))
    begin = F.greatest(F.col("piece") * most - F.col("start"), F.lit(0))
    size = (F.col("piece") + 1) * most - F.col("start") - begin
    parts = parts.select("conv_id", "p", "piece", F.col("formatted").substr((begin + 1).cast("int"), size.cast("int")).alias("part"))
    both = own.join(parts, F.col("conv").eqNullSafe(F.col("conv_id")) & (F.col("p") <= F.col("at")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "part"))), lambda x: x["part"]), "")
    rows = both.groupBy("conv_id", F.col("at").alias("position"), F.col("a").alias("loss_start"), F.col("b").alias("loss_end"), "piece").agg(text.alias("text"))
    return rows.select("conv_id", "position", "text", "loss_start", "loss_end", "piece")


def read_back(segments: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """Digests of each conversation from its formatted turns and the rows of its examples alone; `made` are those of
    `examples`. An example's reply is what its loss span holds, and its context span must hold the turns before it.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples)
    """
    made = examples(segments) if made is None else made
    none = F.lit(None)
    turns = segments.select("conv_id", "position", F.lit(0).alias("kind"), "formatted", *(none.cast("long").alias(x) for x in ("n_context", "context_end", "loss_start", "loss_end")))
    spans = made.select("conv_id", "position", F.lit(1).alias("kind"), none.cast("string").alias("formatted"), "n_context", "context_end", "loss_start", "loss_end")
    rows = turns.union(spans).repartition("conv_id").sortWithinPartitions("conv_id", "position", "kind")

    def run(parts: Iterator[pa.RecordBatch]):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
        kinds = {"turns_sha256": pa.string(), "loss_sha256": pa.string()}
        current, state, turn = None, None, ""

        def row():
            n, turns, chars, loss, length, shown = state
            return current, n, turns.hexdigest(), chars, loss.hexdigest(), length, shown

        for part in parts:
            done = []
            for conv, formatted, before, start, a, b in zip(*(part.column(k).to_pylist() for k in range(6))):
                if state is None or conv != current:
                    if state is not None:
                        done.append(row())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if formatted is not None:
                    turn = formatted
                    role, text = parse_turn(turn)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[4] += len(turn)
                    continue
                if (before, start) != (state[0] - 1, state[4] - len(turn)) or not start <= a <= b <= state[4]:
                    raise ValueError("an example's spans don't fit its conversation")
                trained = unescape(turn[a - start : b - start])
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[5] += 1
            if done:
                yield _batch(done, names, kinds)
        if state is not None:
            yield _batch([row()], names, kinds)

    columns = rows.select("conv_id", "formatted", "n_context", "context_end", "loss_start", "loss_end")
    return columns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text")
    )
    segments = settle(format_conversations(turns.union(more)), "chat")
    return read_back(segments, settle(examples(segments), "chat-examples"))


_ESCAPED = "regexp_replace(replace({0}, '~', '~0'), '<\\||<s>|</s>|\\[INST\\]|\\[/INST\\]', '~\\0', 'g')"
OP8_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + len(regexp_extract_all(role, '~|<\\||<s>|</s>|\\[INST\\]|\\[/INST\\]')) + length(role) - length(replace(role, '|', '')) + length({_ESCAPED.format("text")}) + length('<||>') + length('<|end|>') + 2)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM t GROUP BY conv_id"""
