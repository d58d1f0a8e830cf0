"""Streaming triggers: per-rule state over the ticks that the watermark has closed."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from floodsight.operators.byte_walk import TriggerState
from floodsight.operators.match import collect_rules
from floodsight.operators.triggers import LIMITS, limits_of
from floodsight.streaming.ticks import profile_of_counts, tick_dst_counts
from floodsight.streaming.watermarks import committed_watermark

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_NAME = "good"
# What a rule remembers, and its limits: a timer comes without rows.
_STATE = f"pps_good bigint, bps_good bigint, last_tick bigint, {', '.join(f'{name} bigint' for name in LIMITS)}"
_ROW = ["tick", "pps", "bps", "dst_ip"]
_ALARMS = "rule_id long, tick bigint, pps bigint, bps bigint, dst_ip bigint, trigger string"
# Ticks that are held under one key of the state, and rows of a backlog that are put into it at once.
HELD = 240
BACKLOG = 1 << 20


class TriggerProcessor(StatefulProcessor):
    """Walks a rule's ticks in order.

    Rows of a batch come in any order, so they are put into the state BACKLOG rows at a time, four minutes of ticks under each key, compressed, with
    a timer for the last of them. Timers come in order of time, after all rows of the batch; each takes its key's ticks out of
    the state. So however long a rule's backlog is, BACKLOG rows and four minutes of it are in memory, and a key is written
    once for each BACKLOG rows, not for each chunk that Spark hands over.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(STATE_NAME, _STATE)
        self.held = handle.getMapState("held", "span bigint", "ticks binary")

    def handleInputRows(self, key, rows, timerValues):
        backlog, size = [], 0
        for chunk in rows:
            if not self.state.exists():
                first = chunk.iloc[0]
                self.state.update((*_fresh(int(first["first_tick"])), *(int(first[name]) for name in LIMITS)))
            chunk = chunk[chunk["tick"] >= chunk["first_tick"]]
            backlog.append(chunk[_ROW].to_numpy(np.int64))
            size += len(chunk)
            if size >= BACKLOG:
                self._hold(np.concatenate(backlog))
                backlog, size = [], 0
        if size:
            self._hold(np.concatenate(backlog))
        return iter(())

    def _hold(self, rows: np.ndarray) -> None:
        rows = rows[np.argsort(rows[:, 0])]
        spans = rows[:, 0] // HELD
        for part in np.split(rows, np.flatnonzero(np.diff(spans)) + 1):
            span, last = int(part[0, 0]) // HELD, int(part[-1, 0])
            if self.held.containsKey((span,)):
                part = np.concatenate([_unpacked(self.held.getValue((span,))[0]), part])
            self.held.updateValue((span,), (_packed(part),))
            self.handle.registerTimer(last * 1000 + 999)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = expiredTimerInfo.getExpiryTimeInMs() // 1000
        span = last // HELD
        if not self.held.containsKey((span,)):
            return
        rows = _unpacked(self.held.getValue((span,))[0])
        rows = rows[np.argsort(rows[:, 0])]
        due, later = rows[rows[:, 0] <= last], rows[rows[:, 0] > last]
        if len(later):
            self.held.updateValue((span,), (_packed(later),))
        else:
            self.held.removeKey((span,))
        value = [int(x) for x in self.state.get()]
        state, fired = walk(value, due)
        self.state.update((state.pps_good, state.bps_good, state.last_tick, *value[3:]))
        if fired:
            yield pd.DataFrame([(int(key[0]), *row) for row in fired], columns=["rule_id", *_ROW, "trigger"])

    def close(self) -> None:
        pass


def _packed(rows: np.ndarray) -> bytes:
    # Column by column, so that what is alike lies together.
    return zlib.compress(rows.T.tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bytes(packed)), np.int64).reshape(len(_ROW), -1).T


def _fresh(first_tick: int) -> tuple[int, int, int]:
    return TriggerState.pps_good, TriggerState.bps_good, first_tick - 1


def walk(value: list[int], rows: np.ndarray) -> tuple[TriggerState, list[tuple]]:
    """Go on from a stored state over ticks in order; what fired as (tick, pps, bps, dst_ip, trigger)."""
    state, limits, fired = TriggerState(*value[:3]), value[3:7], []
    for tick, pps, bps, dst_ip in rows.tolist():
        if tick <= state.last_tick:
            raise ValueError(f"tick {tick} came after tick {state.last_tick}")
        trigger = state.step(tick, pps, bps, *limits)
        if trigger:
            fired.append((tick, pps, bps, dst_ip, trigger))
    return state, fired


def stream_alarms(packets: DataFrame, rules: DataFrame, delay: str, first_tick: int) -> DataFrame:
    """Alarms of a stream of packets: (rule_id, tick, pps, bps in bytes, dst_ip, trigger).

    Rules may have books (`with_books`): a version meets the packets of its time, and its state is its own, so it starts afresh.
    `first_tick` is the first tick that is evaluated, but for rules that bring their own. The rules are those of the start;
    where they change while the stream goes on, use `reloading_counts` and `alarms_of_counts`.
    """
    ruleset = collect_rules(rules)
    if ruleset is None:
        raise ValueError("too many rules to compile; use reloading_counts and alarms_of_counts")
    return _triggered(profile_of_counts(tick_dst_counts(packets, ruleset, delay)), limits_of(rules, first_tick))


def alarms_of_counts(counts: DataFrame, delay: str) -> DataFrame:
    """Alarms of a stream of counts by destination that carry their rules' limits, as `reloading_counts` stores them."""
    counts = counts.withWatermark("ts", delay)
    keys = [F.window("ts", "1 second"), "rule_id", "dst_ip", *LIMITS]
    summed = counts.groupBy(*keys).agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))
    return _triggered(profile_of_counts(summed, LIMITS), None)


def _triggered(profile: DataFrame, limits: DataFrame | None) -> DataFrame:
    profile.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = profile if limits is None else profile.join(F.broadcast(limits), "rule_id")
    return rows.groupBy("rule_id").transformWithStateInPandas(
        statefulProcessor=TriggerProcessor(), outputStructType=_ALARMS, outputMode="Append", timeMode="EventTime"
    )


def closing_alarms(rates: DataFrame, checkpoint: str) -> DataFrame:
    """Alarms of the ticks that a finished stream has left open.

    `rates`: (rule_id, tick, pps, bps, dst_ip, limits), all of the ticks from the last committed watermark on; earlier ones
    are left out. Each rule goes on from its state in the stream's checkpoint.
    """
    spark = rates.sparkSession
    first = committed_watermark(spark, checkpoint) // 1000
    operators = spark.read.format("state-metadata").load(checkpoint)
    number = operators.filter(F.col("operatorName").startswith("transformWithState")).agg(F.max("operatorId")).first()[0]
    stored = spark.read.format("statestore").option("operatorId", number).option("stateVarName", STATE_NAME).load(checkpoint)
    stored = stored.select(F.col("key").getField("rule_id").alias("rule_id"), F.col("value").alias("state"))
    rows = rates.filter((F.col("tick") >= first) & (F.col("tick") >= F.col("first_tick"))).join(stored, "rule_id", "left")
    rows = rows.select("rule_id", *_ROW, "first_tick", *LIMITS[:-1], *[F.col(f"state.{name}").alias(f"s_{name}") for name in ("pps_good", "bps_good", "last_tick")])

    def go_on(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        state = _fresh(int(row["first_tick"])) if pd.isna(row["s_last_tick"]) else tuple(int(row[f"s_{name}"]) for name in ("pps_good", "bps_good", "last_tick"))
        value = [*state, *(int(row[name]) for name in LIMITS[:-1])]
        _, fired = walk(value, pdf.sort_values("tick")[_ROW].to_numpy(np.int64))
        return pd.DataFrame([(int(row["rule_id"]), *x) for x in fired], columns=["rule_id", *_ROW, "trigger"])

    return rows.groupBy("rule_id").applyInPandas(go_on, _ALARMS)
