"""The byte test of rules with two thresholds, over one segment of ticks, and the plain state walk.

Small helpers for grouped maps: Spark cuts the segments, moves the rows and joins the results.
"""

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa

LONG_AGO = -(2**40)


@dataclass
class TriggerState:
    """What a rule remembers between ticks. The general definition of the triggers."""

    pps_good: int = LONG_AGO
    bps_good: int = LONG_AGO
    last_tick: int | None = None

    def step(self, tick, pps, bps, pps_th, bps_th, pps_period, bps_period, counted=True):
        """Take the rates of a tick later than the last one; return pps, bps or None."""
        if self.last_tick is not None and tick > self.last_tick + 1:
            # Ticks without rows were good.
            self.pps_good = self.bps_good = tick - 1
        self.last_tick = tick
        if pps_th > 0:
            if pps <= pps_th:
                self.pps_good = tick
            elif tick - self.pps_good > pps_period:
                self.pps_good = tick
                if counted:
                    return "pps"
        if bps_th > 0:
            if bps <= bps_th:
                self.bps_good = tick
            elif tick - self.bps_good > bps_period:
                self.bps_good = tick
                if counted:
                    return "bps"
        return None


def exit_ages(ticks, over, hidden, period: int, first: int, last: int) -> list[tuple[int, int, int]]:
    """The age at `last` for every age before `first`, as steps (age, exit, slope): from that age on the exit is
    ``exit + slope * more``, up to the next step.

    An age is how many ticks ago the rate was last good or an alarm fired, at most `period`: more is the same. Rows are ticks
    above a threshold, in order; a tick between them was good. The possible last good ticks stand in a queue, oldest in
    front, as runs of equal or of successive ones. A tick above the threshold takes those that have waited long enough from
    the front and puts them at the end, so what is kept grows with the rows, and not with the period.
    """
    # runs of entries: the first, the last, the good tick of the first, and by how much the next one's is later
    queue = deque([(0, period, first - 1 - period, 1)])
    expected = first
    for tick, is_over, is_hidden in zip(ticks, over, hidden):
        if tick > expected:
            queue = deque([(0, period, tick - 1, 0)])
        expected = tick + 1
        if is_hidden:
            continue
        if not is_over:
            queue = deque([(0, period, tick, 0)])
            continue
        due = tick - period - 1
        while queue[0][2] <= due:
            a, b, good, slope = queue.popleft()
            end = b if slope == 0 else min(b, a + due - good)
            _fire(queue, a, end, tick)
            if end < b:
                queue.appendleft((end + 1, b, good + slope * (end + 1 - a), slope))
    if expected != last + 1:
        return [(0, 0, 0)]
    steps = []
    for a, b, good, slope in sorted(queue, reverse=True):
        at, value = period - b, last - (good + slope * (b - a))
        steps.append((at, min(value, period), slope if value < period else 0))
        if slope and value < period < value + (b - a):
            steps.append((at + period - value, period, 0))
    return steps


def _fire(queue: deque, a: int, b: int, tick: int) -> None:
    if queue:
        a0, b0, good, slope = queue[-1]
        latest = good + slope * (b0 - a0)
        if b0 + 1 == a and latest == tick and slope * (b0 - a0) == 0:
            queue[-1] = (a0, b, tick, 0)
            return
        if b0 + 1 == a and a == b and latest + 1 == tick and (slope == 1 or a0 == b0):
            queue[-1] = (a0, b, good, 1)
            return
    queue.append((a, b, tick, 0))


def exit_age(steps: list[dict], age: int, period: int) -> int:
    """The age that a segment ends with, if it begins with `age`."""
    at = bisect_right(steps, age, key=lambda step: step["age"]) - 1
    step = steps[at]
    return min(step["exit"] + step["slope"] * (age - step["age"]), period)


def _columns(pdf):
    return pdf["tick"].tolist(), pdf["bps_above"].tolist(), pdf["pps_fired"].tolist()


def segment_exits(pdf: pd.DataFrame, width: int) -> pd.DataFrame:
    """A row for the segment: how its exit age depends on the age at its start."""
    row = pdf.iloc[0]
    period, segment, first_tick = int(row["bps_period"]), int(row["_segment"]), int(row["first_tick"])
    steps = exit_ages(*_columns(pdf), period, max(segment, first_tick), segment + width - 1)
    exits = [{"age": age, "exit": value, "slope": slope} for age, value, slope in steps]
    return pd.DataFrame({"rule_id": [int(row["rule_id"])], "_segment": [segment], "bps_period": [period], "first_tick": [first_tick], "exits": [exits]})


def segment_entries(parts: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Age at the start of each segment, from the segments of rules in order. Only the age is kept from one to the next."""
    rule, before, age = None, None, 0
    for part in parts:
        ages = []
        for now, segment, period, first_tick, exits in zip(*(column.to_pylist() for column in part.columns)):
            if now != rule or first_tick >= segment:
                age = period if first_tick >= segment else 0
            elif before != segment - width:
                age = 0
            ages.append(age)
            age = exit_age(exits, age, period)
            rule, before = now, segment
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ages, pa.int64())], ["rule_id", "_segment", "age"])


def segment_fires(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ticks at which the byte test is due, from the age at the segment's start."""
    row = pdf.iloc[0]
    first, period = max(int(row["_segment"]), int(row["first_tick"])), int(row["bps_period"])
    good, expected, due = first - 1 - int(row["age"]), first, []
    for tick, is_over, is_hidden in zip(*_columns(pdf)):
        if tick > expected:
            good = tick - 1
        expected = tick + 1
        fires = is_over and not is_hidden and tick - good > period
        if fires or not (is_over or is_hidden):
            good = tick
        due.append(fires)
    return pd.DataFrame({"rule_id": pdf["rule_id"], "_segment": pdf["_segment"], "tick": pdf["tick"], "bps_due": due})
