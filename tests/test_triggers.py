import random

import pytest

import walks
from floodsight.operators import triggers
from floodsight.operators.byte_walk import TriggerState
from floodsight.schemas import RULES

FIRST, LAST = 1, 160


def make(seed, count=12):
    rng = random.Random(seed)
    rules, rows, expected = [], [], []
    for n in range(count):
        both = rng.random() < 0.6
        pps_th = 10 if both or rng.random() < 0.5 else 0
        bps_th = 100 if both or not pps_th else 0
        limits = (pps_th, bps_th, rng.randrange(1, 13), rng.randrange(1, 13))
        rule = dict.fromkeys(RULES.fieldNames())
        rule |= {
            "ruleset_id": "r", "rule_type": "tcp", "rule_no": n, "text_rule": "", "next_rule": False,
            "pps_th": pps_th, "bps_th": bps_th, "pps_period": limits[2], "bps_period": limits[3],
            "action_type": "syslog", "action_param": "", "comment": "",
        }
        rules.append(tuple(rule[name] for name in RULES.fieldNames()))
        heat = rng.choice([0.5, 0.9, 0.98])
        rates = {
            tick: (rng.choice([1, 10, 11, 40]) if rng.random() > heat else 20, 150 if rng.random() < heat else 100)
            for tick in range(0, LAST + 1)
            if rng.random() < heat + 0.015
        }
        rows += [(n, tick, pps, bps, 5) for tick, (pps, bps) in rates.items()]
        expected += [(n, tick, kind) for tick, kind in walks.alarms(rates, FIRST, LAST, *limits)]
    return rules, rows, sorted(expected)


@pytest.mark.parametrize("seed, width", [(1, 1), (1, 7), (2, 16), (3, 64), (4, 512)])
def test_alarms_equal_the_walk(spark, seed, width):
    rules, rows, expected = make(seed)
    rates = spark.createDataFrame(rows, "rule_id long, tick long, pps long, bps long, dst_ip long")
    table = spark.createDataFrame(rules, RULES)
    got = triggers.alarms(rates, table, FIRST, width)
    assert sorted((r.rule_id, r.tick, r.trigger) for r in got.collect()) == expected


@pytest.mark.parametrize("seed", range(5, 15))
def test_streaming_state_equals_the_walk(seed):
    rules, rows, expected = make(seed)
    names = RULES.fieldNames()
    fired = []
    for rule in rules:
        rule = dict(zip(names, rule))
        limits = [rule[name] for name in ("pps_th", "bps_th", "pps_period", "bps_period")]
        state = TriggerState(last_tick=FIRST - 1)
        for _, tick, pps, bps, _ in sorted(r for r in rows if r[0] == rule["rule_no"] and r[1] >= FIRST):
            kind = state.step(tick, pps, bps, *limits)
            if kind:
                fired.append((rule["rule_no"], tick, kind))
    assert sorted(fired) == expected


def test_uncounted_destination_swallows_the_alarm_but_restarts_the_wait(spark):
    rules, _, _ = make(20, 1)
    rule = dict(zip(RULES.fieldNames(), rules[0])) | {"pps_th": 10, "bps_th": 0, "pps_period": 2}
    table = spark.createDataFrame([tuple(rule.values())], RULES)
    rows = [(0, tick, 20, 0, None if tick == 1 else 5) for tick in range(1, 9)]
    rates = spark.createDataFrame(rows, "rule_id long, tick long, pps long, bps long, dst_ip long")
    assert sorted(r.tick for r in triggers.alarms(rates, table, FIRST).collect()) == [4, 7]
    due = triggers.single_alarms(rates.drop("dst_ip"), table, FIRST)
    counted = rates.filter("dst_ip IS NOT NULL")
    assert sorted(r.tick for r in triggers.guard(due, counted).collect()) == [4, 7]


def test_uncounted_packet_alarm_does_not_hide_the_byte_test(spark):
    rules, _, _ = make(21, 1)
    rule = dict(zip(RULES.fieldNames(), rules[0]))
    rule |= {"pps_th": 10, "bps_th": 10, "pps_period": 3, "bps_period": 3}
    table = spark.createDataFrame([tuple(rule.values())], RULES)
    rates = spark.createDataFrame(
        [(0, 1, 20, 20, 5), (0, 2, 20, 20, 5), (0, 3, 20, 20, 5), (0, 4, 20, 20, 5), (0, 5, 20, 20, None)],
        "rule_id long, tick long, pps long, bps long, dst_ip long",
    )
    got = {(r.tick, r.trigger) for r in triggers.alarms(rates, table, FIRST).collect()}
    # Tick 1 fires on packets and hides the bytes; they are due at tick 2 instead.
    assert got == {(1, "pps"), (2, "bps")}
