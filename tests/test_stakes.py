"""Closed-form allocation against the stepwise rules, written here as plain loops."""

import math
import random

import pytest

from racebook import constants as K
from racebook.operators import stakes

SCHEMA = "race_key INT, combo STRING, `group` STRING, prob DOUBLE, odds DOUBLE, expected_return DOUBLE"


def cases(n, seed):
    rnd = random.Random(seed)
    rows = []
    for race in range(n):
        for k in range(rnd.randint(1, 8)):
            prob = rnd.choice([0.0005, 0.002, 0.006, 0.03, 0.1, 0.25]) * rnd.uniform(0.5, 1.5)
            odds = rnd.choice([None, rnd.uniform(1, 400)])
            ev = None if odds is None or rnd.random() < 0.2 else prob * odds
            rows.append((race, f"1-2-{k}", rnd.choice([K.MAIN, K.MAIN, K.COVER, K.LONGSHOT]), prob, odds, ev))
    return rows


def weight(table, group, default):
    return table.get(group, default)


def stepwise(tickets, budget, unit, min_bet, long_share, ticket_share, bias):
    """One unit at a time: take from the weakest, then add to the best."""
    nearest = lambda x: int(round(x / unit) * unit)
    t = []
    for _, combo, group, prob, odds, ev in tickets:
        if ev is None and odds is not None:
            ev = prob * odds
        tiers = [(0.40, 0.18), (0.65, 0.45), (1.0, 0.72), (1.3, 1.0), (1.8, 1.1), (2.5, 1.16), (math.inf, 1.2)]
        factor = 0.8 if ev is None else next(m for edge, m in tiers if ev < edge)
        factor *= 1 + bias * min(max(0, (ev or 0) - 1) if ev is not None else 0, 1.5) * 0.6
        small = 0.22 + 0.1 * bias if prob < 0.001 else 0.42 + 0.15 * bias if prob < 0.003 else 0.7 + 0.1 * bias if prob < 0.01 else 1
        g = (1 - bias) * weight(K.GROUP_WEIGHT, group, 0.5) + bias * weight(K.GROUP_WEIGHT_VALUE, group, 0.8)
        score = g * prob ** (0.5 - 0.15 * bias) * factor * small
        if group == K.LONGSHOT and ev is not None and ev < 0.65:
            score *= 0.2
        t.append({"combo": combo, "group": group, "prob": prob, "score": score})
    cap = max(min_bet, nearest(budget * ticket_share))
    long_cap = max(0, nearest(budget * long_share))
    total = sum(x["score"] for x in t)
    for x in t:
        x["raw"] = min(budget * x["score"] / total, cap)
    long_total = sum(x["raw"] for x in t if x["group"] == K.LONGSHOT)
    for x in t:
        raw = x["raw"] * (long_cap / long_total if x["group"] == K.LONGSHOT and long_total > long_cap else 1)
        s = nearest(raw)
        x["stake"] = 0 if s <= 0 else max(s, min_bet)
    spent = lambda: sum(x["stake"] for x in t)
    weak = sorted(t, key=lambda x: ({K.LONGSHOT: 0, K.MAIN: 2}.get(x["group"], 1), x["score"], x["prob"], x["combo"]))
    while spent() > budget:
        x = next((x for x in weak if x["stake"] > 0), None)
        if x is None:
            break
        x["stake"] = x["stake"] - unit if x["stake"] - unit >= min_bet else 0
    best = sorted(t, key=lambda x: (-x["score"], -x["prob"], x["combo"]))
    while spent() + unit <= budget:
        in_long = sum(x["stake"] for x in t if x["group"] == K.LONGSHOT)
        free = [x for x in best if x["stake"] + unit <= cap and (x["group"] != K.LONGSHOT or in_long + unit <= long_cap)]
        if not free:
            break
        free[0]["stake"] += unit
    return {x["combo"]: x["stake"] for x in t}, cap, long_cap


@pytest.mark.parametrize(
    "budget,unit,min_bet,long_share,ticket_share,bias",
    [(2000, 100, 100, 0.15, 0.35, 0.0), (1000, 100, 300, 0.15, 0.35, 0.0), (700, 100, 100, 0.3, 0.2, 1.0), (5000, 100, 200, 0.05, 0.5, 0.4), (300, 100, 100, 0.15, 0.35, 0.0)],
)
def test_smart_equals_stepwise(spark, budget, unit, min_bet, long_share, ticket_share, bias):
    rows = cases(300, budget)
    got = {}
    out = stakes.allocate_smart(
        spark.createDataFrame(rows, SCHEMA), budget=budget, unit=unit, min_bet=min_bet, max_longshot_share=long_share,
        max_ticket_share=ticket_share, value_bias=bias,
    )
    for r in out.collect():
        got.setdefault(r.race_key, {})[r.combo] = r.stake
    for race in {r[0] for r in rows}:
        want, cap, long_cap = stepwise([r for r in rows if r[0] == race], budget, unit, min_bet, long_share, ticket_share, bias)
        assert got[race] == want, race
        assert sum(want.values()) <= budget
        assert all(s <= cap for s in want.values())


def test_no_budget_and_no_tickets(spark):
    d = spark.createDataFrame(cases(3, 1), SCHEMA)
    assert {r.stake for r in stakes.allocate_smart(d, budget=0).collect()} == {0}
    assert stakes.allocate_smart(d.limit(0)).count() == 0


def test_largest_remainder(spark):
    d = spark.createDataFrame(cases(200, 5), SCHEMA)
    full = {}
    for r in stakes.allocate_largest_remainder(d, budget=2000).collect():
        full.setdefault(r.race_key, []).append(r.stake)
    assert all(sum(v) == 2000 and min(v) >= 100 for v in full.values())
    scarce = {}
    for r in stakes.allocate_largest_remainder(d, budget=200).collect():
        scarce.setdefault(r.race_key, []).append(r.stake)
    for v in scarce.values():
        assert sum(v) <= 200
        assert len(v) <= 2 or sorted(set(v)) == [0, 100]
