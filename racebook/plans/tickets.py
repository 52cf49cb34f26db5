"""Queries over outcome probabilities, tickets and stakes."""

from __future__ import annotations

from pyspark.sql import functions as F

from racebook import constants as K
from racebook.operators import joins, stakes, tickets, trifecta
from racebook.plans.race import with_probability
from racebook.plans.registry import R6, query, r6, rounded

P = "PARTITION BY race_key"
SECOND_VALUES = ", ".join(f"({a}, {b}, {v!r}e0)" for a, m in K.SECOND_PRIOR.items() for b, v in m.items())
THIRD_VALUES = ", ".join(f"({r}, {v!r}e0)" for r, v in K.THIRD_PRIOR.items())

TRI_SQL = f"""
wp AS (SELECT race_key, lane, p_first AS p, pow(p_first, 0.8e0) AS pb, pow(p_first, 0.65e0) AS pc,
    sum(pow(p_first, 0.8e0)) OVER ({P}) AS sb, sum(pow(p_first, 0.65e0)) OVER ({P}) AS sc,
    row_number() OVER ({P} ORDER BY lane) - 1 AS below FROM {{win_probs}}),
second_prior(a, b, q) AS (VALUES {SECOND_VALUES}),
third_prior(r, q) AS (VALUES {THIRD_VALUES}),
raw AS (SELECT x.race_key, x.lane AS a, y.lane AS b, z.lane AS c,
    x.p * (0.6e0 * y.pb / (x.sb - x.pb) + 0.4e0 * s.q) * (0.7e0 * z.pc / (x.sc - x.pc - y.pc) + 0.3e0 * t.q) AS w
  FROM wp x JOIN wp y ON y.race_key = x.race_key AND y.lane <> x.lane
  JOIN wp z ON z.race_key = x.race_key AND z.lane <> x.lane AND z.lane <> y.lane
  JOIN second_prior s ON s.a = x.lane AND s.b = y.lane
  JOIN third_prior t ON t.r = z.below - (x.lane < z.lane)::INT - (y.lane < z.lane)::INT + 1),
tri AS (SELECT race_key, a, b, c, concat(a, '-', b, '-', c) AS combo, w / sum(w) OVER ({P}) AS prob FROM raw)"""


@query(
    "ordered_triples",
    """SELECT x.race_key, x.lane AS a, y.lane AS b, z.lane AS c, concat(x.lane, '-', y.lane, '-', z.lane) AS combo
FROM {win_probs} x JOIN {win_probs} y ON y.race_key = x.race_key AND y.lane <> x.lane
JOIN {win_probs} z ON z.race_key = x.race_key AND z.lane <> x.lane AND z.lane <> y.lane""",
)
def ordered_triples(t):
    return trifecta.ordered_triples(t.win_probs)


@query("trifecta_probs", f"WITH {TRI_SQL} SELECT race_key, a, b, c, combo, {R6('prob')} AS prob FROM tri")
def trifecta_probs(t):
    return rounded(trifecta.trifecta(t.win_probs), "prob")


@query(
    "second_place_prior",
    f"""WITH f AS (SELECT race_key, max(CASE WHEN finish = 1 THEN lane END) AS a, max(CASE WHEN finish = 2 THEN lane END) AS b
  FROM {{race_entries}} GROUP BY race_key HAVING count(*) >= 2)
SELECT a, b, count(*) AS n, {R6('count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY a)')} AS p FROM f GROUP BY a, b""",
)
def second_place_prior(t):
    return rounded(trifecta.second_place_prior(t.race_entries), "p")


@query(
    "third_place_prior",
    f"""WITH f AS (SELECT race_key, max(CASE WHEN finish = 3 THEN lane END) AS c,
    list(lane ORDER BY lane) FILTER (WHERE finish > 2) AS rest
  FROM {{race_entries}} GROUP BY race_key HAVING count(*) >= 3)
SELECT list_position(rest, c) AS place, count(*) AS n, {R6('count(*) * 1e0 / sum(count(*)) OVER ()')} AS p FROM f GROUP BY 1""",
)
def third_place_prior(t):
    return rounded(trifecta.third_place_prior(t.race_entries), "p")


# Market odds stand-in: every seventh race has none, one lane in eleven has no price.
ODDS_EXPR = """CASE WHEN race_key % 7 = 0 OR (race_key + a) % 11 = 0 THEN NULL
  ELSE 1 + (race_key * 31 + a * 7 + b * 5 + c * 3) % 400 / 4e0 END"""
# The favourite is hedged in every third race.
HEDGE_EXPR = "CASE WHEN race_key % 3 = 0 THEN 1 + race_key % 4 END"


def priced(t):
    most = t.lineitem.count() // 3  # from the footers of the files; a race has three runners at least
    out = trifecta.trifecta(with_probability(t).select("race_key", "lane", "p_first"), most=most)
    return out.withColumns({"odds": F.expr(ODDS_EXPR), "hedge_lane": F.expr(HEDGE_EXPR)})


def pct(col: str) -> str:
    return (
        f"CASE WHEN {col} IS NULL THEN 0e0 ELSE (rank() OVER ({P} ORDER BY {col} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY race_key, {col}) - 1) / 2e0) / count({col}) OVER ({P}) END"
    )


TICKET_SQL = f"""{TRI_SQL},
x0 AS (SELECT *, {ODDS_EXPR} AS odds, {HEDGE_EXPR} AS hedge_lane FROM tri),
x1 AS (SELECT *, prob * odds AS ev, CASE WHEN odds IS NOT NULL THEN least(greatest(prob * odds, 0), 2.5) END AS ev_c,
  ln(1 + odds) AS lo FROM x0),
x AS MATERIALIZED (SELECT *, {pct('prob')} AS pr, {pct('ev_c')} AS er, {pct('lo')} AS orr,
  count(odds) OVER ({P}) > 0 AS has_odds FROM x1),
m0 AS (SELECT *, NOT has_odds OR coalesce(ev >= 0.9, false) OR pr >= 0.93 AS pool FROM x),
m1 AS (SELECT *, pool OR count(*) FILTER (WHERE pool) OVER ({P}) < 3 AS open FROM m0),
main AS MATERIALIZED (SELECT race_key, combo, row_number() OVER ({P} ORDER BY CASE WHEN has_odds THEN pr * 0.78 + er * 0.22 ELSE prob END DESC, prob DESC, combo) AS place
  FROM m1 WHERE open QUALIFY place <= 3),
r1 AS MATERIALIZED (SELECT x.* FROM x ANTI JOIN main USING (race_key, combo)),
cover AS MATERIALIZED (SELECT race_key, combo, row_number() OVER ({P} ORDER BY CASE WHEN has_odds THEN
    pr * 0.82 + er * 0.18 - CASE WHEN ev < 0.75 THEN 0.08 ELSE 0 END ELSE prob END DESC, prob DESC, combo) AS place
  FROM r1 QUALIFY place <= 3),
r2 AS MATERIALIZED (SELECT r1.* FROM r1 ANTI JOIN cover USING (race_key, combo)),
l0 AS (SELECT *, coalesce(ev >= 1 AND (prob >= 0.003 OR ev >= 1.8), false) AS best, coalesce(ev >= 1, false) AS good FROM r2),
l1 AS (SELECT *, CASE WHEN NOT has_odds THEN true
    WHEN count(*) FILTER (WHERE best) OVER ({P}) >= 2 THEN best
    WHEN count(*) FILTER (WHERE good) OVER ({P}) >= 2 THEN good ELSE true END AS pool FROM l0),
longs AS MATERIALIZED (SELECT race_key, combo, row_number() OVER ({P} ORDER BY CASE WHEN has_odds THEN
    er * 0.55 + orr * 0.2 + pr * 0.25 - CASE WHEN prob < 0.003 AND ev < 1.8 THEN 0.25 ELSE 0 END ELSE prob END DESC,
    ev DESC NULLS LAST, prob DESC, combo) AS place FROM l1 WHERE pool QUALIFY place <= 2),
lj AS (SELECT l.*, x.hedge_lane, x.a = x.hedge_lane OR x.b = x.hedge_lane OR x.c = x.hedge_lane AS inc
  FROM longs l JOIN x USING (race_key, combo)),
need AS (SELECT race_key, max(place) AS last_place FROM lj WHERE hedge_lane IS NOT NULL GROUP BY race_key HAVING bool_and(inc)),
hedge AS MATERIALIZED (SELECT r2.race_key, r2.combo, need.last_place AS place FROM r2 JOIN need USING (race_key)
  WHERE a <> hedge_lane AND b <> hedge_lane AND c <> hedge_lane
  QUALIFY row_number() OVER ({P} ORDER BY CASE WHEN has_odds THEN er * 0.5 + pr * 0.5 ELSE prob END DESC, ev DESC NULLS LAST, prob DESC, combo) = 1),
longf AS (SELECT race_key, combo, place, false AS is_hedge FROM longs l
    WHERE NOT EXISTS (SELECT 1 FROM hedge h WHERE h.race_key = l.race_key AND h.place = l.place)
  UNION ALL SELECT race_key, combo, place, true FROM hedge),
picked AS (SELECT race_key, combo, place, '{K.MAIN}' AS "group", false AS is_hedge FROM main
  UNION ALL SELECT race_key, combo, place, '{K.COVER}', false FROM cover
  UNION ALL SELECT race_key, combo, place, '{K.LONGSHOT}', is_hedge FROM longf),
ranked AS (SELECT p.race_key, p.combo, x.prob, x.odds, x.ev AS expected_return, p."group", p.place, p.is_hedge
  FROM picked p JOIN x USING (race_key, combo))"""

SHOW = ["race_key", "combo", "prob", "odds", "expected_return", "group", "place", "is_hedge"]


def ticket_query(name: str, group: str | None, hedge: bool = False):
    where = "" if group is None else f""" WHERE "group" = '{group}'"""
    if hedge:
        where += " AND is_hedge"

    @query(
        name,
        f"""WITH {TICKET_SQL} SELECT race_key, combo, {R6('prob')} AS prob, odds, {R6('expected_return')} AS expected_return,
  "group", place, is_hedge FROM ranked{where}""",
    )
    def run(t):
        out = tickets.rank_tickets(priced(t))
        if group is not None:
            out = out.filter(F.col("group") == group)
        if hedge:
            out = out.filter("is_hedge")
        return rounded(out.select(*SHOW), "prob", "expected_return")


ticket_query("tickets_main", K.MAIN)
ticket_query("tickets_cover", K.COVER)
ticket_query("tickets_longshot", K.LONGSHOT)
ticket_query("tickets_hedge", K.LONGSHOT, hedge=True)
ticket_query("tickets_ranked", None)

SMART_SQL = f"""{TICKET_SQL},
s0 AS (SELECT *, "group" = '{K.LONGSHOT}' AS lng, CASE "group" WHEN '{K.MAIN}' THEN 1e0 WHEN '{K.COVER}' THEN 0.62e0 ELSE 0.3e0 END
  * sqrt(prob) * CASE WHEN expected_return IS NULL THEN 0.8e0 WHEN expected_return < 0.4 THEN 0.18e0 WHEN expected_return < 0.65 THEN 0.45e0
      WHEN expected_return < 1 THEN 0.72e0 WHEN expected_return < 1.3 THEN 1e0 WHEN expected_return < 1.8 THEN 1.1e0
      WHEN expected_return < 2.5 THEN 1.16e0 ELSE 1.2e0 END
  * CASE WHEN prob < 0.001 THEN 0.22e0 WHEN prob < 0.003 THEN 0.42e0 WHEN prob < 0.01 THEN 0.7e0 ELSE 1e0 END
  * CASE WHEN "group" = '{K.LONGSHOT}' AND expected_return < 0.65 THEN 0.2e0 ELSE 1e0 END AS score FROM ranked),
s1 AS (SELECT *, least(2e3 * score / sum(score) OVER ({P}), 700) AS raw FROM s0),
s2 AS (SELECT *, sum(CASE WHEN lng THEN raw ELSE 0 END) OVER ({P}) AS lt FROM s1),
s3 AS (SELECT *, CAST(100 * round_even(raw * CASE WHEN lng AND lt > 300 THEN 300 / lt ELSE 1 END / 1e2, 0) AS INT) AS st FROM s2),
s4 AS (SELECT *, sum(st) OVER ({P}) - 2000 - coalesce(sum(st) OVER ({P}
    ORDER BY CASE "group" WHEN '{K.LONGSHOT}' THEN 0 WHEN '{K.COVER}' THEN 1 ELSE 2 END, score, prob, combo
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM s3),
s5 AS (SELECT * REPLACE (CASE WHEN over > 0 THEN st - least(over, st) ELSE st END AS st) FROM s4),
s6 AS (SELECT *, greatest(0, 2000 - sum(st) OVER ({P})) // 100 AS fr, greatest(0, 300 - sum(CASE WHEN lng THEN st ELSE 0 END) OVER ({P})) // 100 AS fl,
  greatest(0, 700 - st) // 100 AS room FROM s5),
s7 AS (SELECT *, CASE WHEN lng THEN least(room, greatest(0, fl - coalesce(sum(CASE WHEN lng THEN room ELSE 0 END) OVER ({P} ORDER BY score DESC, prob DESC, combo
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE room END AS fit FROM s6),
s8 AS (SELECT *, CAST(st + 100 * least(fit, greatest(0, fr - coalesce(sum(fit) OVER ({P} ORDER BY score DESC, prob DESC, combo
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS INT) AS stake FROM s7)"""


@query(
    "stakes_smart",
    f"""WITH {SMART_SQL} SELECT race_key, combo, "group", stake, CASE WHEN stake <= 0 THEN '見送り'
  WHEN lng AND prob < 0.003 THEN '超低確率のため少額' WHEN expected_return < 1 THEN '期待値1未満のため抑制'
  WHEN "group" = '{K.MAIN}' THEN '本線を厚め' WHEN lng THEN '穴は上限管理' ELSE '確率・期待値を加味' END AS stake_reason FROM s8""",
)
def stakes_smart(t):
    out = stakes.allocate_smart(tickets.rank_tickets(priced(t)))
    return out.select("race_key", "combo", "group", "stake", "stake_reason")


@query(
    "stakes_largest_remainder",
    f"""WITH {TICKET_SQL},
v0 AS (SELECT *, sqrt(prob) AS p, least(greatest(coalesce(expected_return, 1), 0.5), 2.5) AS e FROM ranked),
v1 AS (SELECT *, CASE "group" WHEN '{K.MAIN}' THEN 1e0 WHEN '{K.COVER}' THEN 0.72e0 ELSE 0.42e0 END * (0.72e0 * p + 0.28e0 * p * e)
  * CASE WHEN "group" = '{K.LONGSHOT}' THEN 0.85e0 + 0.25e0 * e ELSE 1 END
  * CASE WHEN "group" = '{K.LONGSHOT}' AND prob < 0.003 THEN 0.55e0 ELSE 1 END AS score, count(*) OVER ({P}) AS n FROM v0),
v2 AS (SELECT *, score / sum(score) OVER ({P}) * ((2000 - 100 * n) / 100) AS share FROM v1),
v3 AS (SELECT *, floor(share) AS units, (2000 - 100 * n) // 100 - sum(floor(share)) OVER ({P}) AS spare,
  row_number() OVER ({P} ORDER BY share - floor(share) DESC, combo) AS turn FROM v2)
SELECT race_key, combo, "group", CAST(100 + 100 * (units + CASE WHEN turn <= spare THEN 1 ELSE 0 END) AS INT) AS stake FROM v3""",
)
def stakes_largest_remainder(t):
    out = stakes.allocate_largest_remainder(tickets.rank_tickets(priced(t)))
    return out.select("race_key", "combo", "group", "stake")


@query(
    "exclude_used_anti",
    """SELECT t.race_key, t.combo, t.ticket_group FROM {tickets} t
WHERE NOT EXISTS (SELECT 1 FROM {tickets} u WHERE u.k <= 2 AND u.race_key = t.race_key AND u.combo = t.combo)""",
)
def exclude_used_anti(t):
    t = t.finer()
    used = t.tickets.filter("k <= 2").select("race_key", "combo")
    return t.tickets.join(used, ["race_key", "combo"], "left_anti").select("race_key", "combo", "ticket_group")


@query(
    "odds_left_join",
    f"""WITH book AS (SELECT race_key, combo, arg_max(odds, seq) AS odds FROM (
    SELECT race_key, combo, odds, k AS seq FROM {{tickets}} WHERE k <= 3
    UNION ALL SELECT race_key, combo, odds * 2, k + 10 FROM {{tickets}} WHERE k = 2) GROUP BY ALL)
SELECT t.race_key, t.combo, {R6('t.prob')} AS prob, b.odds, {R6('t.prob * b.odds')} AS expected_return
FROM {{tickets}} t LEFT JOIN book b ON b.race_key = t.race_key AND b.combo = t.combo""",
)
def odds_left_join(t):
    t = t.finer()
    early = t.tickets.filter("k <= 3").select("race_key", "combo", "odds", F.col("k").alias("seq"))
    late = t.tickets.filter("k = 2").select("race_key", "combo", (F.col("odds") * 2).alias("odds"), (F.col("k") + 10).alias("seq"))
    out = tickets.with_odds(t.tickets.select("race_key", "combo", "prob"), early.unionByName(late), ["seq"])
    return rounded(out.withColumn("expected_return", F.col("prob") * F.col("odds")), "prob", "expected_return")
