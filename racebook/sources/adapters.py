"""Domain tables derived from the benchmark tables.

Every adapter is one SQL text in the dialect Spark and DuckDB share, so both sides of a check
start from the same rows. Names in braces are benchmark tables or other adapters. Sums run on
whole cents or points, so their value does not depend on the order of the rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from racebook.operators.trifecta import spread
from racebook.session import small_methods
from racebook.sources.tables import TABLES, read_table

ADAPTERS: dict[str, str] = {}

# At most six rows per race leave this aggregate, however many source rows a race has: a seventh line
# counts for the first lane. All its
# buffers have a fixed width (the flag enters as a number), so it runs as a hash aggregate.
ADAPTERS["race_base"] = """
SELECT l_orderkey AS race_key, (l_linenumber - 1) % 6 + 1 AS lane, count(*) AS n,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
  CAST(sum(CAST(floor(l_extendedprice * 100 + 5e-1) AS BIGINT)) AS BIGINT) AS cents,
  CAST(sum(CAST(floor(l_discount * 100 + 5e-1) AS BIGINT)) AS BIGINT) AS disc,
  CAST(sum(CAST(floor(l_tax * 100 + 5e-1) AS BIGINT)) AS BIGINT) AS tax,
  min(ascii(l_returnflag)) AS flag, min(l_shipdate) AS ship,
  max(l_partkey) AS part, max(l_suppkey) AS supp
FROM {lineitem}
GROUP BY l_orderkey, (l_linenumber - 1) % 6 + 1"""

ADAPTERS["race_entries"] = """
SELECT race_key, lane,
  CAST(race_key % 24 + 1 AS INT) AS venue_no, CAST(race_key % 12 + 1 AS INT) AS race_no,
  lpad(CAST(race_key % 24 + 1 AS STRING), 2, '0') AS venue,
  CAST(part AS STRING) AS racer_id,
  floor(qty * 2e1 / n + 5e-1) / 1e2 AS racer_win_rate,
  CASE WHEN (race_key + lane) % 7 = 0 THEN NULL
       ELSE floor(cents / (n * 1.05e4) + 5e-1) / 1e2 END AS local_win_rate,
  floor(disc * 1e3 / n + 5e-1) / 1e2 AS motor_2ren,
  floor(tax * 1.25e3 / n + 5e-1) / 1e2 AS boat_2ren,
  CASE WHEN (race_key + 2 * lane) % 9 = 0 THEN NULL ELSE (10 + supp % 20) / 1e2 END AS avg_st,
  CASE WHEN flag = ascii('A') THEN 'A1' WHEN flag = ascii('N') THEN 'A2'
       WHEN (race_key + lane) % 11 = 0 THEN 'B2'
       WHEN (race_key + lane) % 13 = 0 THEN NULL ELSE 'B1' END AS racer_class,
  CASE WHEN (race_key + lane) % 7 = 0 THEN NULL
       ELSE (630 + floor(tax * 1e1 / n + 5e-1)) / 1e2 END AS exhibition_time,
  CASE WHEN (race_key + lane) % 13 = 0 THEN -2 / 1e2 ELSE (part % 25) / 1e2 END AS exhibition_st,
  CASE WHEN (race_key + lane) % 4 = 0 THEN NULL ELSE (700 + part % 37) / 1e2 END AS original_straight,
  CASE WHEN (race_key * 2 + lane) % 5 = 0 THEN NULL ELSE (500 + part % 41) / 1e2 END AS original_turn,
  CASE WHEN (race_key + 3 * lane) % 6 = 0 THEN NULL ELSE (3600 + supp * 3 % 97) / 1e2 END AS original_lap,
  CASE WHEN (race_key + lane) % 8 = 0 THEN NULL ELSE (100 + part % 500) / 1e2 END AS current_meet_avg_finish,
  (supp % 101) * 1e0 AS current_meet_top2_rate,
  (8 + part % 20) / 1e2 AS current_meet_avg_st,
  CAST(part % 9 AS INT) AS current_meet_races,
  (part % 1001) / 1e1 AS course_top3_rate,
  (10 + supp % 15) / 1e2 AS course_avg_st,
  CASE WHEN (race_key + lane) % 10 = 0 THEN NULL ELSE (10 + part % 50) / 1e1 END AS course_start_rank,
  CASE WHEN lane = 1 THEN (36 + race_key % 24) * 1e0 ELSE (34 - 4 * lane + race_key % 5) * 1e0 END AS venue_course_1st,
  (20 + (race_key % 24) * lane % 25) * 1e0 AS venue_kimarite_makuri,
  CASE WHEN race_key % 17 = 0 THEN NULL ELSE (race_key % 9) * 1e0 END AS wind_speed,
  (race_key % 6) * 1e0 AS wave_height,
  row_number() OVER (PARTITION BY race_key ORDER BY ship, lane) AS finish
FROM {race_base}"""

ADAPTERS["win_probs"] = """
SELECT race_key, lane, exp(racer_win_rate / 5e0) / sum(exp(racer_win_rate / 5e0)) OVER (PARTITION BY race_key) AS p_first
FROM {race_entries}"""

ADAPTERS["official_results"] = """
SELECT f.race_key, f.first, f.second, f.third,
  concat(CAST(f.first AS STRING), '-', CAST(f.second AS STRING), '-', CAST(f.third AS STRING)) AS trifecta,
  CAST(floor(o.o_totalprice / 1e2) AS INT) AS trifecta_payout_per_100,
  o.o_orderdate AS race_date, CAST(o.o_custkey % 24 + 1 AS INT) AS venue_no
FROM (SELECT race_key, max(CASE WHEN finish = 1 THEN lane END) AS first,
        max(CASE WHEN finish = 2 THEN lane END) AS second,
        max(CASE WHEN finish = 3 THEN lane END) AS third
      FROM {race_entries} GROUP BY race_key) f
JOIN {orders} o ON f.race_key = o.o_orderkey
WHERE f.third IS NOT NULL"""

# The three strongest lanes of a race and four tickets over them.
ADAPTERS["top_lanes"] = """
SELECT race_key, max(CASE WHEN r = 1 THEN lane END) AS l1, max(CASE WHEN r = 2 THEN lane END) AS l2,
  max(CASE WHEN r = 3 THEN lane END) AS l3, max(CASE WHEN r = 1 THEN p_first END) AS p1,
  max(CASE WHEN r = 2 THEN p_first END) AS p2
FROM (SELECT race_key, lane, p_first,
        row_number() OVER (PARTITION BY race_key ORDER BY p_first DESC, lane) AS r FROM {win_probs}) x
GROUP BY race_key"""

ADAPTERS["tickets"] = """
SELECT race_key, k, a, b, c,
  concat(CAST(a AS STRING), '-', CAST(b AS STRING), '-', CAST(c AS STRING)) AS combo,
  CASE WHEN k <= 2 THEN '本線' WHEN k = 3 THEN '抑え' ELSE '穴' END AS ticket_group,
  p1 * p2 / (k + 1) AS prob,
  CASE WHEN (race_key + a) % 11 = 0 THEN NULL
       ELSE 1 + (race_key * 31 + a * 7 + b * 5 + c * 3) % 400 / 4e0 END AS odds,
  CAST(100 * ((race_key + k) % 6) AS INT) AS stake
FROM (
  SELECT race_key, k, p1, p2,
    CASE k WHEN 1 THEN l1 WHEN 2 THEN l1 WHEN 3 THEN l2 ELSE l3 END AS a,
    CASE k WHEN 1 THEN l2 WHEN 2 THEN l3 WHEN 3 THEN l1 ELSE l2 END AS b,
    CASE k WHEN 1 THEN l3 WHEN 2 THEN l2 WHEN 3 THEN l3 ELSE l1 END AS c
  FROM (SELECT race_key, l1, l2, l3, p1, p2, explode(array(1, 2, 3, 4)) AS k
        FROM {top_lanes} WHERE l3 IS NOT NULL) l) t"""

ADAPTERS["results_rows"] = """
SELECT r.race_key, r.race_date, r.venue_no, CAST(r.race_key % 12 + 1 AS INT) AS race_no,
  r.first, r.second, r.third, r.trifecta, r.trifecta_payout_per_100,
  t.l1 AS p1_lane, CASE WHEN r.race_key % 19 = 0 THEN NULL ELSE t.p1 END AS p1_prob,
  s.total_stake, s.hit_stake,
  CAST(floor(r.trifecta_payout_per_100 * s.hit_stake / 1e2) AS INT) AS payout,
  s.hit_stake > 0 AS hit_any, s.hit_top, r.first = t.l1 AS hit_first
FROM {official_results} r
JOIN {top_lanes} t ON r.race_key = t.race_key
JOIN (SELECT q.race_key, CAST(sum(q.stake) AS INT) AS total_stake,
        CAST(sum(CASE WHEN q.combo = x.trifecta THEN q.stake ELSE 0 END) AS INT) AS hit_stake,
        max(CASE WHEN q.k = 1 AND q.combo = x.trifecta THEN 1 ELSE 0 END) = 1 AS hit_top
      FROM {tickets} q JOIN {official_results} x ON q.race_key = x.race_key
      GROUP BY q.race_key) s ON r.race_key = s.race_key"""

ADAPTERS["odds_samples"] = """
SELECT user_id AS race_key, event_type AS combo, value AS odds, ts AS fetched_at, event_id AS arrival
FROM {events}"""

# Raw samples shrink to one row per combination before anything is grouped by race.
ADAPTERS["odds_combos"] = """
SELECT user_id AS race_key, event_type AS combo, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n
FROM {events} GROUP BY user_id, event_type"""

ADAPTERS["odds_races"] = """
SELECT race_key, min(first_ts) AS first_ts, max(last_ts) AS last_ts, min(combo) AS actual_combo,
  max_by(combo, last_ts) AS last_type
FROM {odds_combos} GROUP BY race_key"""

# Proposed tickets of the tracked races; which combinations were not proposed follows from the key.
ADAPTERS["odds_tickets"] = """
SELECT race_key, combo, CAST(100 * ((race_key + length(combo)) % 4) AS INT) AS stake,
  CASE WHEN length(combo) % 3 = 0 THEN '穴' ELSE '本線' END AS ticket_group,
  ((race_key * 7 + length(combo) * 13) % 100) / 4e2 AS ai_prob
FROM {odds_combos} WHERE (race_key + length(combo)) % 7 <> 0"""

ADAPTERS["odds_results"] = """
SELECT race_key, actual_combo FROM {odds_races} WHERE last_type <> 'error'"""

ADAPTERS["odds_locks"] = """
SELECT race_key, first_ts + INTERVAL 5 DAY AS saved_at,
  CASE WHEN race_key % 2 = 0 THEN first_ts + INTERVAL 5 DAY + INTERVAL 90 MINUTE
       ELSE first_ts + INTERVAL 5 DAY + INTERVAL 150 MINUTE END AS result_ts
FROM {odds_races}"""

ADAPTERS["watchlist"] = """
SELECT race_key, first_ts AS created_at, last_ts - INTERVAL 2 DAY AS deadline,
  last_type <> 'signup' AS active
FROM {odds_races}"""

ADAPTERS["starts"] = """
SELECT l_orderkey AS race_key, l_linenumber AS lane, l_partkey AS seq,
  CASE WHEN l_suppkey % 10 = 0 THEN 'F'
       WHEN l_suppkey % 17 = 0 THEN 'L' ELSE CAST(l_partkey % 6 + 1 AS STRING) END AS finish,
  CASE WHEN l_suppkey % 17 = 0 THEN 'L'
       WHEN l_suppkey % 10 = 0 THEN concat('F.', lpad(CAST(l_partkey % 30 AS STRING), 2, '0'))
       ELSE concat('.', lpad(CAST(l_partkey % 30 AS STRING), 2, '0')) END AS st,
  CAST(l_linenumber AS STRING) AS course
FROM {lineitem}"""

ADAPTERS["course_stats"] = """
SELECT CAST(l_partkey AS STRING) AS racer_id, (l_linenumber - 1) % 6 + 1 AS course,
  floor(sum(CAST(l_suppkey AS BIGINT)) * 1e1 / count(*)) / 1e1 AS course_top3_rate, count(*) AS course_starts
FROM {lineitem} GROUP BY l_partkey, (l_linenumber - 1) % 6 + 1"""

ADAPTERS["venue_profile"] = """
SELECT venue, lane AS course, floor(sum(CASE WHEN finish = 1 THEN 1 ELSE 0 END) * 1e4 / count(*) + 5e-1) / 1e2 AS venue_course_1st
FROM {race_entries} GROUP BY venue, lane"""

# Texts a landed page or an export would hold, spelled from the rows of an order.
ADAPTERS["order_texts"] = """
SELECT o_orderkey AS race_key, o_custkey AS racer_no, o_orderstatus AS status, o_orderpriority AS priority,
  CASE o_orderkey % 3 WHEN 0 THEN concat(y, m, d) WHEN 1 THEN concat(y, '-', m, '-', d) ELSE concat(y, '/', m, '/', d) END AS day_text,
  concat('￥', CAST(CAST(floor(o_totalprice / 1e3) AS INT) AS STRING), ',',
    lpad(CAST(CAST(floor(o_totalprice) AS INT) % 1000 AS STRING), 3, '0'), '円') AS price_text,
  concat(lpad(CAST(o_custkey % 24 AS STRING), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')) AS clock_text,
  concat(y, '-', m, '-', d, 'T', lpad(CAST(o_custkey % 24 AS STRING), 2, '0'), ':00:00',
    CASE o_orderkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+09:00' ELSE '' END) AS iso_text,
  concat(CASE o_orderkey % 4 WHEN 0 THEN '初日 ' WHEN 1 THEN '最終日 ' WHEN 2 THEN concat(CAST(o_custkey % 7 + 2 AS STRING), '日目 ') ELSE '' END,
    CASE WHEN o_orderstatus = 'F' THEN '最終R発売終了' WHEN o_orderstatus = 'P' THEN '発売開始前'
         WHEN o_orderkey % 5 = 0 THEN '' ELSE concat(CAST(o_orderkey % 12 + 1 AS STRING), 'R 1', CAST(o_custkey % 10 AS STRING), ':25') END) AS sale_text,
  translate(concat('ボート', o_orderpriority, ' ＃', CAST(o_custkey AS STRING)), '0123456789-', '０１２３４５６７８９－') AS wide_text
FROM (SELECT *, CAST(year(o_orderdate) AS STRING) AS y, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m,
        lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS d FROM {orders}) o"""

ADAPTERS["number_texts"] = """
SELECT l_orderkey AS race_key, l_linenumber AS lane, l_partkey AS part, CASE l_linenumber
  WHEN 1 THEN CAST(l_quantity AS STRING) WHEN 2 THEN 'nan' WHEN 3 THEN 'inf' WHEN 4 THEN '1e400'
  WHEN 5 THEN '' WHEN 6 THEN l_returnflag ELSE concat(' ', CAST(l_quantity AS STRING), ' ') END AS number_text
FROM {lineitem}"""


def _per_lane(value: str) -> str:
    return ", ".join(f"coalesce(max(CASE WHEN lane = {i} THEN concat('{i} ', {value}, ' ') END), '')" for i in range(1, 7))


ADAPTERS["race_pages"] = f"""
SELECT race_key, max(race_no) AS race_no, concat('出走表 締切予定時刻 ',
  {", ' ', ".join(f"CAST({8 + i} + race_key % 3 AS STRING), ':{i * 4 + 10}'" for i in range(12))},
  ' スタート展示 ', {_per_lane("concat(CASE WHEN exhibition_st < 0 THEN 'F' ELSE '' END, '.', lpad(CAST(CAST(floor(abs(exhibition_st) * 100 + 5e-1) AS INT) AS STRING), 2, '0'))")},
  '水面気象情報 気温 ', CAST(15 + race_key % 12 + 5e-1 AS STRING), '℃ 風速 ', CAST(max(wave_height) AS STRING), 'm 水温 ',
  CAST(10 + race_key % 15 AS STRING), '℃ 波高 ', CAST(race_key % 6 AS STRING), 'cm ',
  'コース別3連対率 ', {_per_lane("CASE WHEN course_start_rank IS NULL THEN '--' ELSE concat(CAST(course_top3_rate AS STRING), '%') END")},
  'コース別スタート順 ', {_per_lane("coalesce(CAST(course_start_rank AS STRING), '-')")}) AS page
FROM {{race_entries}} GROUP BY race_key"""

_REF = re.compile(r"\{(\w+)\}")


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(ADAPTERS[name])))


class Source:
    """Benchmark tables and adapters of one scale factor as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str, finer: bool = False):
        self.spark, self.sf_dir, self._seen, self._finer = spark, sf_dir, {}, finer
        small_methods(spark)

    def finer(self) -> "Source":
        """The same tables, with the windows of ``win_probs`` over a fixed number of finer partitions.

        Adaptive execution sizes a task by the compressed rows it reads. The sorts and aggregates from there to the
        tickets stand in one task, and together they hold many times that.
        """
        return Source(self.spark, self.sf_dir, True)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in ADAPTERS):
            raise AttributeError(name)
        if name not in self._seen:
            if name in TABLES:
                self._seen[name] = read_table(self.spark, self.sf_dir, name)
            else:
                parts = {n: getattr(self, n) for n in _needs(name)}
                if self._finer and name == "win_probs":
                    parts["race_entries"] = spread(parts["race_entries"])
                self._seen[name] = self.spark.sql(ADAPTERS[name], **parts)
        return self._seen[name]


def with_ctes(sql: str) -> str:
    """Check SQL with the adapters it names put in front as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in ADAPTERS and name not in order:
            for n in _needs(name):
                visit(n)
            order.append(name)

    for n in dict.fromkeys(_REF.findall(sql)):
        visit(n)

    def plain(text: str) -> str:
        # the one construct the two dialects spell differently
        text = text.replace("explode(array(", "unnest(list_value(")
        return _REF.sub(lambda m: m.group(1), text)

    ctes = [f"{n} AS MATERIALIZED ({plain(ADAPTERS[n])})" for n in order]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
