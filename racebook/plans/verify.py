"""Queries over frozen predictions, official results and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from racebook import constants as K
from racebook.functions.scalars import once
from racebook.operators import documents, features, joins, verify
from racebook.plans.odds import SERIES_SQL, TARGETS_SQL
from racebook.plans.race import FEATURE_SQL, card, p_sql
from racebook.plans.registry import R6, query, r6, rounded
from racebook.schemas import HISTORY, RESULTS, conform
from racebook.session import fresh_path
from racebook.sources import stores
from racebook.sources.archive import OddsArchive
from racebook.sources.versioned import Table
from racebook.sources.views import register_views


def result_rows(t):
    return t.results_rows.select(
        "race_key", "venue_no", "p1_lane", "p1_prob", "total_stake", "payout",
        F.col("hit_first").alias("predicted_first_hit"),
        F.col("hit_any").alias("hit_any_ticket"),
        F.col("hit_top").alias("hit_top_ticket"),
    )


MEASURES_SQL = f"""count(*) AS races, {R6('avg(hit_first::INT)')} AS first_hit_rate, {R6('avg(hit_any::INT)')} AS ticket_hit_rate,
  {R6('avg(hit_top::INT)')} AS top_ticket_hit_rate, sum(total_stake) AS total_stake, sum(payout) AS total_payout,
  sum(payout) - sum(total_stake) AS profit, {R6('sum(payout) / nullif(sum(total_stake), 0)')} AS roi,
  {R6('avg((p1_prob - hit_first::INT) ** 2)')} AS brier_first"""
RATES = ["first_hit_rate", "ticket_hit_rate", "top_ticket_hit_rate", "roi", "brier_first"]


@query("metrics_overall", f"SELECT {MEASURES_SQL} FROM {{results_rows}}")
def metrics_overall(t):
    return rounded(verify.metrics(result_rows(t)), *RATES)


@query("perf_by_venue", f"SELECT venue_no, {MEASURES_SQL} FROM {{results_rows}} GROUP BY venue_no")
def perf_by_venue(t):
    return rounded(verify.performance(result_rows(t), "venue_no"), *RATES)


@query("perf_by_lane", f"SELECT p1_lane, {MEASURES_SQL} FROM {{results_rows}} GROUP BY p1_lane")
def perf_by_lane(t):
    return rounded(verify.performance(result_rows(t), "p1_lane"), *RATES)


BAND_SQL = "CASE " + " ".join(f"WHEN p1_prob >= {lo!r} AND p1_prob < {hi!r} THEN '{b}'" for b, lo, hi in K.PROB_BANDS) + " END"


@query("perf_by_prob_band", f"SELECT {BAND_SQL} AS band, {MEASURES_SQL} FROM {{results_rows}} GROUP BY 1")
def perf_by_prob_band(t):
    return rounded(verify.performance(result_rows(t).withColumn("band", verify.band(F.col("p1_prob"))), "band"), *RATES)


@query(
    "perf_grouping_sets",
    f"""SELECT venue_no, p1_lane, {MEASURES_SQL} FROM {{results_rows}}
GROUP BY GROUPING SETS ((), (venue_no), (p1_lane), (venue_no, p1_lane))""",
)
def perf_grouping_sets(t):
    cube = result_rows(t).cube("venue_no", "p1_lane").agg(*verify.measures())
    return rounded(cube, *RATES)


TICKET_PERF_SQL = f"""count(*) AS tickets, count(*) FILTER (WHERE combo = trifecta) AS hits, sum(stake) AS total_stake,
  sum(CASE WHEN combo = trifecta THEN CAST(floor(trifecta_payout_per_100 * stake / 1e2) AS INT) ELSE 0 END) AS total_payout,
  {R6('sum(CASE WHEN combo = trifecta THEN floor(trifecta_payout_per_100 * stake / 1e2) ELSE 0 END) / sum(stake)')} AS roi
FROM {{tickets}} t JOIN {{official_results}} r ON t.race_key = r.race_key WHERE stake > 0 GROUP BY 1"""


@query("perf_by_ticket_group", f"SELECT ticket_group, {TICKET_PERF_SQL}")
def perf_by_ticket_group(t):
    out = verify.ticket_performance(t.tickets, t.official_results, F.col("ticket_group"), "ticket_group")
    return rounded(out, "roi")


EV_BAND_SQL = """CASE WHEN prob * odds IS NULL THEN 'missing' WHEN prob * odds < 0.4 THEN '<0.40' WHEN prob * odds < 0.65 THEN '0.40-0.65'
  WHEN prob * odds < 1 THEN '0.65-1.00' WHEN prob * odds < 1.3 THEN '1.00-1.30' WHEN prob * odds < 1.8 THEN '1.30-1.80'
  WHEN prob * odds < 2.5 THEN '1.80-2.50' ELSE '>=2.50' END"""


@query("perf_by_ev_band", f"SELECT {EV_BAND_SQL} AS ev_band, {TICKET_PERF_SQL}")
def perf_by_ev_band(t):
    out = verify.ticket_performance(
        t.tickets, t.official_results, verify.ev_band(F.col("prob") * F.col("odds")), "ev_band"
    )
    return rounded(out, "roi")


@query("sql_views", f"""SELECT 'venue' AS view, CAST(venue_no AS VARCHAR) AS key, {MEASURES_SQL} FROM {{results_rows}} GROUP BY venue_no
UNION ALL SELECT 'lane', CAST(p1_lane AS VARCHAR), {MEASURES_SQL} FROM {{results_rows}} GROUP BY p1_lane
UNION ALL SELECT 'band', {BAND_SQL}, {MEASURES_SQL} FROM {{results_rows}} GROUP BY {BAND_SQL}
UNION ALL SELECT 'overall', NULL, {MEASURES_SQL} FROM {{results_rows}}""")
def sql_views(t):
    """The views over race results, asked by name in SQL."""
    register_views(result_rows(t), t.tickets, t.official_results)
    rest = "races, first_hit_rate, ticket_hit_rate, top_ticket_hit_rate, total_stake, total_payout, profit, roi, brier_first"
    out = t.spark.sql(
        f"""SELECT 'venue' AS view, string(venue_no) AS key, {rest} FROM perf_by_venue
        UNION ALL SELECT 'lane', string(p1_lane), {rest} FROM perf_by_lane
        UNION ALL SELECT 'band', band, {rest} FROM perf_by_prob_band
        UNION ALL SELECT 'overall', NULL, {rest} FROM perf_overall"""
    )
    return rounded(out, *RATES)


@query(
    "calibration_table",
    f"""WITH bands(band_no, band) AS (VALUES {', '.join(f"({i}, '{b}')" for i, (b, _, _) in enumerate(K.PROB_BANDS))}),
seen AS (SELECT {BAND_SQL} AS band, count(*) AS n, avg(p1_prob) AS p, avg(hit_first::INT) AS h FROM {{results_rows}}
  WHERE p1_prob IS NOT NULL GROUP BY 1)
SELECT band_no, b.band, coalesce(n, 0) AS races, round_even(p * 100, 1) AS mean_predicted, round_even(h * 100, 1) AS actual_rate
FROM bands b LEFT JOIN seen s ON s.band = b.band""",
)
def calibration_table(t):
    return verify.calibration(result_rows(t))


def snapshots(t):
    """Frozen documents of all races with three runners."""
    lanes = t.win_probs.select(
        "race_key", "lane", F.concat(F.lit("R"), F.col("lane")).alias("racer_name"), "p_first", F.lit("").alias("reason")
    )
    bets = t.tickets.select(
        "race_key", "k", "combo", F.col("ticket_group").alias("group"), "prob", "odds",
        (F.col("prob") * F.col("odds")).alias("expected_return"), "stake", F.lit("").alias("stake_reason"),
    )
    return verify.payloads(lanes, bets)


@query(
    "verification_record",
    f"""WITH top AS (SELECT race_key, arg_max(combo, (prob, coalesce(prob * odds, -1), -k)) AS top_ticket,
    max(prob) AS top_prob, max(k) AS n FROM {{tickets}} GROUP BY race_key),
topt AS (SELECT t.race_key, t.combo, t.prob, t.odds, t.stake FROM {{tickets}} t JOIN top ON top.race_key = t.race_key AND top.top_ticket = t.combo)
SELECT r.race_date, r.race_key, r.first AS first_actual, r.second AS second_actual, r.third AS third_actual, r.trifecta AS trifecta_actual,
  l.l1 AS p1_lane, {R6('l.p1')} AS p1_prob, o.combo AS top_ticket, {R6('o.prob')} AS top_ticket_prob, o.odds AS top_ticket_odds,
  o.stake AS top_ticket_stake, r.total_stake, r.payout, r.payout - r.total_stake AS profit,
  {R6('r.payout / nullif(r.total_stake, 0)')} AS roi, r.trifecta = o.combo AS hit_top_ticket, r.hit_any AS hit_any_ticket,
  r.first = l.l1 AS predicted_first_hit, 4 AS n_tickets, w.n AS n_lanes, t1.combo AS first_combo, w.lane AS first_lane
FROM {{results_rows}} r JOIN (SELECT race_key, count(*) AS n, min(lane) AS lane FROM {{win_probs}} GROUP BY race_key) w ON w.race_key = r.race_key
JOIN {{tickets}} t1 ON t1.race_key = r.race_key AND t1.k = 1
JOIN {{top_lanes}} l ON l.race_key = r.race_key JOIN topt o ON o.race_key = r.race_key""",
)
def verification_record(t):
    out = verify.verification_records(snapshots(t), t.official_results)
    read = {
        "n_tickets": F.json_array_length("tickets_json"),
        "n_lanes": F.json_array_length("lane_probs_json"),
        "first_combo": F.get_json_object("tickets_json", "$[0].combo"),
        "first_lane": F.get_json_object("lane_probs_json", "$[0].lane").cast("int"),
    }
    return rounded(out.withColumns(read).drop("tickets_json", "lane_probs_json"), "p1_prob", "top_ticket_prob", "roi")


@query(
    "payout_join",
    """SELECT race_key, total_stake, hit_stake, CAST(floor(trifecta_payout_per_100 * hit_stake / 1e2) AS BIGINT) AS payout
FROM {results_rows}""",
)
def payout_join(t):
    return verify.payouts(t.tickets, t.official_results)


@query(
    "hit_any_semi",
    """SELECT race_key, trifecta FROM {official_results} r WHERE EXISTS (SELECT 1 FROM {tickets} t
WHERE t.race_key = r.race_key AND t.combo = r.trifecta AND t.stake > 0)""",
)
def hit_any_semi(t):
    return verify.any_hit(t.official_results.select("race_key", "trifecta"), t.tickets)


@query(
    "actual_rank_lookup",
    """SELECT w.race_key, w.lane, CASE w.lane WHEN r.first THEN 1 WHEN r.second THEN 2 WHEN r.third THEN 3 END AS actual_rank
FROM {win_probs} w JOIN {official_results} r ON r.race_key = w.race_key""",
)
def actual_rank_lookup(t):
    rows = t.win_probs.select("race_key", "lane").join(t.official_results.select("race_key", "trifecta"), "race_key")
    return verify.actual_ranks(rows).select("race_key", "lane", "actual_rank")


@query(
    "ablation_report",
    f"WITH {FEATURE_SQL}, v AS ("
    + " UNION ALL ".join(f"SELECT race_key, '{n}' AS variant, lane, {p_sql(w)} AS p FROM feat" for n, w in features.VARIANTS.items())
    + f"""),
g AS (SELECT v.race_key, v.variant, r.first, arg_min(v.lane, (-v.p, v.lane)) AS top, max(CASE WHEN v.lane = r.first THEN v.p END) AS pw,
    (sum((v.p - (v.lane = r.first)::INT) ** 2)) / 6 AS brier
  FROM v JOIN {{official_results}} r ON r.race_key = v.race_key GROUP BY ALL HAVING count(*) >= 2)
SELECT variant, count(*) AS races, {R6('avg((top = first)::INT)')} AS hit_rate, {R6('avg(brier)')} AS brier,
  {R6('avg(pw)')} AS winner_probability FROM g GROUP BY variant""",
)
def ablation_report(t):
    lanes = lambda d: d.withColumns({"racer_name": F.lit(""), "reason": F.lit("")})
    research = lanes(features.variants(card(t)))
    final = lanes(t.win_probs)
    bets = t.tickets.select(
        "race_key", "k", "combo", F.col("ticket_group").alias("group"), "prob", "odds",
        F.lit(None).cast("double").alias("expected_return"), "stake", F.lit("").alias("stake_reason"),
    )
    docs = verify.parse_payload(verify.payloads(final, bets, research)).select("race_key", "payload.research")
    rows = docs.join(t.official_results.select("race_key", F.col("first").alias("first_actual")), "race_key")
    return rounded(verify.ablation(rows), "hit_rate", "brier", "winner_probability")


def mixed_documents(t):
    """Frozen documents in every state: whole, cut off, without tickets, in the old list form."""
    k = F.col("race_key")
    doc = F.col("payload_json")
    lanes_only = F.get_json_object(doc, "$.final")
    mixed = (
        F.when(k % 7 == 0, F.lit("{"))
        .when(k % 7 == 1, F.concat(F.lit('{"final":'), lanes_only, F.lit(',"tickets":[]}')))
        .when(k % 7 == 2, lanes_only)
        .otherwise(doc)
    )
    return snapshots(t).select("race_key", once(mixed).alias("payload_json"))


@query(
    "verification_without_tickets",
    """SELECT race_key, CASE WHEN race_key % 7 = 1 THEN 0 ELSE total_stake END AS total_stake,
  CASE WHEN race_key % 7 = 1 THEN 0 ELSE payout END AS payout, CASE WHEN race_key % 7 = 1 THEN 0 ELSE 4 END AS n_tickets
FROM {results_rows} WHERE race_key % 7 = 1 OR race_key % 7 > 2""",
)
def verification_without_tickets(t):
    out = verify.verification_records(mixed_documents(t), t.official_results)
    return out.select("race_key", "total_stake", "payout", F.json_array_length("tickets_json").alias("n_tickets"))


@query("verification_quarantine", "SELECT race_key FROM {top_lanes} WHERE l3 IS NOT NULL AND race_key % 7 IN (0, 2)")
def verification_quarantine(t):
    return verify.split_unreadable(mixed_documents(t))[1].select("race_key")


@query(
    "snapshot_usable",
    "SELECT race_key, race_key % 7 > 2 AS usable FROM {top_lanes} WHERE l3 IS NOT NULL",
)
def snapshot_usable(t):
    return verify.parse_payload(mixed_documents(t)).select("race_key", verify.usable(F.col("payload")).alias("usable"))


@query(
    "json_two_formats",
    f"""SELECT w.race_key, w.lane, {R6('w.p_first')} AS p_first FROM {{win_probs}} w JOIN {{top_lanes}} t ON t.race_key = w.race_key
WHERE t.l3 IS NOT NULL AND w.race_key % 7 <> 0""",
)
def json_two_formats(t):
    rows = mixed_documents(t).select("race_key", F.explode(verify.lanes_of_document(F.col("payload_json"))).alias("x"))
    return rows.select("race_key", "x.lane", r6(F.col("x.p_first")).alias("p_first"))


@query(
    "documents_as_variant",
    f"""WITH d AS (SELECT w.race_key, w.lane, w.p_first FROM {{win_probs}} w JOIN {{top_lanes}} t ON t.race_key = w.race_key WHERE t.l3 IS NOT NULL),
s AS (SELECT race_key, count(*) AS n_tickets, sum(stake) AS stake FROM {{tickets}} GROUP BY race_key)
SELECT d.race_key, d.lane, CASE WHEN d.race_key % 7 = 4 AND d.lane = 2 THEN NULL ELSE {R6('d.p_first')} END AS p_first,
  CASE WHEN d.race_key % 7 = 4 AND d.lane = 2 THEN 'NaN, "Infinity": [NaN]' ELSE '' END AS note,
  CASE WHEN d.race_key % 7 > 2 THEN s.n_tickets WHEN d.race_key % 7 = 1 THEN 0 END AS n_tickets,
  CASE WHEN d.race_key % 7 > 2 THEN s.stake WHEN d.race_key % 7 = 1 THEN 0 END AS stake
FROM d LEFT JOIN s ON s.race_key = d.race_key WHERE d.race_key % 7 <> 0""",
)
def documents_as_variant(t):
    """Whole, old and cut-off documents, and some with a number that is none beside a text that looks like it."""
    odd = F.regexp_replace("payload_json", r'("lane":2,)[^}]*\}', r'$1"p_first":NaN,"reason":"NaN, \\"Infinity\\": [NaN]"}')
    docs = mixed_documents(t).withColumn("payload_json", once(F.when(F.col("race_key") % 7 == 4, odd).otherwise(F.col("payload_json"))))
    read = documents.read_documents(docs).select("race_key", F.explode("payload.final").alias("x"), "payload.tickets")
    note = F.when(F.col("x.reason").contains("NaN"), F.col("x.reason")).otherwise("")
    stake = F.aggregate("tickets", F.lit(0).cast("long"), lambda acc, x: acc + x.stake.cast("long"))
    n = F.when(F.col("tickets").isNotNull(), F.size("tickets")).alias("n_tickets")
    return read.select("race_key", "x.lane", r6(F.col("x.p_first")).alias("p_first"), note.alias("note"), n, stake.alias("stake"))


@query(
    "scalar_json",
    f"""SELECT t.race_key, t.combo, t.ticket_group, {R6('t.prob')} AS prob, t.odds, t.stake, t.race_key % 7 = 0 AS broken
FROM {{tickets}} t""",
)
def scalar_json(t):
    """Rows to documents and back; a document cut short parses to NULL."""
    docs = verify.parse_payload(snapshots(t)).select("race_key", "payload.tickets", "payload_json")
    cut = F.when(F.col("race_key") % 7 == 0, F.lit("{")).otherwise(F.col("payload_json"))
    broken = F.from_json(cut, "final ARRAY<STRUCT<lane: INT>>").getField("final").isNull()
    return docs.select("race_key", F.explode("tickets").alias("x"), broken.alias("broken")).select(
        "race_key", "x.combo", F.col("x.group").alias("ticket_group"), r6(F.col("x.prob")).alias("prob"), "x.odds",
        F.col("x.stake").cast("int").alias("stake"), "broken",
    )


@query(
    "results_scan",
    """SELECT NULL::TIMESTAMP AS saved_at, CAST(race_date AS DATE) AS race_date, lpad(CAST(venue_no AS VARCHAR), 2, '0') AS venue, race_no, race_key,
  first AS first_actual, second AS second_actual, third AS third_actual, trifecta AS trifecta_actual, p1_lane,
  floor(p1_prob * 1e6 + 50001e-5) / 1e6 AS p1_prob, NULL AS top_ticket, NULL::DOUBLE AS top_ticket_prob, NULL::DOUBLE AS top_ticket_odds,
  NULL::INT AS top_ticket_stake, total_stake, payout, payout - total_stake AS profit, NULL::DOUBLE AS roi,
  hit_top AS hit_top_ticket, hit_any AS hit_any_ticket, hit_first AS predicted_first_hit, NULL AS tickets_json, NULL AS lane_probs_json
FROM {results_rows}""",
)
def results_scan(t):
    """Results with absent columns, brought to the full schema, newest day first."""
    raw = t.results_rows.select(
        "race_key", "race_date", F.lpad(F.col("venue_no").cast("string"), 2, "0").alias("venue"), "race_no",
        F.col("first").alias("first_actual"), F.col("second").alias("second_actual"), F.col("third").alias("third_actual"),
        F.col("trifecta").alias("trifecta_actual"), "p1_lane", r6("p1_prob").alias("p1_prob"), "total_stake", "payout",
        (F.col("payout") - F.col("total_stake")).alias("profit"), F.col("hit_top").alias("hit_top_ticket"),
        F.col("hit_any").alias("hit_any_ticket"), F.col("hit_first").alias("predicted_first_hit"),
    )
    return conform(raw, RESULTS).orderBy(F.desc("race_date"), F.asc("venue"), F.desc("race_no"))


@query(
    "conform_columns",
    """SELECT venue, race_no, lane, racer_win_rate, local_win_rate, motor_2ren, boat_2ren, NULL::DOUBLE AS avg_st,
  0 AS finish, race_key FROM {race_entries}""",
)
def conform_columns(t):
    extra = t.race_entries.drop("avg_st", "finish")
    return conform(extra, HISTORY, {"finish": 0})


@query(
    "scan_history_csv",
    "SELECT venue, race_no, lane, racer_win_rate, local_win_rate, motor_2ren, boat_2ren, avg_st, CAST(finish AS INT) AS finish, race_key FROM {race_entries}",
)
def scan_history_csv(t):
    path = fresh_path(t.spark, "history")
    conform(t.race_entries, HISTORY).write.option("header", True).csv(path)
    return stores.read_csv(t.spark, path, HISTORY)


@query(
    "scan_odds_csv",
    """SELECT combo, odds, NULL AS line FROM {odds_samples} WHERE odds >= 1
UNION ALL SELECT NULL, NULL, concat(combo, ',n/a') FROM {odds_samples} WHERE odds < 1""",
)
def scan_odds_csv(t):
    """Two-column odds files: prices as rows, lines without a price as rejects."""
    path = fresh_path(t.spark, "odds")
    price = F.when(F.col("odds") >= 1, F.col("odds").cast("string")).otherwise("n/a")
    t.odds_samples.select("combo", price.alias("odds")).write.option("header", True).csv(path)
    rows, rejects = stores.scan_csv(t.spark, path, "combo STRING, odds DOUBLE")
    return rows.withColumn("line", F.lit(None).cast("string")).unionByName(rejects, allowMissingColumns=True)


@query(
    "export_tickets_csv",
    f"SELECT race_key, combo, {R6('prob')} AS prob, odds, ticket_group AS \"group\", stake FROM {{tickets}}",
)
def export_tickets_csv(t):
    path = fresh_path(t.spark, "tickets")
    rows = t.tickets.select("combo", "prob", "odds", F.col("ticket_group").alias("group"), "stake", "race_key")
    stores.export_tickets(rows, path)
    back = stores.read_csv(t.spark, path, "combo STRING, prob DOUBLE, odds DOUBLE, `group` STRING, stake INT, race_key BIGINT")
    return back.select(
        "race_key", F.regexp_replace("combo", "^'", "").alias("combo"), r6("prob").alias("prob"), "odds", "group", "stake"
    )


# Stored rows come from finished orders; open and pending ones bring changes.
@query(
    "upsert_last_wins",
    """SELECT o_orderkey AS race_key, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) * 2 END AS payout,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS seq FROM {orders}""",
)
def upsert_last_wins(t):
    value = F.floor("o_totalprice")
    rows = t.orders.select(F.col("o_orderkey").alias("race_key"), value.alias("payout"), F.lit(1).alias("seq"))
    table = Table.create(rows, fresh_path(t.spark, "payouts"), ["race_key"])
    changes = t.orders.filter("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("race_key"), (value * 2).alias("payout"), F.lit(2).alias("seq")
    )
    table.upsert(changes, "seq")
    return table.read()


@query(
    "insert_if_absent",
    """SELECT o_orderkey AS race_key, CASE WHEN o_orderstatus = 'F' THEN 'stored' ELSE 'new' END AS origin FROM {orders}""",
)
def insert_if_absent(t):
    key = F.col("o_orderkey").alias("race_key")
    table = t.orders.filter("o_orderstatus = 'F'").select(key, F.lit("stored").alias("origin"))
    return stores.insert_if_absent(table, t.orders.select(key, F.lit("new").alias("origin")), ["race_key"])


@query(
    "delete_by_key",
    """SELECT o_orderkey AS race_key, o_totalprice AS total, (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'P') AS n_removed
FROM {orders} WHERE o_orderstatus <> 'P'""",
)
def delete_by_key(t):
    """A stored table without the deleted keys, and how many rows the deletion took away."""
    rows = t.orders.select(F.col("o_orderkey").alias("race_key"), F.col("o_totalprice").alias("total"))
    table = Table.create(rows, fresh_path(t.spark, "orders"), ["race_key"])
    gone = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("race_key"))
    removed = table.delete(gone)
    return table.read().withColumn("n_removed", F.lit(removed).cast("long"))


@query(
    "result_exists_semi",
    "SELECT DISTINCT race_key FROM {race_entries} WHERE race_key IN (SELECT race_key FROM {official_results})",
)
def result_exists_semi(t):
    return t.race_entries.select("race_key").distinct().join(t.official_results, "race_key", "left_semi")


@query(
    "snapshot_first_wins",
    """SELECT user_id AS race_key, arg_min(event_id, (ts, event_id)) AS snapshot_id, min(ts) AS saved_at,
  arg_min(event_type, (ts, event_id)) AS snapshot_kind FROM {events} GROUP BY user_id""",
)
def snapshot_first_wins(t):
    saved = t.events.select(
        F.col("user_id").alias("race_key"), F.col("event_id").alias("snapshot_id"), F.col("ts").alias("saved_at"),
        F.col("event_type").alias("snapshot_kind"),
    )
    return joins.first_per_key(saved, ["race_key"], ["saved_at", "snapshot_id"])


@query(
    "prune_rolled_up",
    """SELECT race_key, combo, odds, fetched_at, arrival FROM {odds_samples}
WHERE race_key NOT IN (SELECT race_key FROM {odds_samples} GROUP BY race_key HAVING max(fetched_at) < DATE '2024-02-06' - 7)
  OR race_key NOT IN (SELECT race_key FROM {odds_results})""",
)
def prune_rolled_up(t):
    """Finished races whose newest sample is older than a week go whole; all others stay whole."""
    archive = OddsArchive.create(t.odds_samples, fresh_path(t.spark, "odds-archive"))
    archive.roll_up(t.odds_tickets, t.odds_results, "2024-02-06")
    return archive.samples.read()


@query(
    "rollup_cycle",
    f"""WITH {SERIES_SQL}, {TARGETS_SQL}
SELECT s.race_key, s.combo, t.stake, t.ticket_group, s.combo = r.actual_combo AS is_hit, odds_at_lock, odds_final, odds_min, odds_max,
  {R6('odds_final / odds_at_lock')} AS odds_drift, CAST(n_samples AS BIGINT) AS n_samples, first_at, last_at
FROM series s JOIN targets t ON t.race_key = s.race_key AND t.combo = s.combo JOIN {{odds_results}} r ON r.race_key = s.race_key""",
)
def rollup_cycle(t):
    """Four nightly runs, with samples that come after their race was rolled up and a last run that finds nothing new:
    the summary is that of all raw samples at once."""
    tickets, results = t.odds_tickets, t.odds_results
    early = F.col("fetched_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    archive = OddsArchive.create(t.odds_samples.filter(early), fresh_path(t.spark, "odds-archive"))
    archive.roll_up(tickets, results, "2024-01-21")
    archive.add(t.odds_samples.filter(~early | F.col("fetched_at").isNull()))
    for as_of in ("2024-02-06", "2024-03-01", "2024-03-02"):
        archive.roll_up(tickets, results, as_of)
    return rounded(archive.summary(tickets, results), "odds_drift").select(
        "race_key", "combo", "stake", "ticket_group", "is_hit", "odds_at_lock", "odds_final", "odds_min", "odds_max",
        "odds_drift", "n_samples", "first_at", "last_at",
    )
