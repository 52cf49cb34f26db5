"""Queries over texts, landed pages and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from racebook.functions import scalars as S
from racebook.operators import features, stakes, text
from racebook.plans.registry import R6, query, r6, rounded
from racebook.sources.tables import spread

WS = r"'[\s　]+'"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {WS}, ' ', 'g'))"


def unescape_sql(x: str) -> str:
    for name, sign in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, '{name}', '{sign}')"
    return x


TEXT_SQL = norm_sql(
    unescape_sql(
        "regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    )
)


@query(
    "page_text_extract",
    f"""SELECT page_id, {norm_sql(unescape_sql("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
  regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  {norm_sql(unescape_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS heading, {TEXT_SQL} AS text,
  len(regexp_extract_all(html, '<a [^>]*href=')) AS links,
  TRY_CAST(regexp_extract(replace({TEXT_SQL}, ',', ''), '(-?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) AS first_number
FROM {{pages}}""",
)
def page_text_extract(t):
    return text.page_fields(spread(t.pages))


@query(
    "page_link_preferred",
    """SELECT page_id, entity, arg_min(href, (fb, pos)) AS href, min(fb) AS is_fallback FROM (
  SELECT page_id, href, pos, regexp_extract(href, '^/([A-Za-z])', 1) AS entity, contains(href, ',')::INT AS fb FROM (
    SELECT page_id, unnest(l) AS href, generate_subscripts(l, 1) AS pos
    FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM {pages})))
WHERE entity <> '' GROUP BY page_id, entity""",
)
def page_link_preferred(t):
    return text.preferred_links(t.pages, "^/([A-Za-z])", ",")


@query(
    "page_weather",
    """SELECT race_key, 15 + race_key % 12 + 5e-1 AS temperature, max(wave_height) AS wind_speed,
  (10 + race_key % 15)::DOUBLE AS water_temperature, (race_key % 6)::DOUBLE AS wave_height FROM {race_entries} GROUP BY race_key""",
)
def page_weather(t):
    return t.race_pages.select("race_key", *[c.alias(n) for n, c in text.before_info(F.col("page")).items()])


@query("page_start_exhibition", f"SELECT race_key, lane, {R6('exhibition_st')} AS exhibition_st FROM {{race_entries}}")
def page_start_exhibition(t):
    return rounded(text.start_exhibition(t.race_pages, "race_key", "page"), "exhibition_st")


@query(
    "page_course_values",
    f"""SELECT race_key, 'コース別3連対率' AS heading, lane AS course, CASE WHEN course_start_rank IS NOT NULL THEN {R6('course_top3_rate')} END AS value FROM {{race_entries}}
UNION ALL SELECT race_key, 'コース別スタート順', lane, {R6('course_start_rank')} FROM {{race_entries}}""",
)
def page_course_values(t):
    return rounded(text.six_values(t.race_pages, "race_key", "page", ["コース別3連対率", "コース別スタート順"]), "value")


@query(
    "page_deadline",
    """SELECT race_key, concat(8 + race_no - 1 + race_key % 3, ':', (race_no - 1) * 4 + 10) AS deadline
FROM (SELECT race_key, max(race_no) AS race_no FROM {race_entries} GROUP BY race_key)""",
)
def page_deadline(t):
    return t.race_pages.select("race_key", text.deadline_clock(F.col("page"), F.col("race_no")).alias("deadline"))


@query(
    "page_result",
    "SELECT race_key, trifecta, CASE WHEN trifecta_payout_per_100 >= 100 THEN trifecta_payout_per_100 END AS payout FROM {official_results}",
)
def page_result(t):
    page = F.concat(
        F.lit("払戻金 3連単 "), F.replace("trifecta", F.lit("-"), F.lit(" - ")), F.lit(" ¥"),
        F.format_number("trifecta_payout_per_100", 0), F.lit(" 12"),
    )
    combo, paid = text.official_payout(page)
    return t.official_results.select("race_key", combo.alias("trifecta"), paid.alias("payout"))


MARKERS = "The |Les |Der |El "


@query(
    "segment_by_lead",
    f"""SELECT doc_id, no, marker, trim(segment) AS segment FROM (
  SELECT doc_id, unnest(m) AS marker, unnest(p[2:]) AS segment, generate_subscripts(m, 1) - 1 AS no
  FROM (SELECT doc_id, regexp_extract_all(text, '({MARKERS})', 1) AS m, string_split_regex(text, '{MARKERS}') AS p FROM {{documents}}))""",
)
def segment_by_lead(t):
    return text.segments(t.documents, "doc_id", "text", MARKERS)


SMALL = text.Lexicon(
    phrases={
        "tempo": [("of the", 0.05), ("the ", -0.01)],
        "grip": [(" and ", 0.02), ("de la", 0.04), (" de ", -0.02)],
        "turn": [("ention", -0.03), ("tion", 0.01)],
        "ride": [(" und ", 0.05), ("der ", -0.02)],
        "general": [(" que ", 0.03), (" is ", -0.02), ("ción", 0.01)],
    },
    weights={"tempo": 0.27, "grip": 0.27, "turn": 0.26, "ride": 0.08, "general": 0.12},
    general="general",
    good="gut|bon",
    bad="mal|nicht",
    uncertain=["quizás", "peut", "perhaps", "shall"],
    forms=[("ations", "ation"), ("  ", " ")],
)


def lexicon_sql() -> str:
    axes = list(SMALL.weights)
    body = norm_sql("text")
    for old, new in SMALL.forms:
        body = f"replace({body}, '{old}', '{new}')"
    steps, prev = [f"b AS (SELECT doc_id, {body} AS body FROM {{documents}}), t0 AS (SELECT doc_id, body, body AS r FROM b)"], "t0"
    for k, (p, _, _) in enumerate(SMALL.ordered()):
        cols = "".join(f", c{j}" for j in range(k))
        steps.append(
            f"t{k + 1} AS (SELECT doc_id, body{cols}, (length(r) - length(replace(r, '{p}', ''))) // {len(p)} AS c{k},"
            f" replace(r, '{p}', repeat(chr(1), {len(p)})) AS r FROM {prev})"
        )
        prev = f"t{k + 1}"
    per_axis = {a: " + ".join(f"c{k} * {s!r}e0" for k, (_, i, s) in enumerate(SMALL.ordered()) if i == n) for n, a in enumerate(axes)}
    hits = " + ".join(f"c{k}" for k in range(len(SMALL.ordered())))
    steps.append(f"u0 AS (SELECT *, {hits} AS h0, " + " + ".join(f"contains(body, '{w}')::INT" for w in SMALL.uncertain) + f" AS doubts FROM {prev})")
    steps.append(
        f"u1 AS (SELECT *, h0 = 0 AND regexp_matches(body, '{SMALL.good}') AS good, h0 = 0 AND regexp_matches(body, '{SMALL.bad}') AS bad FROM u0)"
    )
    extra = " + CASE WHEN good THEN 0.3e0 ELSE 0 END - CASE WHEN bad THEN 0.35e0 ELSE 0 END - least(0.6e0, doubts * 0.18e0)"
    score = ", ".join(
        f"least(2e0, greatest(-2e0, {per_axis[a]}{extra if a == 'general' else ''})) AS score_{i}" for i, a in enumerate(axes)
    )
    steps.append(f"u2 AS (SELECT *, {score} FROM u1)")
    total = " + ".join(f"score_{i} * {w!r}e0" for i, w in enumerate(SMALL.weights.values()))
    steps.append(f"u3 AS (SELECT *, least(1.55e0, greatest(-1.55e0, {total})) AS total, h0 + good::INT + bad::INT AS hits FROM u2)")
    return (
        "WITH " + ", ".join(steps) + " SELECT doc_id, "
        + ", ".join(f"{R6(f'score_{i}')} AS score_{i}" for i in range(5))
        + f", {R6('total')} AS total, hits, CASE WHEN total >= 0.75 THEN '◎' WHEN total >= 0.3 THEN '○' WHEN total <= -0.75 THEN '×'"
        " WHEN total <= -0.3 THEN '△' ELSE '－' END AS grade, CASE WHEN body <> '' THEN round_even(least(0.9e0, 0.35e0 + 0.1e0 * hits)"
        " * CASE WHEN doubts > 0 THEN 0.78e0 ELSE 1 END, 3) ELSE 0 END AS confidence FROM u3"
    )


@query("lexicon_score", lexicon_sql())
def lexicon_score(t):
    out = text.score_comments(spread(t.documents.select("doc_id", "text")), "text", SMALL)
    cols = [f"score_{i}" for i in range(5)] + ["total"]
    return rounded(out.select("doc_id", *cols, "hits", "grade", "confidence"), *cols)


RULES = text.CommentRules(
    letters="[a-zà-ÿ]",
    table_words=["item", "table"],
    noise_words=["id", "no.", "&&&"],
    race_words=["the", "de", "und", "la"],
    natural_words=["is", "est", "on", "en"],
    score_words=["of", "les", "der", "que", "and"],
    stops=".!?",
)


def words_sql(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(s, '{w}')::INT" for w in words) + ")"


def count_sql(pattern: str) -> str:
    return f"len(regexp_extract_all(s, '{pattern}'))"


ZERO_SQL = "((length(s) - length(replace(s, '0.00', ''))) // 4)"


@query(
    "best_sentence",
    f"""WITH x AS (SELECT doc_id, trim(unnest(l)) AS s, generate_subscripts(l, 1) AS no FROM (
  SELECT doc_id, string_split(regexp_replace({norm_sql('text')}, '([.!?])\\s*', '\\1' || chr(1), 'g'), chr(1)) AS l FROM {{documents}})),
n AS (SELECT doc_id, s, no, {count_sql(RULES.letters)} + 12 * {words_sql(RULES.score_words)} - 8 * {count_sql(text.NUMBER)} - 50 * {ZERO_SQL} AS score
  FROM x WHERE s <> '' AND length(s) BETWEEN 5 AND 220 AND NOT (regexp_matches(s, '\\b[AB][12]\\)?\\s+\\d+')
    OR {count_sql(chr(92) + 'b' + chr(92) + 'd{4}' + chr(92) + 'b')} >= 2 OR {ZERO_SQL} >= 2 OR {count_sql(text.NUMBER)} >= 8
    OR {count_sql(chr(92) + 'd')} >= 14 OR {words_sql(RULES.noise_words)} >= 3)
  AND {count_sql(RULES.letters)} >= 5 AND {count_sql(text.NUMBER)} < 4
  AND NOT (regexp_matches(s, '(?:^|\\s)[AB][12](?:\\s|$|\\))') AND {count_sql(text.NUMBER)} >= 2)
  AND {words_sql(RULES.table_words)} < 2 AND {words_sql(RULES.race_words)} > 0 AND {words_sql(RULES.natural_words)} > 0)
SELECT doc_id, arg_max(s, (score, -no)) AS sentence, max(score) AS score FROM n GROUP BY doc_id""".replace("d{4}", "d[0-9][0-9][0-9]"),
)
def best_sentence(t):
    return text.best_sentences(spread(t.documents.select("doc_id", "text")), ["doc_id"], "text", RULES)


@query(
    "layout_majority",
    """WITH l AS (SELECT o.o_custkey AS table_no, i.l_orderkey, count(*) AS len, count(*) FILTER (WHERE l_returnflag = 'R') AS marked
  FROM {lineitem} i JOIN {orders} o ON o.o_orderkey = i.l_orderkey GROUP BY ALL),
m AS (SELECT table_no, len, count(*) AS n FROM l GROUP BY ALL)
SELECT t.table_no, t.typical_length, v.majority FROM (SELECT table_no, arg_max(len, (n, -len)) AS typical_length FROM m GROUP BY table_no) t
JOIN (SELECT table_no, count(*) FILTER (WHERE marked > 0) >= greatest(1, count(*) // 2) AS majority FROM l GROUP BY table_no) v USING (table_no)""",
)
def layout_majority(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("len"), F.count_if(F.col("l_returnflag") == "R").alias("marked")
    )
    rows = rows.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("table_no")), "l_orderkey")
    return text.layout(rows, "table_no", F.col("len"), F.col("marked") > 0)


@query(
    "status_classify",
    """SELECT race_key, regexp_extract(sale_text, '(初日|最終日|[0-9]{1,2}日目)', 1) AS day_label,
  CASE WHEN contains(sale_text, '最終R発売終了') THEN '開催終了'
    WHEN regexp_matches(sale_text, '[0-9]{1,2}R *[0-9]{1,2}:[0-9]{2}') THEN regexp_extract(sale_text, '([0-9]{1,2}R *[0-9]{1,2}:[0-9]{2})', 1)
    WHEN contains(sale_text, '発売開始前') THEN '発売開始前' ELSE '' END AS status,
  CASE WHEN contains(sale_text, '発売終了') THEN NULL ELSE TRY_CAST(regexp_extract(sale_text, '([0-9]{1,2})R *[0-9]', 1) AS INT) END AS next_race_no
FROM {order_texts}""".replace("{1,2}", "[0-9]?").replace("{2}", "[0-9]").replace("[0-9][0-9]?", "[0-9][0-9]?"),
)
def status_classify(t):
    s = F.col("sale_text")
    return t.order_texts.select(
        "race_key", S.day_label(s).alias("day_label"), S.sale_status(s).alias("status"),
        F.when(S.sale_status(s) != "開催終了", S.next_race_no(s)).alias("next_race_no"),
    )


@query(
    "numeric_coerce",
    """SELECT race_key, lane, part, CASE WHEN isfinite(v) THEN v END AS value, coalesce(CASE WHEN isfinite(v) THEN CAST(trunc(v) AS BIGINT) END, 0) AS whole
FROM (SELECT *, TRY_CAST(number_text AS DOUBLE) AS v FROM {number_texts})""",
)
def numeric_coerce(t):
    from racebook.operators.verify import number

    value = number(F.col("number_text"))
    return t.number_texts.select(
        "race_key", "lane", "part", value.alias("value"), F.coalesce(value.cast("long"), F.lit(0)).alias("whole")
    )


@query(
    "scalar_strings",
    f"""SELECT race_key, translate(wide_text, '０１２３４５６７８９－＃', '0123456789-#') AS narrow,
  CAST(replace(replace(replace(price_text, '￥', ''), '円', ''), ',', '') AS BIGINT) AS amount,
  TRY_CAST(regexp_extract(replace(price_text, ',', ''), '([0-9]+)', 1) AS DOUBLE) AS first_num,
  len(regexp_extract_all(iso_text, '-?[0-9]+')) AS n_numbers,
  concat(replace(replace(day_text, '-', ''), '/', ''), '_', lpad(CAST(racer_no % 24 + 1 AS VARCHAR), 2, '0'), '_', race_key % 12 + 1) AS key,
  string_split(priority, '-')[1] AS level, list_contains(string_split(priority, '-'), 'HIGH') AS is_high,
  contains(priority, 'URGENT')::INT + contains(priority, 'HIGH')::INT + contains(priority, 'I')::INT AS words,
  concat_ws(' / ', nullif(priority, '5-LOW'), status) AS joined FROM {{order_texts}}""",
)
def scalar_strings(t):
    c = F.col
    return t.order_texts.select(
        "race_key",
        S.narrow(c("wide_text")).alias("narrow"),
        S.money(c("price_text")).alias("amount"),
        S.first_number(c("price_text")).alias("first_num"),
        F.size(S.all_numbers(c("iso_text"))).alias("n_numbers"),
        S.race_key(c("day_text"), c("racer_no") % 24 + 1, c("race_key") % 12 + 1).alias("key"),
        F.split("priority", "-")[0].alias("level"),
        F.array_contains(F.split("priority", "-"), "HIGH").alias("is_high"),
        S.count_words(c("priority"), ["URGENT", "HIGH", "I"]).alias("words"),
        F.concat_ws(" / ", F.nullif(c("priority"), F.lit("5-LOW")), "status").alias("joined"),
    )


@query(
    "scalar_dates",
    """SELECT race_key, day, strftime(day, '%Y%m%d') AS compact, CAST(concat(day, ' ', clock_text, ':00') AS TIMESTAMP) - INTERVAL 9 HOUR AS deadline,
  iso, date_diff('minute', CAST(day AS TIMESTAMP), iso) AS age_minutes, iso + INTERVAL 120 MINUTE AS give_up_at FROM (
  SELECT race_key, clock_text, strptime(replace(replace(day_text, '-', ''), '/', ''), '%Y%m%d')::DATE AS day,
    CAST(substr(iso_text, 1, 19) AS TIMESTAMP) - CASE WHEN iso_text LIKE '%+09:00' THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END AS iso
  FROM {order_texts})""",
)
def scalar_dates(t):
    c = F.col
    d = t.order_texts.select("race_key", "clock_text", S.day(c("day_text")).alias("day"), S.iso_time(c("iso_text")).alias("iso"))
    return d.select(
        "race_key",
        "day",
        F.date_format("day", "yyyyMMdd").alias("compact"),
        S.japan_time(c("day"), c("clock_text")).alias("deadline"),
        "iso",
        S.minutes_between(c("iso"), c("day").cast("timestamp_ntz")).cast("long").alias("age_minutes"),
        (c("iso") + F.make_dt_interval(mins=F.lit(120))).alias("give_up_at"),
    )


@query(
    "scalar_math",
    f"""SELECT race_key, lane, {R6('exp(-racer_win_rate)')} AS e, {R6('pow(racer_win_rate, 0.8e0)')} AS p, {R6('sqrt(motor_2ren)')} AS s,
  {R6('ln(1 + motor_2ren)')} AS l, least(greatest(motor_2ren, 20), 60) AS clipped, CAST(floor(boat_2ren) AS BIGINT) AS whole,
  CAST(100 * round_even(motor_2ren * 1e1 / 1e2, 0) AS INT) AS stake, round_even(boat_2ren, 1) AS one_place,
  {R6('abs(racer_win_rate - local_win_rate)')} AS gap, CAST(floor(1235 * (race_key % 9) * 5e1 / 1e2) AS BIGINT) AS paid FROM {{race_entries}}""",
)
def scalar_math(t):
    c = F.col
    return t.race_entries.select(
        "race_key",
        "lane",
        r6(F.exp(-c("racer_win_rate"))).alias("e"),
        r6(F.pow("racer_win_rate", F.lit(0.8))).alias("p"),
        r6(F.sqrt("motor_2ren")).alias("s"),
        r6(F.log1p("motor_2ren")).alias("l"),
        features.clip(c("motor_2ren"), 20.0, 60.0).alias("clipped"),
        F.floor("boat_2ren").alias("whole"),
        stakes.round_to_unit(c("motor_2ren") * 10, 100).alias("stake"),
        F.bround("boat_2ren", 1).alias("one_place"),
        r6(F.abs(c("racer_win_rate") - c("local_win_rate"))).alias("gap"),
        F.floor(F.lit(1235) * (c("race_key") % 9) * 50.0 / 100).alias("paid"),
    )


@query(
    "scalar_arrays_maps",
    f"""SELECT race_key, array_to_string(list(lane ORDER BY lane)[1:3], '-') AS first_lanes, count(DISTINCT lane) AS n_lanes, arg_min(lane, (-p_first, lane)) AS best_lane,
  {R6('coalesce(max(CASE WHEN lane = 6 THEN p_first END), 0)')} AS p6, count(*) FILTER (WHERE lane IN (1, 2, 3)) AS kept,
  list_position(list(lane ORDER BY lane), 4) AS position_of_4 FROM {{win_probs}} GROUP BY race_key""",
)
def scalar_arrays_maps(t):
    d = t.win_probs.groupBy("race_key").agg(
        F.map_from_entries(F.collect_list(F.struct("lane", "p_first"))).alias("m")
    )
    lanes = F.array_sort(F.map_keys("m"))
    best = F.array_max(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"], -e["key"], e["key"].alias("lane"))))
    return d.select(
        "race_key",
        F.array_join(F.slice(lanes, 1, 3), "-").alias("first_lanes"),
        F.size(F.array_distinct(lanes)).alias("n_lanes"),
        best.getField("lane").alias("best_lane"),
        r6(F.coalesce(F.try_element_at("m", F.lit(6)), F.lit(0.0))).alias("p6"),
        F.size(F.map_filter("m", lambda k, v: k.isin(1, 2, 3))).alias("kept"),
        F.nullif(F.array_position(lanes, 4), F.lit(0)).alias("position_of_4"),
    )
