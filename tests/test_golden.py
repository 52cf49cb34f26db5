"""Small cases worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from racebook import constants as K
from racebook.functions import ranks, scalars
from racebook.operators import features, model, odds, stakes, text, trifecta, verify
from racebook.schemas import PAYLOAD, conform, require_columns
from racebook.sources import stores


def one_race(spark, values, name="v"):
    return spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(values)], f"race_key INT, lane INT, {name} DOUBLE")


def scores(df, col):
    return [r[0] for r in df.orderBy("lane").select(col).collect()]


def test_rank_score(spark):
    d = ranks.with_race_values(one_race(spark, [6.7, 6.8, 6.8, 6.9]), ["v"])
    assert scores(d, ranks.lower_better("v")) == [1.0, 0.0, 0.0, -1.0]
    assert scores(d, ranks.higher_better("v")) == [-1.0, 0.0, 0.0, 1.0]


def test_rank_score_needs_two_values(spark):
    d = ranks.with_race_values(one_race(spark, [6.7, None, None]), ["v"])
    assert scores(d, ranks.lower_better("v")) == [0.0, 0.0, 0.0]


def test_gate(spark):
    d = ranks.with_race_values(one_race(spark, [6.7, 6.8, 6.9, None, None, None]), ["v"])
    assert scores(d, ranks.gated("v", 4)) == [0.0] * 6


def test_percent_rank(spark):
    d = one_race(spark, [1.0, 2.0, 2.0, None])
    got = scores(d, ranks.percent_rank_average(F.col("v"), ranks.race_window()))
    assert got == pytest.approx([1 / 3, 2.5 / 3, 2.5 / 3, 0.0])


def test_equal_runners_without_priors(spark):
    d = one_race(spark, [1 / 6] * 6, "p_first")
    got = trifecta.trifecta(d, course_weight=0, course_weight_3rd=0).collect()
    assert len(got) == 120
    assert all(r.prob == pytest.approx(1 / 120) for r in got)


def test_priors_are_shares():
    for row in K.SECOND_PRIOR.values():
        assert sum(row.values()) == pytest.approx(1, abs=2e-3)
    assert sum(K.THIRD_PRIOR.values()) == pytest.approx(1, abs=2e-3)


def test_trifecta_of_a_full_field_by_hand(spark):
    p = [0.45, 0.20, 0.15, 0.10, 0.06, 0.04]
    raw = {}
    for a in range(6):
        for b in range(6):
            for c in range(6):
                if len({a, b, c}) < 3:
                    continue
                second = 0.6 * p[b] ** 0.8 / sum(p[k] ** 0.8 for k in range(6) if k != a) + 0.4 * K.SECOND_PRIOR[a + 1][b + 1]
                rest = [k for k in range(6) if k not in (a, b)]
                third = 0.7 * p[c] ** 0.65 / sum(p[k] ** 0.65 for k in rest) + 0.3 * K.THIRD_PRIOR[rest.index(c) + 1]
                raw[f"{a + 1}-{b + 1}-{c + 1}"] = p[a] * second * third
    total = sum(raw.values())
    got = {r.combo: r.prob for r in trifecta.trifecta(one_race(spark, p, "p_first")).collect()}
    assert got == pytest.approx({k: v / total for k, v in raw.items()})


def test_calibration_edges(spark):
    rows = [(0.2, True), (1.0, False), (None, True), (0.59, True)]
    d = spark.createDataFrame(rows, "p1_prob DOUBLE, predicted_first_hit BOOLEAN")
    got = {r.band: (r.races, r.mean_predicted, r.actual_rate) for r in verify.calibration(d).collect()}
    assert got["20-40%"] == (1, 20.0, 100.0)
    assert got["80-100%"] == (1, 100.0, 0.0)
    assert got["0-20%"] == (0, None, None)
    assert len(got) == 5


def test_payout_cuts_fractions(spark):
    d = spark.createDataFrame([(1235, 150)], "p INT, s INT")
    assert d.select(verify.payout(F.col("p"), F.col("s"))).first()[0] == 1852


def test_round_to_unit_halves_go_to_even(spark):
    d = spark.createDataFrame([(150.0,), (250.0,)], "x DOUBLE")
    assert [r[0] for r in d.select(stakes.round_to_unit(F.col("x"), 100)).collect()] == [200, 200]


def test_start_times(spark):
    rows = [(".14", 0.14), ("F.03", -0.03), ("L", None), ("0.14", 0.14), ("", None), ("F12", -0.12), (".1", 0.01)]
    d = spark.createDataFrame([(a,) for a, _ in rows], "t STRING")
    assert [r[0] for r in d.select(features.start_time(F.col("t"))).collect()] == [b for _, b in rows]


def test_truthy_and_numbers(spark):
    d = spark.createDataFrame([("True",), ("1",), ("no",), (None,)], "t STRING")
    assert [r[0] for r in d.select(verify.truthy(F.col("t"))).collect()] == [True, True, False, None]
    d = spark.createDataFrame([("1.5",), ("nan",), ("1e400",), ("x",)], "t STRING")
    assert [r[0] for r in d.select(verify.number(F.col("t"))).collect()] == [1.5, None, None, None]


def test_broken_payload_goes_to_quarantine(spark):
    good = '{"final":[{"lane":1,"p_first":0.5}],"tickets":[{"combo":"1-2-3","stake":100}]}'
    d = spark.createDataFrame([(1, good), (2, "{"), (3, None), (4, '{"final":[],"tickets":[]}')], "race_key INT, payload_json STRING")
    ok, quarantine = verify.split_broken(d)
    assert [r.race_key for r in ok.collect()] == [1]
    assert sorted(r.race_key for r in quarantine.collect()) == [2, 3, 4]


def test_documents_in_both_forms(spark):
    rows = [('[{"lane":1,"p_first":0.5}]',), ('{"final":[{"lane":2,"p_first":0.4}],"research":{}}',), ("{",)]
    d = spark.createDataFrame(rows, "doc STRING")
    got = [r[0] for r in d.select(verify.lanes_of_document(F.col("doc"))).collect()]
    assert got[0][0].lane == 1 and got[1][0].lane == 2 and got[2] is None
    assert "research" in PAYLOAD


def test_verification_record(spark):
    doc = (
        '{"final":[{"lane":1,"p_first":0.5},{"lane":2,"p_first":0.5},{"lane":9,"p_first":0.9}],'
        '"tickets":[{"combo":"2-1-3","prob":0.1,"stake":300},{"combo":"1-2-3","prob":0.2,"odds":8.0,"stake":150},'
        '{"combo":"3-2-1","prob":0.05,"stake":0}]}'
    )
    snaps = spark.createDataFrame([(1, doc)], "race_key INT, payload_json STRING")
    official = spark.createDataFrame([(1, 1, 2, 3, 1235)], "race_key INT, first INT, second INT, third INT, trifecta_payout_per_100 INT")
    r = verify.verification_records(snaps, official).first()
    assert (r.p1_lane, r.top_ticket, r.top_ticket_odds, r.total_stake, r.payout, r.profit) == (1, "1-2-3", 8.0, 450, 1852, 1402)
    assert r.hit_top_ticket and r.hit_any_ticket and r.predicted_first_hit


def test_race_state(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [
        ("before", at(9), at(12), False, True),
        ("waiting", at(9), at(10), False, True),
        ("done", at(9), at(10), True, True),
        ("no snapshot", at(9), at(10), False, False),
        ("too long", at(5), at(8), False, True),
        ("no deadline", at(9), None, False, True),
        ("no deadline, old", at(7), None, False, True),
    ]
    d = spark.createDataFrame(rows, "k STRING, created_at TIMESTAMP_NTZ, deadline TIMESTAMP_NTZ, has_result BOOLEAN, has_snapshot BOOLEAN")
    got = {r.k: r.state for r in odds.race_state(d, "2024-01-01 11:00:00").collect()}
    assert got == {
        "before": "ACTIVE", "waiting": "WAIT_RESULT", "done": "DONE", "no snapshot": "DONE", "too long": "TIMEOUT",
        "no deadline": "ACTIVE", "no deadline, old": "TIMEOUT",
    }


def test_rollup_of_a_series(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    rows = [(1, "1-2-3", 8.0, t(5), 2), (1, "1-2-3", 10.0, t(0), 1), (1, "1-2-3", 0.5, t(7), 3), (1, "6-5-4", 99.0, t(0), 4), (2, "1-2-3", 5.0, t(0), 5)]
    samples = spark.createDataFrame(rows, "race_key INT, combo STRING, odds DOUBLE, fetched_at TIMESTAMP_NTZ, arrival INT")
    bets = spark.createDataFrame([(1, "1-2-3", 100, "本線", 0.2)], "race_key INT, combo STRING, stake INT, ticket_group STRING, ai_prob DOUBLE")
    done = spark.createDataFrame([(1, "6-5-4")], "race_key INT, actual_combo STRING")
    got = {r.combo: r for r in odds.rollup(samples, bets, done).collect()}
    r = got["1-2-3"]
    assert (r.odds_at_lock, r.odds_final, r.odds_drift, r.n_samples, r.was_purchased, r.is_hit) == (10.0, 8.0, 0.8, 2, True, False)
    assert r.ev_at_lock == pytest.approx(2.0)
    hit = got["6-5-4"]
    assert hit.is_hit and not hit.was_purchased and hit.stake == 0 and hit.ai_prob is None
    assert len(got) == 2


def test_races_are_rolled_up_whole(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, "1-2-3", 10.0, day(10), 1), (1, "1-2-3", 8.0, day(16), 2), (2, "1-2-3", 5.0, day(10), 3), (3, "1-2-3", 4.0, day(9), 4), (3, "1-2-3", 6.0, None, 5)]
    samples = spark.createDataFrame(rows, "race_key INT, combo STRING, odds DOUBLE, fetched_at TIMESTAMP_NTZ, arrival INT")
    bets = spark.createDataFrame([(k, "1-2-3", 100, "本線", 0.2) for k in (1, 2, 3)], "race_key INT, combo STRING, stake INT, ticket_group STRING, ai_prob DOUBLE")
    done = spark.createDataFrame([(1, "1-2-3"), (3, "1-2-3")], "race_key INT, actual_combo STRING")
    first, left = stores.rollup_then_prune(samples, bets, done, "2024-01-20")
    assert [(r.race_key, r.n_samples) for r in first.collect()] == [(3, 1)]  # race 1 still has a sample of the last days
    assert sorted(r.arrival for r in left.collect()) == [1, 2, 3]
    second, left = stores.rollup_then_prune(left, bets, done, "2024-01-25", summary=first)
    got = {r.race_key: r for r in second.collect()}
    assert sorted(got) == [1, 3] and got[3].n_samples == 1
    r = got[1]
    assert (r.odds_at_lock, r.odds_final, r.odds_max, r.n_samples, r.first_at, r.last_at) == (10.0, 8.0, 10.0, 2, day(10), day(16))
    assert [r.arrival for r in left.collect()] == [3]


def test_conform(spark):
    d = spark.createDataFrame([("1", "x", 3)], "a STRING, b STRING, extra INT")
    out = conform(d, "b INT, a INT, c DOUBLE, n INT", {"n": 7})
    assert out.columns == ["b", "a", "c", "n"]
    assert tuple(out.first()) == (None, 1, None, 7)


def test_required_columns_are_named_in_order(spark):
    d = spark.createDataFrame([(1,)], "lane INT")
    with pytest.raises(ValueError, match="avg_st, boat_2ren, finish"):
        require_columns(d, ["finish", "lane", "boat_2ren", "avg_st"])
    with pytest.raises(ValueError, match="missing columns"):
        model.Preparation.fit(d)


def test_comment_phrases(spark):
    rows = [
        ("伸びはかなりいい。", 1.55, 0.0, 1), ("出足が良かった", 0.0, 1.05, 1), ("", 0.0, 0.0, 0), ("いい感じ", 0.0, 0.0, 1),
        ("伸びがいい　伸びがいい", 2.0, 0.0, 2),
    ]
    d = spark.createDataFrame([(r[0],) for r in rows], "c STRING")
    got = text.score_comments(d, "c").collect()
    for r, (_, stretch, start, hits) in zip(got, rows):
        assert (r.score_0, r.score_1, r.hits) == (pytest.approx(stretch), pytest.approx(start), hits)
    assert got[0].summary.startswith("○ 伸び")
    assert got[2].summary == "未入力" and got[2].confidence == 0
    assert got[3].score_4 == pytest.approx(0.30)


def test_best_comment(spark):
    body = "足は全体的にいい感じです。 3 2 1 通算 近況 勝率。ターン回りは良くないけど伸びは十分だと思うし出足もいいです。"
    d = spark.createDataFrame([(1, body)], "k INT, c STRING")
    assert text.best_sentences(d, ["k"], "c").first().sentence.startswith("ターン回り")


def test_full_width_forms(spark):
    d = spark.createDataFrame([("Ａ１２　ｂ",), ("ｶﾅ①",)], "t STRING")
    assert d.select(scalars.narrow(F.col("t"))).first()[0] == "A12 b"
    assert d.select(scalars.nfkc("t")).collect()[1][0] == "カナ1"


def test_six_values_and_payout(spark):
    page = "コース別3連対率 1 55.0% 2 -- 3 40% コース別スタート順 1 2.5 6 - "
    d = spark.createDataFrame([(1, page)], "k INT, page STRING")
    got = {(r.heading, r.course): r.value for r in text.six_values(d, "k", "page", ["コース別3連対率", "コース別スタート順"]).collect()}
    assert got == {
        ("コース別3連対率", 1): 55.0, ("コース別3連対率", 2): None, ("コース別3連対率", 3): 40.0,
        ("コース別スタート順", 1): 2.5, ("コース別スタート順", 6): None,
    }
    d = spark.createDataFrame([("3連単 1 - 2 - 3 ￥1,230円 5",), ("3連単 なし",)], "t STRING")
    combo, paid = text.official_payout(F.col("t"))
    assert [tuple(r) for r in d.select(combo, paid).collect()] == [("1-2-3", 1230), (None, None)]


def test_sale_status_precedence(spark):
    rows = [("最終R発売終了 3R 10:25", "開催終了"), ("2日目 3R 10:25", "3R 10:25"), ("発売開始前", "発売開始前"), ("", "")]
    d = spark.createDataFrame([(a,) for a, _ in rows], "t STRING")
    assert [r[0] for r in d.select(scalars.sale_status(F.col("t"))).collect()] == [b for _, b in rows]
