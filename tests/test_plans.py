"""Shapes of physical plans: no pairing of everything with everything, no needless shuffle."""

import pytest

from racebook.plans.catalog import QUERIES
from racebook.sources.adapters import Source

SF = "/root/testdata/sf0.001"
# these run a job while the query is built
EAGER = {"win_model_scores", "feature_impute_scale"} | {n for n in QUERIES if n.startswith("stream_")}


def plan(df):
    execution = df._jdf.queryExecution()
    return df.sparkSession._jvm.PythonSQLUtils.explainString(execution, "simple")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_product(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def shuffles(text):
    return text.count("Exchange hashpartitioning")


@pytest.mark.parametrize(
    "name,most",
    [
        # one to aggregate source rows per lane, one to bring a race together
        ("adjusted_win_prob", 2),
        ("ablation_variants", 2),
        ("prob_delta", 2),
        ("favourite_risk", 2),
        # one more to spread the races before they become 120 rows each, then none
        ("trifecta_probs", 3),
        ("tickets_ranked", 3),
        ("stakes_smart", 3),
        ("odds_5min_bars", 1),
        ("odds_sessions", 3),
    ],
)
def test_shuffles(spark, name, most):
    assert shuffles(plan(QUERIES[name](spark, SF))) <= most


@pytest.mark.parametrize("name", ["odds_5min_bars", "odds_asof_lock", "rank_score_lower", "metrics_overall"])
def test_raw_rows_are_aggregated_by_hash(spark, name):
    lines = plan(QUERIES[name](spark, SF)).splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and ("events" in line or "lineitem" in line)]
    for i in scans:
        above = next(line for line in reversed(lines[:i]) if "Aggregate(" in line)
        assert "+- HashAggregate" in above or above.strip().startswith("HashAggregate")


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["trifecta_probs"](spark, SF))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in scan


def test_odds_filter_is_pushed_down(spark):
    text = plan(QUERIES["odds_5min_bars"](spark, SF))
    assert "GreaterThanOrEqual(value,1.0)" in text


@pytest.mark.parametrize("name", ["odds_left_join", "exclude_used_anti"])
def test_ticket_windows_run_over_finer_partitions(spark, name):
    text = plan(QUERIES[name](spark, SF))
    finer = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning(race_key" in line and "combo" not in line]
    assert exchanges
    assert all(f", {finer})" in line and "REPARTITION_BY_NUM" in line for line in exchanges)


@pytest.mark.parametrize("name,most", [("tickets_ranked", 10), ("stakes_smart", 15), ("stakes_largest_remainder", 13)])
def test_sums_share_the_window_step_of_an_ordering(spark, name, most):
    """Each step generates classes, and a stage with more of them than Spark's cache holds compiles them in every task."""
    lines = [line.lstrip(" +-:") for line in plan(QUERIES[name](spark, SF)).splitlines()]
    assert 0 < sum(line.startswith("Window") for line in lines) <= most


def test_tasks_of_outcomes_grow_with_the_races(spark, monkeypatch):
    """A fixed number of tasks would each sort more and more outcomes and spill them."""
    monkeypatch.setattr("racebook.operators.trifecta.TASK_RACES", 10)
    tasks = -(-(Source(spark, SF).lineitem.count() // 3) // 10)
    assert tasks > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {tasks}), REPARTITION_BY_NUM" in plan(QUERIES["tickets_cover"](spark, SF))
