"""Wall time of the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query runs once to
warm up; the better of two further runs counts. All run over the whole tables into a sink that
keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from racebook.plans.catalog import QUERIES
from racebook.session import build_session

HEADLINE = [
    "odds_rollup", "odds_asof_lock", "odds_5min_bars", "odds_sliding_change", "odds_sessions", "top_movers",
    "race_card_left_join", "adjusted_win_prob", "ablation_variants", "trifecta_probs", "tickets_ranked", "stakes_smart",
    "verification_record", "metrics_overall", "calibration_table", "perf_grouping_sets", "ablation_report",
    "feature_impute_scale", "lexicon_score", "best_sentence", "page_text_extract", "stream_odds_ingest", "stream_odds_bars",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(min(run(spark, name, sf_dir) for _ in range(2)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
