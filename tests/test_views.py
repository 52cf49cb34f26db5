"""Views by name give what the direct queries give."""

from pyspark.sql import functions as F

from racebook.operators import verify
from racebook.plans.verify import result_rows
from racebook.sources.adapters import Source
from racebook.sources.views import register_views

SF = "/root/testdata/sf0.001"


def rows(df, *keys):
    return sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df.select(*keys).collect())


def test_views_equal_direct_queries(spark):
    t = Source(spark, SF)
    results = result_rows(t)
    assert len(register_views(results, t.tickets, t.official_results)) == 6
    direct = verify.performance(results, "venue_no")
    assert rows(spark.sql("SELECT * FROM perf_by_venue"), *direct.columns) == rows(direct, *direct.columns)
    direct = verify.ticket_performance(t.tickets, t.official_results, F.col("ticket_group"), "ticket_group")
    assert rows(spark.table("perf_by_ticket_group"), *direct.columns) == rows(direct, *direct.columns)
    ev = verify.ev_band(F.col("prob") * F.col("odds"))
    direct = verify.ticket_performance(t.tickets, t.official_results, ev, "ev_band")
    assert rows(spark.table("perf_by_ev_band"), *direct.columns) == rows(direct, *direct.columns)
    register_views(results.limit(0), t.tickets.limit(0), t.official_results)
    assert spark.table("perf_by_lane").count() == 0 and spark.table("perf_overall").count() == 1
