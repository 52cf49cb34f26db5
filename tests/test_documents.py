"""Stored documents as VARIANT, and names as folded keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from racebook.operators import documents, joins
from racebook.plans.catalog import QUERIES
from racebook.sources.adapters import Source

LANE = '{"lane":1,"racer_name":"A","p_first":0.5,"reason":"x"}'


def read(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k INT, payload_json STRING")
    return [r.payload for r in documents.read_documents(df).orderBy("k").collect()]


def test_both_forms_and_what_is_no_document(spark):
    new, old, cut, blank, none, number = read(spark, f'{{"final":[{LANE}],"tickets":[]}}', f"[{LANE}]", '{"final":[{"la', "", None, "3")
    assert new.final == old.final and tuple(new.final[0]) == (1, "A", 0.5, "x")
    assert new.tickets == [] and old.tickets is None and new.research is None
    assert cut is blank is none is None and number.final is None


def test_one_bad_value_costs_that_value_alone(spark):
    (got,) = read(spark, f'{{"final":[{{"lane":"two","p_first":"0.25","other":[1]}},{LANE},7,null]}}')
    assert [tuple(x) for x in got.final[:2]] == [(None, None, 0.25, None), (1, "A", 0.5, "x")]
    assert len(got.final) == 4


def test_numbers_that_json_does_not_know_are_missing_and_texts_stay(spark):
    text = r'{"final":[{"lane":1,"racer_name":"NaN, \"Infinity\": [NaN]","p_first":NaN,"reason":"-Infinity"},{"lane":2,"p_first":-Infinity},{"lane":3,"p_first":"NaN"}],"research":{"base":[{"lane":4,"p_first":Infinity}],"bad":1}}'
    (got,) = read(spark, text)
    assert [tuple(x) for x in got.final] == [(1, 'NaN, "Infinity": [NaN]', None, "-Infinity"), (2, None, None, None), (3, None, None, None)]
    assert tuple(got.research["base"][0])[:3] == (4, None, None) and got.research["bad"] is None


def test_long_documents_with_many_signs(spark):
    long = "NaN \\\" " * 100_000
    (got,) = read(spark, f'{{"final":[{{"lane":1,"racer_name":"{long}","p_first":NaN}}]}}')
    assert len(got.final[0].racer_name) == len(long) - 100_000 and got.final[0].p_first is None


def test_names_meet_in_every_form(spark):
    racers = spark.createDataFrame([(1, "ガ A1"), (2, None), (3, "é")], "racer_no INT, racer_name STRING")
    rows = [("ｶﾞＡ１", "half", 2), ("ガ　A 1", "parts", 1), (None, "nobody", 0), ("é", "accent", 0)]
    comments = spark.createDataFrame(rows, "name STRING, comment STRING, entry INT")
    got = {r.racer_no: r.comment for r in joins.comments_by_name(racers, comments, "entry").collect()}
    assert got == {1: "parts", 2: None, 3: "accent"}
    keys = racers.select(joins.name_key(F.col("racer_name")).alias("k")).collect()
    assert [r.k for r in keys] == ["ガA1", None, "é"]


def test_each_spelling_is_folded_once_and_the_first_entry_counts(spark):
    racers = spark.createDataFrame([(1, "ガA"), (2, "none")], "racer_no INT, racer_name STRING")
    rows = [("ｶﾞ A", "late", 9), ("ガA", "mid", 5), ("ガ　A", "first", 2), ("ガ　A", "later", 7), ("ガA", "no order", None)]
    out = joins.comments_by_name(racers, spark.createDataFrame(rows, "name STRING, comment STRING, entry INT"), "entry")
    assert {r.racer_no: r.comment for r in out.collect()} == {1: "first", 2: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    folding = plan.split("Join")[1].split("EvalPython")
    assert any("Aggregate [name" in below for below in folding[1:])


def test_no_projection_is_left_to_the_interpreter(spark):
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        for given, kept in [("65535", "8000"), ("20000", "20000")]:
            spark.conf.set(limit, given)
            Source(spark, "/root/testdata/sf0.001")
            assert spark.conf.get(limit) == kept
    finally:
        spark.conf.set(limit, before)


def test_a_document_is_parsed_and_written_once_a_row(spark):
    count = lambda name: (lambda p: [p.count(f"{x}(") for x in ("get_json_object", "regexp_replace", "from_json")])(
        QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    )
    # lanes alone stand in two of the forms; one text is made odd, one is cleared of numbers that are none
    assert count("documents_as_variant") == [2, 2, 0]
    assert count("verification_without_tickets") == [2, 0, 1]
    assert count("ablation_report") == [0, 0, 1]
