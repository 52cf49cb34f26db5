"""Dropping of common lines against a plain version."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from racebook.llm import lines, plans

SCHEMA = "doc_id LONG, text STRING, place INT, r1 STRING"


def plain(rows, least=3, shortest=20):
    small = str.maketrans(lines.UPPER, lines.LOWER)
    key = lambda line: line.strip(lines.BLANKS).translate(small)
    holders = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                holders[key(line)].add(doc_id)
    keeper = {k: max(d for d in ids if d is not None) for k, ids in holders.items() if len(ids) >= least}
    out = []
    for doc_id, text, *_ in rows:
        every = (text or "").split("\n")
        left = [x for x in every if key(x) not in keeper or keeper[key(x)] == doc_id]
        out.append((doc_id, len(every), len(every) - len(left), "\n".join(left)))
    return out


def odd_rows():
    rng = random.Random(8)
    common = [f"This line stands in many documents, number {i}" for i in range(12)]
    common += ["  \tÉCOLE et Écriture de la langue\r", "écOLE et Écriture de la langue", "x" * 19, "y" * 20, "É" * 20, "🙂" * 20, " " + "z" * 25, "z" * 25 + "  "]
    rows = []
    for i in range(70):
        own = [f"own line {i} {rng.random()}" for _ in range(rng.randint(0, 5))]
        picked = [rng.choice([str.upper, str.lower, lambda s: f" \x0b{s}\x0c "])(rng.choice(common)) for _ in range(rng.randint(0, 8))]
        both = own + picked + [""] * rng.randint(0, 2)
        rng.shuffle(both)
        rows.append((i, "\n".join(both)))
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n" + common[0]), (-4, "\n".join([common[1]] * 5000 + ["end"])), (105, "q" * 300_000)]
    rows += [(None, common[2] + "\nwithout an id"), (None, common[3]), (7, common[4] + "\n7 again"), rows[5], rows[5], rows[6]]
    rows += [(50 + i % 2, "two holders are too few for this line") for i in range(6)]
    return [(*r, i, "clash") for i, r in enumerate(rows)]


@pytest.mark.parametrize("few, keys", [(4096, 1 << 15), (2, 40)])
def test_lines_equal_plain_version(spark, monkeypatch, few, keys):
    """The second run deals nearly every key out."""
    monkeypatch.setattr(lines, "FEW", few)
    monkeypatch.setattr(lines, "HOT_KEYS", keys)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = lines.without_common_lines(docs)
    assert out.columns == [*docs.columns, *(lines.OWN + c for c in ("n_lines", "n_dropped", "kept"))]
    got = {r.place: (r.doc_id, r[lines.OWN + "n_lines"], r[lines.OWN + "n_dropped"], r[lines.OWN + "kept"]) for r in out.collect()}
    assert [got[i] for i in range(len(rows))] == plain(rows)
    assert sum(n for _, _, n, _ in got.values()) > 5000


def test_query_and_empty_table(spark):
    rows = odd_rows()
    got = sorted(map(repr, map(tuple, plans.op11_line_dedup(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == sorted(repr((i, n, d, hashlib.sha256(t.encode()).hexdigest())) for i, n, d, t in plain(rows))
    assert plans.op11_line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_line_of_a_third_of_all_rows(spark):
    """Hot line, hot id and hot row at once; no task has more than its share of them."""
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("a very common line of text\nsecond").alias("text"))
    out = lines.without_common_lines(hot)
    n = {r.n: r["count"] for r in out.groupBy(F.col(lines.OWN + "n_dropped").alias("n")).count().collect()}
    assert n == {1: 29_999, 0: 1}


def test_plan_has_no_python(spark):
    out = lines.without_common_lines(spark.createDataFrame(odd_rows(), SCHEMA))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
