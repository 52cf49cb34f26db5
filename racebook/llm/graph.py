"""Connected components of a table of links, by Spark jobs alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racebook.llm.common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b. One row a node of any link: node, component (the smallest node it can reach), was.

    A round gives every node the smallest label among its neighbours, then the label of its label, so labels
    travel in strides that double. Rounds are stored: lineage stays short and a lost executor costs one round.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        told = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("told"))
        heard = labels.join(told, labels["node"] == told["a"]).select("node", F.col("component").alias("was"), F.least("component", "told").alias("new"))
        of = labels.select(F.col("node").alias("of"), F.col("component").alias("its"))
        after = stored(heard.join(of, heard["new"] == of["of"]).select("node", "was", F.least("new", "its").alias("component")), "labels")
        drop_stored(labels)
        if after.where("component <> was").isEmpty():
            drop_stored(both)
            return after
        labels = after
