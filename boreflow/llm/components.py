"""Connected components of an edge table by label passing with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boreflow.llm.text import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Labels stay in tables: each round passes the smallest label over the edges, then replaces
    every label by its own label (which halves long chains), and writes the result to the shared
    folder. Sums before the shuffle and the skew join bound what one hub sends to a task. Only
    the number of changed labels reaches the driver. An empty edge table gives no rows.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("nb")).select("node", F.least("node", "nb").alias("root")))
    while True:
        offers = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("offer"))
        passed = labels.join(offers, "node").select("node", F.col("root").alias("old"), F.least("root", "offer").alias("root"))
        own = passed.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = materialize(passed.join(own, "root").select("node", "old", F.col("next").alias("root")))
        labels = jumped.select("node", "root")
        if jumped.filter("root <> old").limit(1).count() == 0:
            return labels
