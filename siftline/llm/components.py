"""Connected components of an edge table, by label spreading with shortcuts; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import forget, settle


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node reachable.

    Rounds alternate large-star and small-star: each node's neighbours are linked to the least of them, first
    the larger ones, then the smaller. Rows of one node are pre-aggregated before they move; a round writes its edges
    to the shared folder. Rounds grow with the logarithm of the largest component. Nodes are of any type that has an order.
    The joins meet each row with one row of its node, so where a centre is hot, adaptive execution splits its rows.
    """
    spark = edges.sparkSession
    now = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        tops = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(tops, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        after = settle(small, "edges")
        mark = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        forget(spark, now)
        now = after
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            )
        before = mark
