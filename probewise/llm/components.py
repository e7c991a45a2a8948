"""Connected components of a table of links, by the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probewise.workspace import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node it is connected with.

    Each round takes the smallest root among neighbours, then the root of that root, so
    chains shorten by half; rounds go on until nothing changes. Roots are summed up before
    the shuffle, and every round is written to the shared folder.
    """
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v"))
                   .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "links")
    roots = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("root")), "roots")
    while True:
        around = (
            both.join(roots, both.v == roots.node).groupBy("u").agg(F.min("root").alias("near")))
        nearer = written(
            roots.join(around, roots.node == around.u, "left")
            .select("node", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("was")), "nearer")
        jump = nearer.select(F.col("node").alias("at"), F.col("root").alias("further"))
        after = written(
            nearer.join(jump, nearer.root == jump.at, "left")
            .select("node", F.coalesce("further", "root").alias("root"), "was"), "roots")
        if not after.filter("root != was").limit(1).count():
            return after.select("node", "root")
        roots = after.select("node", "root")
