"""Connected components of a table of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import settle


def components(links: DataFrame) -> DataFrame:
    """For links (a, b): id and comp, the least id reachable, for each linked id.

    Each round takes the least label among a vertex and its neighbours, then the label of
    that label; the tables are written each round, so lost executors cost one round.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = settle(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct(), "edges")
    labels = settle(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges.v == labels.id).groupBy("u").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels.id == near.u, "left").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        new = settle(step.join(up, "comp", "left").select("id", "old", F.least("comp", "top").alias("comp")), "labels")
        if new.filter("old <> comp").isEmpty():
            return new.select("id", "comp")
        labels = new.select("id", "comp")
