"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that can be reached over edges (a, b); nodes without edges are left out.

    Each round a node takes the smallest label of its neighbours twice; whether something changed is all that reaches
    the driver. edges should be cut.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    lab = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    hop = lambda x: both.join(x.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("l"))
    while True:
        one = hop(lab)
        new = cut(hop(one).join(one.select("u", F.col("l").alias("old")), "u"))
        lab = new.drop("old")
        if new.where("l != old").isEmpty():
            return lab.select(F.col("u").alias("node"), F.col("l").alias("comp"))
