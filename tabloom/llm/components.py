"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node each linked node reaches. Nodes are longs.

    Alternates the large-star and small-star steps (Kiveris et al. 2014) until the
    edge table stops changing; edges never multiply, so a hub costs no more than
    its links. Each round is written to the shared folder, which cuts lineage.
    Self links and null ends are ignored; an edge may be given more than once.
    An empty edge table gives an empty result.
    """
    e = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
              .where("u is not null and v is not null and u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        e = stage(linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .unionByName(linked.select("u", F.col("m").alias("v")))
                  .where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
