"""Connected components of a link table, with Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    return (both.join(low, "a").filter("b > a")
            .select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    return (e.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, component): the smallest node reachable.

    Alternating large-star and small-star rounds until the edges are a star
    around each smallest node, which takes about log(n) rounds. Each round is
    written to shared storage. Nulls and self-links are left out; an empty
    table gives an empty one. Nodes without links are not listed.
    """
    e = (links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
         .filter("a is not null and b is not null and a <> b").distinct())
    e = stored(e, "links")
    mark = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now[0] == 0 or now == mark:
            break
        mark, old = now, e
        e = stored(_small_star(_large_star(e)), "star")
        discard(old)
    return (e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(e.select("b", "b")).distinct())
