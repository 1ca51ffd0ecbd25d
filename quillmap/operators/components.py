"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.session import stage, unstage


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``node, component``: the smallest node that each node is linked with, over any number of links.

    Alternating stars: each node links its larger neighbours, then its smaller ones, with the smallest node it knows,
    until no link changes; the number of rounds grows with the logarithm of the longest chain. Every round is written to
    the shared folder. A node of many links is aggregated, never gathered. Loops, repeated links and either direction are
    allowed; links with a null end are ignored; only nodes that have a link with another or themselves appear.
    """
    known = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    nodes = stage(known.select(F.col("u").alias("node")).union(known.select("v")).distinct(), "nodes")
    links = stage(known.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen: tuple | None = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        best = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(best, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(best.select("u", F.col("m").alias("v"))).distinct()
        fresh = stage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        # A sum over hashes tells whether the set of links has changed; it is one small row.
        mark = tuple(fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        unstage(links)
        links = fresh
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    found = links.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found, nodes["node"] == found["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
