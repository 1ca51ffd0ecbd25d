"""Samples that depend on ids and seeds only: every draw is a hash of the row's id, so any partitioning gives the same.

Draws are the first 13 hexadecimal digits of an MD5 hash, so other engines can make the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_DIGITS = 13


def _text(seed: int, *ids: Column) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids])


def hash_number(seed: int, *ids: Column) -> Column:
    """A whole number below 2^52."""
    return F.conv(F.substring(F.md5(_text(seed, *ids)), 1, _DIGITS), 16, 10).cast("bigint")


def uniform_draw(seed: int, *ids: Column) -> Column:
    """A double in (0, 1)."""
    return (hash_number(seed, *ids) + F.lit(0.5)) / F.lit(float(16**_DIGITS))


def sample(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows without replacement: those first in the order of their hashes."""
    return df.withColumn("_h", hash_number(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def split(df: DataFrame, share: float, seed: int, key: str = "id") -> DataFrame:
    """``df`` with a column ``part``, train or test; row ids stay as they are."""
    return df.withColumn("part", F.when(uniform_draw(seed, F.col(key)) < share, "train").otherwise("test"))


def complement_sample(universe: DataFrame, taken: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows of the universe that aren't taken."""
    return sample(universe.join(taken.select(key), key, "left_anti"), n, seed, key)


def weighted_sample(edges: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` edges without replacement, by weight: the smallest of -ln(u) / w. Weights that aren't positive are never drawn."""
    u = uniform_draw(seed, F.col("src"), F.col("dst"))
    keyed = edges.where("weight > 0 AND NOT isnan(weight)").withColumn("_k", F.round(-F.log(u) / F.col("weight"), 9))
    return keyed.orderBy("_k", "src", "dst").limit(n).drop("_k")


def draws_by_mass(mass: DataFrame, n: int, seed: int, buckets: int = 256) -> DataFrame:
    """``draw, src, dst``: ``n`` draws with replacement by inverse distribution, ``lo <= u < hi``.

    ``mass``: ``src, dst, lo, hi``, as graph.running_mass makes it of sound weights. The range join goes by buckets of [0, 1): an edge is in each bucket it touches.
    """
    at = lambda c: F.least(F.floor(F.col(c) * buckets), F.lit(buckets - 1)).cast("int")
    u = mass.sparkSession.range(n).select(F.col("id").alias("draw"), uniform_draw(seed, F.col("id")).alias("u")).withColumn("b", at("u"))
    parts = mass.withColumn("b", F.explode(F.sequence(at("lo"), at("hi"))))
    return u.join(parts, "b").where("u >= lo AND u < hi").select("draw", "src", "dst")


def offset_negatives(edges: DataFrame, n_nodes: int, seed: int) -> DataFrame:
    """Each edge's source with another target, never itself: (src + 1 + h mod (n - 1)) mod n."""
    h = hash_number(seed, F.col("src"), F.col("dst"))
    return edges.select("src", ((F.col("src") + 1 + h % (n_nodes - 1)) % n_nodes).alias("dst"))


def rejected_negatives(nodes: DataFrame, edges: DataFrame, n_nodes: int, k: int, seed: int, tries: int = 4) -> DataFrame:
    """``src, dst``: k negatives of every node that are neither itself nor its neighbours.

    Candidates by hash, neighbours taken out by an anti join, the first k in order of the tries kept. A node whose
    neighbours are nearly all nodes may get fewer.
    """
    t = F.explode(F.sequence(F.lit(0), F.lit(k * tries - 1))).alias("t")
    c = nodes.select(F.col("id").alias("src"), t).withColumn("dst", hash_number(seed, F.col("src"), F.col("t")) % n_nodes).where("src != dst")
    c = c.groupBy("src", "dst").agg(F.min("t").alias("t")).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    first = Window.partitionBy("src").orderBy("t")
    return c.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("src", "dst")


def labelled_batches(positive: DataFrame, negative: DataFrame, batch: int, ratio: float, seed: int) -> DataFrame:
    """``batch, src, dst, target``: batches of round(batch * ratio) positives and the rest negatives, in hash order.

    Positions come from a two-level count, so no task orders all edges. The last batches may be short.
    """
    take = max(1, round(batch * ratio))

    def placed(df: DataFrame, size: int, target: float, salt: int) -> DataFrame:
        h = df.select("src", "dst", hash_number(seed + salt, F.col("src"), F.col("dst")).alias("h"))
        return positions(h, ["h", "src", "dst"]).select(F.floor(F.col("pos") / size).alias("batch"), "src", "dst", F.lit(target).alias("target"))

    return placed(positive, take, 1.0, 0).unionByName(placed(negative, batch - take, 0.0, 1))


def positions(df: DataFrame, order: list[str], buckets: int = 32) -> DataFrame:
    """``df`` with ``pos``, each row's place from 0 in a total order, by ranges counted first."""
    from quillmap.session import stage

    ranged = stage(df.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(start, "_part").withColumn("pos", F.col("_start") + inner - 1).drop("_part", "_start")


def mid_near(points: DataFrame, n_nodes: int, seed: int, candidates: int = 6, rank: int = 2) -> DataFrame:
    """``src, dst``: of some random others of each point the second nearest."""
    from quillmap.functions.vector import distance, doubles

    c = points.select(F.col("id").alias("src"), doubles("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))).alias("t"))
    c = c.withColumn("dst", (F.col("src") + 1 + hash_number(seed, F.col("src"), F.col("t")) % (n_nodes - 1)) % n_nodes)
    met = c.join(points.select(F.col("id").alias("dst"), doubles("v").alias("c")), "dst")
    nearest = Window.partitionBy("src").orderBy(F.round(distance(F.col("q"), F.col("c")), 9), "dst", "t")
    return met.withColumn("n", F.row_number().over(nearest)).where(F.col("n") == rank).select("src", "dst")


def evenly_spaced(df: DataFrame, m: int, key: str = "id") -> DataFrame:
    """``m`` rows at even places of the id order, first and last included."""
    placed = positions(df, [key])
    n = df.count()
    wanted = df.sparkSession.range(m).select(F.floor(F.col("id") * (n - 1) / max(1, m - 1)).alias("pos")).distinct()
    return placed.join(wanted, "pos", "left_semi").drop("pos")
