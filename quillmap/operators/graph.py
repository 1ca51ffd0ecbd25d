"""Weighted neighbour graphs as edge tables ``src, dst, weight``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def swapped(edges: DataFrame) -> DataFrame:
    """The edges turned round; other columns are kept."""
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst").select(*edges.columns)


def calibrate(distances: Column, target: float, low: float = 1e-5, high: float = 10.0, steps: int = 100, tolerance: float = 1e-5) -> Column:
    """``rho`` and ``sigma`` of one row's ascending distances, by bisection inside the JVM.

    ``rho`` is the nearest distance; sigma is halved in on until the sum of exp(-max(d - rho, 0) / sigma) is ``target``
    within the tolerance, or the steps are used up. Rows without a distance have null values.
    """
    rho = F.get(distances, F.lit(0))
    held = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit((low + high) / 2).alias("mid"), F.lit(False).alias("done"))

    def halve(s: Column, _: Column) -> Column:
        mass = F.aggregate(distances, F.lit(0.0), lambda t, d: t + F.exp(-F.greatest(d - rho, F.lit(0.0)) / s["mid"]))
        fits = F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), s["mid"].alias("mid"), F.lit(True).alias("done"))
        less = F.struct(s["lo"].alias("lo"), s["mid"].alias("hi"), ((s["lo"] + s["mid"]) / 2).alias("mid"), F.lit(False).alias("done"))
        more = F.struct(s["mid"].alias("lo"), s["hi"].alias("hi"), ((s["mid"] + s["hi"]) / 2).alias("mid"), F.lit(False).alias("done"))
        choice = F.element_at(F.transform(F.array(mass - target), lambda e: F.when(F.abs(e) < tolerance, fits).when(e > 0, less).otherwise(more)), 1)
        return F.when(s["done"], s).otherwise(choice)

    sigma = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), held, halve, lambda s: s["mid"])
    return F.when(F.size(distances) > 0, F.struct(rho.alias("rho"), sigma.alias("sigma")))


def sigmas(neighbours: DataFrame, k: int, include_self: bool = False, **bounds) -> DataFrame:
    """``src, rho, sigma`` of each row's neighbour distances; the target is log2 of k (k + 1 if self counts)."""
    import math

    lists = neighbours.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("dist", "dst"))), lambda x: x["dist"]).alias("d"))
    return lists.select("src", calibrate(F.col("d"), math.log2(k + include_self), **bounds).alias("c")).select("src", "c.rho", "c.sigma")


def memberships(neighbours: DataFrame, calibrated: DataFrame) -> DataFrame:
    """``src, dst, weight``: exp(-(d - rho) / sigma), 1 where d <= rho or sigma is 0; self edges and zeros are dropped."""
    met = neighbours.where("src != dst").join(calibrated, "src")
    weight = F.when((F.col("dist") <= F.col("rho")) | (F.col("sigma") == 0), F.lit(1.0)).otherwise(F.exp(-(F.col("dist") - F.col("rho")) / F.col("sigma")))
    return met.select("src", "dst", weight.alias("weight")).where("weight > 0")


def t_conorm(directed: DataFrame) -> DataFrame:
    """The symmetric union P + P' - P * P': repeated directed edges are added up first, zeros go.

    One exchange by the unordered pair: both directions meet in one row of an aggregate, and are turned out again.
    """
    forth = F.col("src") <= F.col("dst")
    pair = directed.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(
        F.sum(F.when(forth, F.col("weight")).otherwise(0.0)).alias("a"), F.sum(F.when(forth & (F.col("src") != F.col("dst")), 0.0).otherwise(F.col("weight"))).alias("b")
    )
    joined = pair.select("u", "v", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight")).where("weight != 0")
    both = F.when(F.col("u") == F.col("v"), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return joined.select(F.explode(both).alias("e"), "weight").select(F.col("e.u").alias("src"), F.col("e.v").alias("dst"), "weight")


def uniform(neighbours: DataFrame, k: int) -> DataFrame:
    """Every neighbour with weight 1/k."""
    return neighbours.select("src", "dst", F.lit(1.0 / k).alias("weight"))


def either_way(neighbours: DataFrame) -> DataFrame:
    """The binary symmetric adjacency: ``src, dst`` in both directions, once."""
    e = neighbours.select("src", "dst").where("src != dst")
    return e.unionByName(swapped(e)).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """``src < dst``: each link once, without loops."""
    return edges.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def reverse_weights(edges: DataFrame) -> DataFrame:
    """``src, dst, weight, reverse``: beside each edge the weight of the edge back, 0 if there is none."""
    back = swapped(edges).select("src", "dst", F.col("weight").alias("back"))
    return edges.join(back, ["src", "dst"], "left").select("src", "dst", "weight", F.coalesce("back", F.lit(0.0)).alias("reverse"))


def in_degrees(neighbours: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, n``: how often each node is a neighbour, 0 included."""
    n = neighbours.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def hubness(neighbours: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """One row: skewness, extremes and spread of in-degrees, hubs (twice k or more) and nodes that nobody has."""
    n = F.col("n")
    return in_degrees(neighbours, nodes).agg(
        F.skewness(n.cast("double")).alias("skew"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.stddev_pop(n.cast("double")).alias("sd"),
        F.sum((n >= 2 * k).cast("bigint")).alias("hubs"), F.sum((n == 0).cast("bigint")).alias("anti_hubs"),
    )


def topology_report(edges: DataFrame, n_nodes: int, k: int) -> DataFrame:
    """One row of counts that are 0 in a sound topology: wrong degrees, repeated targets, ends out of range, self slots."""
    per = edges.groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("d"), F.sum((F.col("src") == F.col("dst")).cast("bigint")).alias("own"), F.sum((~F.col("dst").between(0, n_nodes - 1)).cast("bigint")).alias("out"), F.first(~F.col("src").between(0, n_nodes - 1)).alias("bad"))
    return per.agg(
        F.sum((F.col("n") != k).cast("bigint")).alias("wrong_degree"), F.sum((F.col("d") != F.col("n")).cast("bigint")).alias("repeated"),
        F.sum("own").alias("self_slots"), F.sum("out").alias("targets_out"), F.sum(F.col("bad").cast("bigint")).alias("sources_out"), F.count("*").alias("sources"),
    )


def edge_report(edges: DataFrame, n_nodes: int) -> DataFrame:
    """One row of counts that are 0 in a sound weighted graph: ends out of range, self edges, weights outside (0, 1], repeats."""
    inside = F.col("src").between(0, n_nodes - 1) & F.col("dst").between(0, n_nodes - 1)
    weight_ok = (F.col("weight") > 0) & (F.col("weight") <= 1) & ~F.isnan("weight")
    per = edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum((~F.coalesce(weight_ok, F.lit(False))).cast("bigint")).alias("bad"), F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    return per.agg(
        F.sum("n").alias("edges"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("out_of_range"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("self_edges"),
        F.sum("bad").alias("bad_weights"), F.sum(F.col("n") - 1).alias("repeats"), F.min("lo").alias("min_weight"), F.max("hi").alias("max_weight"),
    )


def constant_weight(edges: DataFrame) -> DataFrame:
    return edges.agg(F.min("weight").alias("lowest"), F.max("weight").alias("highest"), (F.min("weight") == F.max("weight")).alias("constant"))


def adjacency_sets(edges: DataFrame) -> DataFrame:
    """``src, neighbours``: sorted distinct targets; for graphs of bounded degree, as an array holds them."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))


def both_inside(edges: DataFrame, n_train: int) -> DataFrame:
    """Edges of which both ends are among the first ``n_train`` ids."""
    return edges.where(F.col("src").between(0, n_train - 1) & F.col("dst").between(0, n_train - 1))


def running_mass(edges: DataFrame, buckets: int = 64) -> DataFrame:
    """``src, dst, weight, lo, hi``: the half-open part of [0, 1) that each edge has of the total weight, in (src, dst) order.

    A prefix sum on two levels: ranges of edges are summed first, then each range on its own, so no task orders all edges.
    Weights that are missing, negative or not finite, or none that is positive, are an error.
    """
    from quillmap.operators.checks import sound_weights
    from quillmap.session import stage

    placed = stage(edges.select("src", "dst", "weight").repartitionByRange(buckets, "src", "dst").withColumn("part", F.spark_partition_id()), "ranges")
    sums = sound_weights(placed).groupBy("part").agg(F.sum("weight").alias("w"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("start"), F.sum("w").over(Window.partitionBy()).alias("total"))
    inner = Window.partitionBy("part").orderBy("src", "dst").rowsBetween(Window.unboundedPreceding, 0)
    met = placed.join(starts, "part").withColumn("upto", F.sum("weight").over(inner) + F.col("start"))
    return met.select("src", "dst", "weight", ((F.col("upto") - F.col("weight")) / F.col("total")).alias("lo"), (F.col("upto") / F.col("total")).alias("hi"))


def graph_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: edges of both, of one only, and the greatest difference of weight."""
    met = a.select("src", "dst", F.col("weight").alias("wa")).join(b.select("src", "dst", F.col("weight").alias("wb")), ["src", "dst"], "full_outer")
    return met.agg(
        F.sum((F.col("wa").isNotNull() & F.col("wb").isNotNull()).cast("bigint")).alias("both"), F.sum(F.col("wb").isNull().cast("bigint")).alias("only_a"),
        F.sum(F.col("wa").isNull().cast("bigint")).alias("only_b"), F.max(F.abs(F.col("wa") - F.col("wb"))).alias("max_difference"),
    )


def modularity(links: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One value ``modularity`` of undirected links ``src, dst, weight`` (each once) and ``id, community``."""
    ends = links.select(F.col("src").alias("id"), "weight").unionByName(links.select(F.col("dst").alias("id"), "weight"))
    degree = ends.join(communities, "id").groupBy("community").agg(F.sum("weight").alias("k"))
    a, b = communities.select(F.col("id").alias("src"), F.col("community").alias("community")), communities.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    inner = links.join(a, "src").join(b, "dst").where("community = other").groupBy("community").agg(F.sum("weight").alias("w"))
    total = links.agg(F.sum("weight").alias("m"))
    per = degree.join(inner, "community", "left").crossJoin(F.broadcast(total))
    return per.agg(F.sum(F.coalesce("w", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("k") / (2 * F.col("m")), 2)).alias("modularity"))


def communities(edges: DataFrame, rounds: int = 20, resolution: float = 1.0) -> DataFrame:
    """``id, community``: an approximation of modularity communities by rounds of local moves.

    ``edges`` hold both directions. In a round half of the nodes (by hash of node and round, so that neighbours don't swap
    for ever) move to the neighbouring community of the greatest gain w(i, C) - resolution * k_i * K_C / 2m; ties go to the
    smaller label. Deterministic, two exchanges a round, written to the shared folder every few rounds. It finds a local
    optimum, not the one a multi-level method finds.
    """
    from quillmap.session import stage, unstage

    links = stage(edges.select("src", "dst", "weight").where("src != dst"), "edges")
    degree = stage(links.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")), "degrees")
    twice = degree.agg(F.sum("k").alias("m2"))
    labels, held = degree.select("id", F.col("id").alias("community")), None
    for n in range(rounds):
        size = labels.join(degree, "id").groupBy("community").agg(F.sum("k").alias("kc"))
        votes = links.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("weight").alias("w"))
        own = labels.withColumn("w", F.lit(0.0))
        options = votes.unionByName(own).groupBy("id", "community").agg(F.sum("w").alias("w"))
        met = options.join(degree, "id").join(size, "community").join(labels.withColumnRenamed("community", "mine"), "id").crossJoin(F.broadcast(twice))
        rest = F.col("kc") - F.when(F.col("community") == F.col("mine"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * rest / F.col("m2"), 9)
        best = met.groupBy("id").agg(F.first("mine").alias("mine"), F.max_by("community", F.struct(gain.alias("g"), (-F.col("community")).alias("c"))).alias("best"))
        moves = F.pmod(F.xxhash64("id", F.lit(n)), F.lit(2)) == 0
        labels = best.select("id", F.when(moves, F.col("best")).otherwise(F.col("mine")).alias("community"))
        if n % 2 == 1 or n == rounds - 1:
            fresh = stage(labels, "labels")
            if held is not None:
                unstage(held)
            held = labels = fresh
    return labels


def pairing(edges: DataFrame, rows: int) -> str:
    """``whole`` if a graph's nodes are as many as a table's rows, ``prefix`` if more, ``too small`` if fewer.

    A graph that only its prefix fits may be cut with ``both_inside`` where the table is known to be its first rows.
    """
    top = edges.agg(F.greatest(F.max("src"), F.max("dst")).alias("top")).first()["top"]
    nodes = 0 if top is None else top + 1
    return "too small" if nodes < rows else "whole" if nodes == rows else "prefix"
