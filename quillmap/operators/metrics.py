"""Map quality: how far a low-dimensional map keeps the neighbourhoods, distances and densities of a space.

Points are ``id, v`` (space) and ``id, x, y`` (map); neighbour tables are ``src, dst, dist, rank``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions.vector import distance, doubles
from quillmap.operators import knn
from quillmap.operators.sampling import positions


def as_points(z: DataFrame) -> DataFrame:
    """Map coordinates as vectors of two dimensions."""
    return z.select("id", F.array(F.col("x").cast("double"), F.col("y").cast("double")).alias("v"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``src, both, either, jaccard, retention`` of two neighbour tables; an empty union counts as alike."""
    met = a.select("src", "dst", F.lit(1).alias("a")).join(b.select("src", "dst", F.lit(1).alias("b")), ["src", "dst"], "full_outer")
    per = met.groupBy("src").agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.count("*").alias("either"), F.count("a").alias("n"))
    both = F.coalesce("both", F.lit(0).cast("bigint"))
    return per.select("src", both.alias("both"), "either", (both / F.col("either")).alias("jaccard"), (both / F.col("n")).alias("retention"))


def mean_radius(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("src").agg(F.avg("dist").alias("radius"))


def density_preservation(hi: DataFrame, lo: DataFrame, eps: float = 1e-12) -> DataFrame:
    """One value ``density``: correlation of the log mean radii in space and map; null if either side is flat."""
    met = mean_radius(hi).select("src", F.log(F.col("radius") + eps).alias("a")).join(mean_radius(lo).select("src", F.log(F.col("radius") + eps).alias("b")), "src")
    flat = (F.stddev_pop("a") == 0) | (F.stddev_pop("b") == 0)
    return met.agg(F.when(~flat, F.corr("a", "b")).alias("density"))


def neighbour_ranks(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """``src, dst, rank``: the place of every other point in each anchor's order of distance.

    The result has anchors times points rows; for the ranks of some pairs ``knn.ranks_of`` makes no such table.
    """
    return knn.exact_knn(anchors, points, 2**31 - 1).select("src", "dst", "dist", "rank")


def rank_penalty(ranks: DataFrame, neighbours: DataFrame, k: int, m: int) -> DataFrame:
    """``src, score``: 1 minus the scaled excess ranks of one space's neighbours in the other's order.

    Trustworthiness with ranks of the space and neighbours of the map, continuity the other way round. The scale is
    2 / (k (2m - 3k - 1)); where it isn't positive the score is 1.
    """
    scale = k * (2 * m - 3 * k - 1)
    met = neighbours.where(F.col("rank") <= k).select("src", "dst").join(ranks, ["src", "dst"])
    excess = F.sum(F.greatest(F.col("rank") - k, F.lit(0)))
    return met.groupBy("src").agg((F.lit(1.0) - F.lit(2.0 / scale) * excess if scale > 0 else F.lit(1.0)).alias("score"))


def pair_distances(pairs: DataFrame, points: DataFrame, z: DataFrame) -> DataFrame:
    """``i, j, hi, lo``: distances of pairs of ids in space and map."""
    both = points.select("id", doubles("v").alias("v")).join(as_points(z).withColumnRenamed("v", "w"), "id")
    a = both.select(F.col("id").alias("i"), F.col("v").alias("v1"), F.col("w").alias("w1"))
    b = both.select(F.col("id").alias("j"), F.col("v").alias("v2"), F.col("w").alias("w2"))
    met = pairs.join(a, "i").join(b, "j")
    return met.select("i", "j", distance(F.col("v1"), F.col("v2")).alias("hi"), distance(F.col("w1"), F.col("w2")).alias("lo"))


def average_ranks(df: DataFrame, column: str, name: str, buckets: int = 64) -> DataFrame:
    """``df`` with the average rank of a column (ties share the mean). Ranks come from counts of distinct values by ranges."""
    from quillmap.session import stage

    counts = stage(df.groupBy(column).agg(F.count("*").alias("_n")).repartitionByRange(buckets, column).withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = counts.groupBy("_part").agg(F.sum("_n").alias("_all"))
    start = sizes.select("_part", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.join(start, "_part").select(column, (F.col("_start") + F.sum("_n").over(inner) - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, column)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One value ``spearman``."""
    ranked = average_ranks(average_ranks(df.select(a, b), a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("spearman"))


def triplet_accuracy(triplets: DataFrame, points: DataFrame, z: DataFrame) -> DataFrame:
    """One row ``n, accuracy``: how often space and map agree which of j and l is nearer to i."""
    both = points.select("id", doubles("v").alias("v")).join(as_points(z).withColumnRenamed("v", "w"), "id")
    met = triplets
    for c in ("i", "j", "l"):
        met = met.join(both.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"), F.col("w").alias(f"w{c}")), c)
    hi = distance(F.col("vi"), F.col("vj")) - distance(F.col("vi"), F.col("vl"))
    lo = distance(F.col("wi"), F.col("wj")) - distance(F.col("wi"), F.col("wl"))
    return met.agg(F.count("*").alias("n"), F.avg((F.signum(hi) == F.signum(lo)).cast("double")).alias("accuracy"))


def collapse(z: DataFrame, nearest: DataFrame, grid: int = 64, clip: tuple[float, float] = (0.5, 99.5)) -> DataFrame:
    """One row: median nearest distance over the clipped diagonal, and occupancy entropy of a grid, over its maximum."""
    lo, hi = clip[0] / 100, clip[1] / 100
    box = z.agg(*[F.percentile(c, F.lit(p)).alias(f"{c}{n}") for c in ("x", "y") for n, p in (("lo", lo), ("hi", hi))])
    diagonal = F.sqrt(F.pow(F.col("xhi") - F.col("xlo"), 2) + F.pow(F.col("yhi") - F.col("ylo"), 2))
    cell = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col(f"{c}lo")) / (F.col(f"{c}hi") - F.col(f"{c}lo")) * grid), F.lit(0)), F.lit(grid - 1))
    inside = z.crossJoin(F.broadcast(box)).where(F.col("x").between(F.col("xlo"), F.col("xhi")) & F.col("y").between(F.col("ylo"), F.col("yhi")))
    cells = inside.groupBy(cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("occupied"))
    entropy = (F.log("t") - F.col("s") / F.col("t")) / F.log(F.lit(float(grid * grid)))
    median = nearest.where("rank = 1").agg(F.percentile("dist", F.lit(0.5)).alias("m"))
    return median.crossJoin(box).crossJoin(total).select((F.col("m") / diagonal).alias("collapse"), entropy.alias("entropy"), "occupied")


def spatial_bins(z: DataFrame, values: DataFrame, gridsize: int = 30) -> DataFrame:
    """``bx, by, n`` and the mean of each value in a grid over the map's extent."""
    names = [c for c in values.columns if c != "id"]
    box = z.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.when(F.col(f"{c}1") > F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")).otherwise(1.0) * gridsize), F.lit(gridsize - 1)).cast("int")
    met = z.join(values, "id").crossJoin(F.broadcast(box))
    return met.groupBy(at("x").alias("bx"), at("y").alias("by")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names])


def label_agreement(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """``src, label, share``: the share of each query's neighbours that have its label."""
    own = labels.select(F.col("id").alias("src"), F.col("label"))
    theirs = labels.select(F.col("id").alias("dst"), F.col("label").alias("other"))
    met = neighbours.select("src", "dst").join(theirs, "dst").join(own, "src")
    return met.groupBy("src", "label").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("share"))


def silhouette(points: DataFrame, labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """``id, silhouette`` of anchors against all points: (b - a) / max(a, b) of mean distances by label."""
    rows = points.join(labels, "id")
    per = knn.label_distances(rows.join(anchors.select("id"), "id", "left_semi"), rows).withColumn("d", F.col("total") / F.col("n"))
    own, other = F.min(F.when(F.col("label") == F.col("mine"), F.col("d"))), F.min(F.when(F.col("label") != F.col("mine"), F.col("d")))
    s = per.groupBy("id").agg(own.alias("a"), other.alias("b"))
    return s.select("id", F.when(F.col("a").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def procrustes(a: DataFrame, b: DataFrame) -> tuple[dict[str, float], Column, Column]:
    """The similarity transform that brings map ``b`` onto map ``a`` (joined by id), and columns of b's aligned x and y.

    All sums are one aggregate; the 2x2 decomposition is on the driver. ``disparity`` is the rest after both maps are
    centred and scaled to norm one.
    """
    met = a.select("id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(b.select("id", F.col("x").alias("bx"), F.col("y").alias("by")), "id")
    names = ("ax", "ay", "bx", "by")
    s = met.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names], *[F.sum(F.col(c) * F.col(d)).alias(f"{c}_{d}") for n, c in enumerate(names) for d in names[n:]]).first()
    n = s["n"]
    mean = {c: s[c] / n for c in names}
    cov = lambda c, d: s[f"{c}_{d}"] - n * mean[c] * mean[d]
    cross = np.array([[cov("ax", "bx"), cov("ax", "by")], [cov("ay", "bx"), cov("ay", "by")]])
    norm_a, norm_b = np.sqrt(cov("ax", "ax") + cov("ay", "ay")), np.sqrt(cov("bx", "bx") + cov("by", "by"))
    u, sv, vt = np.linalg.svd(cross)
    turn, scale = u @ vt, sv.sum() / norm_b**2
    dx, dy = F.col("x") - mean["bx"], F.col("y") - mean["by"]
    ax = F.lit(float(scale * turn[0, 0])) * dx + F.lit(float(scale * turn[0, 1])) * dy + F.lit(float(mean["ax"]))
    ay = F.lit(float(scale * turn[1, 0])) * dx + F.lit(float(scale * turn[1, 1])) * dy + F.lit(float(mean["ay"]))
    return {"disparity": float(1 - (sv.sum() / (norm_a * norm_b)) ** 2), "scale": float(scale), "n": int(n)}, ax, ay


def gram(points: DataFrame, width: int, key: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance of vectors of a bounded width: partial sums of each task, added on the driver."""
    import pyarrow as pa

    def partial(batches):
        n, s, g = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
            n, s, g = n + len(flat), s + flat.sum(0), g + flat.T @ flat
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], names=["n", "s", "g"])

    parts = points.select(doubles(key).alias("v")).where(F.size("v") == width).mapInArrow(partial, "n long, s array<double>, g array<double>")
    summed = parts.select("n", F.posexplode(F.concat("s", "g")).alias("p", "x")).groupBy("p").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("p").collect()
    if not summed:
        return 0, np.zeros(width), np.zeros((width, width))
    n, flat = summed[0]["n"], np.array([r["x"] for r in summed])
    mean = flat[:width] / max(n, 1)
    return n, mean, flat[width:].reshape(width, width) / max(n, 1) - np.outer(mean, mean)


def pca_map(points: DataFrame, width: int, target_rms: float | None = None) -> DataFrame:
    """``id, x, y``: the two main directions, signs fixed by their largest weight; optionally scaled to an RMS radius."""
    _, mean, cov = gram(points, width)
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(-values)[:2]].T
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    scale = target_rms / np.sqrt(max(np.sort(values)[-2:].sum(), 1e-300)) if target_rms else 1.0
    v = doubles("v")
    weight = lambda a: F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in a]), lambda p, q: p * q), F.lit(float(-(a @ mean))), lambda s, t: s + t)
    return points.select("id", (weight(axes[0]) * scale).alias("x"), (weight(axes[1]) * scale).alias("y"))


def spectrum(points: DataFrame, width: int, tail: int = 10) -> dict[str, float]:
    """Participation ratio, explained shares and log-log tail slope of the covariance's eigenvalues."""
    _, _, cov = gram(points, width)
    e = np.sort(np.linalg.eigvalsh(cov))[::-1].clip(0)
    share = np.cumsum(e) / max(e.sum(), 1e-300)
    rest = e[tail:][e[tail:] > 0]
    slope = np.polyfit(np.log(np.arange(tail + 1, tail + 1 + len(rest))), np.log(rest), 1)[0] if len(rest) > 1 else float("nan")
    return {"participation": float(e.sum() ** 2 / max((e**2).sum(), 1e-300)), "var2": float(share[min(1, len(share) - 1)]), "var10": float(share[min(9, len(share) - 1)]), "var50": float(share[min(49, len(share) - 1)]), "tail_slope": float(slope)}


def twonn(neighbours: DataFrame, discard: float = 0.1) -> DataFrame:
    """One value ``dimension``: the through-origin fit of -log(1 - F) on log(r2 / r1), the top share discarded."""
    per = neighbours.where("rank <= 2").groupBy("src").agg(F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("r2"))
    mu = per.where("r1 > 0").select("src", F.log(F.col("r2") / F.col("r1")).alias("l"))
    ranked = positions(mu, ["l", "src"]).withColumn("i", F.col("pos") + 1).crossJoin(F.broadcast(mu.agg(F.count("*").alias("n"))))
    used = ranked.where(F.col("i") <= F.floor(F.col("n") * (1 - discard))).withColumn("g", -F.log(1 - F.col("i") / (F.col("n") + 1)))
    return used.agg((F.sum(F.col("l") * F.col("g")) / F.sum(F.col("l") * F.col("l"))).alias("dimension"))


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One value ``ari`` of two labellings, from their contingency counts."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("t"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("rb"))
    expected = F.col("ra") * F.col("rb") / (F.col("t") * (F.col("t") - 1) / 2)
    return both.crossJoin(rows).crossJoin(cols).select(((F.col("s") - expected) / ((F.col("ra") + F.col("rb")) / 2 - expected)).alias("ari"))
