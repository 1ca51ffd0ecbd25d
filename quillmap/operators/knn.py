"""Nearest neighbours: exact by blocks, and approximate by inverted lists.

Neighbours are ordered by (distance, id). A row is never its own neighbour where queries and corpus share ids; self is
told by id, not by place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmap.functions.vector import doubles

#: Rows of a block of either side; a meeting of two blocks holds two of them and a strip of distances.
BLOCK = 4096
_STRIP = 512


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    n = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(n, -1) if n else np.empty((0, 0))


def distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Rough distances: expanded squares for l2 above 16 dimensions, direct differences up to it."""
    if metric == "l2":
        if q.shape[1] <= 16:
            return np.sqrt(((q[:, None, :] - c[None, :, :]) ** 2).sum(axis=2))
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (q @ c.T), 0))
    s = q @ c.T
    if metric == "cosine":
        return 1 - s / np.maximum(np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :], 1e-300)
    return -s


def _exact(q: np.ndarray, c: np.ndarray, picked: np.ndarray, metric: str) -> np.ndarray:
    rows = c[picked]
    if metric == "l2":
        return np.sqrt(((rows - q[:, None, :]) ** 2).sum(axis=2))
    s = (rows * q[:, None, :]).sum(axis=2)
    if metric == "cosine":
        return 1 - s / np.maximum(np.sqrt((q * q).sum(1))[:, None] * np.sqrt((rows * rows).sum(2)), 1e-300)
    return -s


def block_top_k(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, k: int, metric: str, same: bool, spare: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query row, corpus row, distance`` of the k nearest in a block.

    A rough pass takes k + spare; they are ranked by exact distances. If the rough k-th and the last taken are within
    rounding, all rows inside that margin are ranked.
    """
    out = []
    for a in range(0, len(q), _STRIP):
        part, ids = q[a : a + _STRIP], qid[a : a + _STRIP]
        rough = distances(part, c, metric)
        if same:
            rough[ids[:, None] == cid[None, :]] = np.inf
        take = min(min(k, len(c)) + spare, len(c))
        picked = np.argpartition(rough, take - 1, axis=1)[:, :take]
        near = np.take_along_axis(rough, picked, axis=1)
        margin = 1e-7 * (1 + np.abs(near).min(axis=1))
        kth = np.partition(near, min(k, take) - 1, axis=1)[:, min(k, take) - 1]
        for i in np.flatnonzero((near.max(axis=1) <= kth + margin) & (take < len(c))):
            wide = np.flatnonzero(rough[i] <= kth[i] + margin[i])
            d = _exact(part[i : i + 1], c, wide[None, :], metric)[0]
            first = np.lexsort((cid[wide], d))[:k]
            first = first[np.isfinite(rough[i, wide[first]])]
            out.append((np.full(len(first), a + i), wide[first], d[first]))
            near[i] = np.inf
        d = np.where(np.isfinite(near), _exact(part, c, picked, metric), np.inf)
        rank = np.lexsort((cid[picked], d), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(part)) + a, rank.shape[1])
        best, d = np.take_along_axis(picked, rank, axis=1).ravel(), np.take_along_axis(d, rank, axis=1).ravel()
        keep = np.isfinite(d)
        out.append((rows[keep], best[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def meet_blocks(left: DataFrame, right: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block: int = BLOCK) -> DataFrame:
    """Every row of ``left`` meets every row of ``right``, block by block: ``meet`` gets a block of each and gives rows.

    Both have ``id`` and ``v`` and may have more columns. They are cut into blocks by id hash, and each pair of blocks is
    one task's work, so no task holds more than two blocks. For a stated query set against all rows.
    """
    nl, nr = max(1, -(-left.count() // block)), max(1, -(-right.count() // block))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda df: F.lit(None).cast(T.StructType([f for f in df.schema if f.name not in ("id", "v")]))
    more = lambda df: F.struct(*[c for c in df.columns if c not in ("id", "v")])
    a = left.select(part(nl).alias("a"), every(nr).alias("b"), F.lit(0).alias("side"), "id", "v", *([more(left).alias("l")] if len(left.columns) > 2 else []), *([none(right).alias("r")] if len(right.columns) > 2 else []))
    b = right.select(every(nl).alias("a"), part(nr).alias("b"), F.lit(1).alias("side"), "id", "v", *([none(left).alias("l")] if len(left.columns) > 2 else []), *([more(right).alias("r")] if len(right.columns) > 2 else []))

    def both(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        x, y = (table.filter(pa.array(side == n)) for n in (0, 1))
        return meet(x, y)

    return a.unionByName(b).groupBy("a", "b").applyInArrow(both, schema)


def exact_knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", exclude_self: bool = True, block: int = BLOCK, key: str = "id", vector: str = "v") -> DataFrame:
    """``src, dst, dist, rank``: the k nearest corpus rows of every query row (metric: l2, cosine, or ip for -dot).

    Blocks of queries and corpus meet once and keep their k best by matrix products; a window keeps the k best of those.
    With ``exclude_self`` equal ids aren't neighbours. Rows with a null id or vector are left out; a query with fewer than
    k others has fewer rows.
    """
    q = queries.select(F.col(key).alias("id"), doubles(vector).alias("v")).dropna()
    c = corpus.select(F.col(key).alias("id"), doubles(vector).alias("v")).dropna()
    kind = q.schema["id"].dataType.simpleString()

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        qid, cid = x.column("id").to_numpy(), y.column("id").to_numpy()
        row, best, d = block_top_k(_matrix(x.column("v")), qid, _matrix(y.column("v")), cid, k, metric, exclude_self) if len(qid) and len(cid) else (np.empty(0, int),) * 2 + (np.empty(0),)
        return pa.table([pa.array(qid[row]), pa.array(cid[best]), pa.array(d, pa.float64())], names=["src", "dst", "dist"])

    near = meet_blocks(q, c, meet, f"src {kind}, dst {kind}, dist double", block)
    best = Window.partitionBy("src").orderBy("dist", "dst")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranks_of(pairs: DataFrame, points: DataFrame, block: int = BLOCK) -> DataFrame:
    """``src, dst, rank``: the place of ``dst`` in ``src``'s order of distance over all points, for given pairs.

    Each source carries its pairs' distances through the blocks, which count the points that come before; only counts are
    added up, so nothing of the size of all pairs is made. A source's pairs are as many as its neighbours.
    """
    p = points.select("id", doubles("v").alias("v")).dropna()
    a, b = p.select(F.col("id").alias("src"), F.col("v").alias("q")), p.select(F.col("id").alias("dst"), F.col("v").alias("c"))
    far = pairs.select("src", "dst").distinct().join(b, "dst").groupBy("src").agg(F.collect_list("dst").alias("ids"), F.collect_list("c").alias("ends"))
    sources = far.join(a, "src").select(F.col("src").alias("id"), F.col("q").alias("v"), "ids", "ends")
    kind = p.schema["id"].dataType.simpleString()

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        v, own, cid = _matrix(y.column("v")), x.column("id").to_pylist(), y.column("id").to_numpy()
        q = _matrix(x.column("v"))
        src, dst, n = [], [], []
        for i, (me, more) in enumerate(zip(own, x.column("l").to_pylist())):
            d = np.sqrt(((v - q[i]) ** 2).sum(axis=1))
            ends = np.sqrt(((np.array(more["ends"]) - q[i]) ** 2).sum(axis=1))
            ids = np.array(more["ids"])
            others = cid != me
            before = (d[None, :] < ends[:, None]) | (d[None, :] == ends[:, None]) & (cid[None, :] < ids[:, None])
            src += [me] * len(ids)
            dst += more["ids"]
            n += (before & others[None, :]).sum(axis=1).tolist()
        return pa.table([pa.array(src, x.column("id").type), pa.array(dst, x.column("id").type), pa.array(n, pa.int64())], names=["src", "dst", "n"])

    counted = meet_blocks(sources, p, meet, f"src {kind}, dst {kind}, n long", block)
    return counted.groupBy("src", "dst").agg((F.sum("n") + 1).alias("rank"))


def label_distances(anchors: DataFrame, points: DataFrame, block: int = BLOCK) -> DataFrame:
    """``id, mine, label, n, total``: sums of each anchor's distances to the points of every label, itself left out.

    ``anchors`` and ``points``: ``id, v, label``.
    """
    a, p = (df.select("id", doubles("v").alias("v"), F.col("label").cast("long").alias("label")).dropna() for df in (anchors, points))
    kind = p.schema["id"].dataType.simpleString()

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        q, c = _matrix(x.column("v")), _matrix(y.column("v"))
        mine = np.array([r["label"] for r in x.column("l").to_pylist()], np.int64)
        names, at = np.unique(np.array([r["label"] for r in y.column("r").to_pylist()], np.int64), return_inverse=True)
        onto = np.eye(len(names))[at] if len(names) else np.empty((0, 0))
        rows = []
        for s in range(0, len(q), _STRIP):
            part, ids = q[s : s + _STRIP], x.column("id").to_numpy()[s : s + _STRIP]
            other = (ids[:, None] != y.column("id").to_numpy()[None, :]).astype(float) if len(c) else np.empty((len(part), 0))
            d = distances(part, c, "l2") if len(c) else np.empty((len(part), 0))
            rows.append((ids, mine[s : s + _STRIP], (d * other) @ onto, other @ onto))
        out = [np.concatenate(z) for z in ([np.repeat(r[0], len(names)) for r in rows], [np.repeat(r[1], len(names)) for r in rows], [np.tile(names, len(r[0])) for r in rows], [r[3].ravel() for r in rows], [r[2].ravel() for r in rows])] if rows else [np.empty(0)] * 5
        kinds = (x.column("id").type, pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(z.astype(t.to_pandas_dtype()), t) for z, t in zip(out, kinds)], names=["id", "mine", "label", "n", "total"])

    sums = meet_blocks(a, p, meet, f"id {kind}, mine long, label long, n long, total double", block)
    return sums.groupBy("id", "mine", "label").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")


def centroid_labels(points: DataFrame, centroids: np.ndarray, key: str = "id", vector: str = "v") -> DataFrame:
    """``id, cid, dist``: the nearest centroid of every row (ties to the smaller number); a map over the rows.

    The centroids are sent to every task; their number is a parameter of the caller's, not of the data's size.
    """
    shared = points.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))
    kind = points.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            v = _matrix(pa.chunked_array([batch.column(1)]))
            if not len(v):
                continue
            best, least = (np.concatenate(x) for x in zip(*[(d2.argmin(axis=1), d2.min(axis=1)) for _, d2 in squares(v, c)]))
            yield pa.record_batch([batch.column(0), pa.array(best, pa.int32()), pa.array(np.sqrt(least))], names=["id", "cid", "dist"])

    return points.select(F.col(key).alias("id"), doubles(vector).alias("v")).dropna().mapInArrow(run, f"id {kind}, cid int, dist double")


def lloyd(points: DataFrame, k: int, rounds: int, key: str = "id", vector: str = "v") -> np.ndarray:
    """Centroids after rounds of Lloyd's algorithm, begun at the k rows first in id-hash order; empty ones keep their place.

    Sums are made per partition first; the driver holds k centroids.
    """
    rows = points.select(F.col(key).alias("id"), doubles(vector).alias("v")).dropna()
    first = rows.select(F.md5(F.col("id").cast("string")).alias("h"), "id", "v").orderBy("h", "id").limit(k)
    centroids = np.array([r["v"] for r in first.collect()])
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, n = np.zeros_like(c), np.zeros(len(c), np.int64)
            for batch in batches:
                v = _matrix(pa.chunked_array([batch.column(1)]))
                for a, d2 in squares(v, c):
                    best = d2.argmin(axis=1)
                    np.add.at(total, best, v[a : a + _STRIP])
                    n += np.bincount(best, minlength=len(c))
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["cid", "n", "total"])

        part = rows.mapInArrow(sums, "cid int, n long, total array<double>").select("cid", "n", F.posexplode("total").alias("d", "x"))
        for r in part.groupBy("cid", "d").agg((F.sum("x") / F.sum("n")).alias("x")).collect():
            centroids = centroids if centroids.flags.writeable else centroids.copy()
            centroids[r["cid"], r["d"]] = r["x"]
    return centroids


def squares(v: np.ndarray, c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Squared distances of strips of rows and centroids, with the strip's first row; the nearest few are computed exactly.

    By one product of matrices, as a strip of differences would be as wide as the vectors are long; rows whose nearest two
    are within rounding get exact values for all within it.
    """
    c2 = (c * c).sum(axis=1)
    for a in range(0, len(v), _STRIP):
        part = v[a : a + _STRIP]
        d2 = np.maximum((part * part).sum(axis=1)[:, None] + c2[None, :] - 2 * (part @ c.T), 0)
        low = d2.min(axis=1)
        near = d2 <= (low + 1e-9 * (1 + low + c2.max(initial=0)))[:, None]
        x, y = np.nonzero(near)
        d2[x, y] = ((part[x] - c[y]) ** 2).sum(axis=1)
        yield a, d2


def ivf_knn(queries: DataFrame, corpus: DataFrame, k: int, cells: int | None = None, probes: int = 16, rounds: int = 5, sample: int = 20_000, block: int = BLOCK, exclude_self: bool = True) -> DataFrame:
    """``src, dst, dist, rank``: approximate l2 neighbours from the ``probes`` nearest of ``cells`` inverted lists.

    By default there are as many cells as the square root of the rows, so lists and cells grow alike. Cells are fitted on at most about ``sample`` rows; all rows are listed and all rows of a probed list are compared
    exactly. Lists longer than a block are split, and their queries meet each part.
    """
    n = max(1, corpus.count())
    draw = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") * F.lit(2.0**-53)
    cells = cells or max(1, math.isqrt(n))
    centroids = lloyd(corpus.where(draw < min(1.0, max(sample, 8 * cells) / n)), cells, rounds)
    shared = corpus.sparkSession.sparkContext.broadcast(centroids)

    def probe(batches: Iterator[pa.RecordBatch], m: int) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            v = _matrix(pa.chunked_array([batch.column(1)]))
            if len(v):
                near = np.concatenate([np.argsort(d2, axis=1, kind="stable")[:, :m] for _, d2 in squares(v, c)]).astype(np.int32)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(list(near), pa.list_(pa.int32()))], names=["id", "v", "cells"])

    def listed(df: DataFrame, m: int) -> DataFrame:
        rows = df.select("id", doubles("v").alias("v")).dropna()
        kind = rows.schema["id"].dataType.simpleString()
        return rows.mapInArrow(lambda it: probe(it, m), f"id {kind}, v array<double>, cells array<int>").select("id", "v", F.explode("cells").alias("cell"))

    posted, asked = listed(corpus, 1), listed(queries, probes)
    parts = posted.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    right = posted.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(1).alias("side"), "id", "v")
    left = asked.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "id", "v")
    kind = queries.schema["id"].dataType.simpleString()

    def meet(table: pa.Table) -> pa.Table:
        side, ids, v = table.column("side").to_numpy(), table.column("id").to_numpy(), _matrix(table.column("v"))
        qs, cs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        row, best, d = block_top_k(v[qs], ids[qs], v[cs], ids[cs], k, "l2", exclude_self) if len(qs) and len(cs) else (np.empty(0, int),) * 2 + (np.empty(0),)
        return pa.table([pa.array(ids[qs[row]]), pa.array(ids[cs[best]]), pa.array(d, pa.float64())], names=["src", "dst", "dist"])

    near = left.unionByName(right).groupBy("cell", "part").applyInArrow(meet, f"src {kind}, dst {kind}, dist double")
    best = Window.partitionBy("src").orderBy("dist", "dst")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def without_self(neighbours: DataFrame, k: int) -> DataFrame:
    """The neighbours without each query itself, ranked again and cut to k."""
    best = Window.partitionBy("src").orderBy("dist", "dst")
    return neighbours.where("src != dst").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def short_or_repeated(neighbours: DataFrame, k: int) -> DataFrame:
    """``src, n, distinct_n``: queries whose list isn't k distinct others; empty if all are sound."""
    sizes = neighbours.where("src != dst").groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("distinct_n"))
    return sizes.where((F.col("n") != k) | (F.col("distinct_n") != k))


def regress(neighbours: DataFrame, values: DataFrame, *columns: str) -> DataFrame:
    """``src`` and the mean of its neighbours' values. ``values``: ``id`` and the columns."""
    met = neighbours.join(values.withColumnRenamed("id", "dst"), "dst")
    return met.groupBy("src").agg(*[F.avg(c).alias(c) for c in columns])


def recall(found: DataFrame, truth: DataFrame, k: Column | int) -> DataFrame:
    """``src, hits, recall``: how many of each query's true neighbours were found; queries without a hit count as 0."""
    hits = truth.select("src", "dst").join(found.select("src", "dst").withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    hits = hits.groupBy("src").agg(F.count("hit").alias("hits"))
    return hits.withColumn("recall", F.col("hits") / F.lit(k))
