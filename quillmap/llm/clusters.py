"""Similarity clusters, by parallel pivot correlation clustering.

Rounds: of the vectors that are left, those first in a random hash order are a batch; a vector of the batch is a pivot if
no earlier pivot is similar to it; pivots absorb all similar vectors that are left. That equals taking local minima of the
hash order one by one. Members then go to their closest pivot, and medoids are recomputed.

Clusters that are meant as "similar, also through others" are unions of pivot clusters. They are joined exactly: a vector
that is similar to a second pivot links the two; for all other links, bounds on the angles to the clusters' centres leave
pairs of clusters and the few members that may be similar, which are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.llm.vectors import greedy_pivots, pack, priorities, units, unpack, usable_rows
from quillmap.operators.components import connected_components
from quillmap.session import stage, unstage

#: Vectors of a batch at most (on average); the driver holds one batch, the workers one batch of pivots at a time.
BATCH = 16_384
#: Rounding of single precision, within which cosines are computed again.
BAND = 4e-6
#: Members of one side of a pair of clusters that are compared by one task.
SIDE = 4096


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (unit vectors) have a cosine of ``least``; close cases in double precision."""
    s = a @ b.T
    yes = s >= least
    x, y = np.nonzero(np.abs(s - np.float32(least)) < BAND)
    if len(x):
        wa, wb = a[x].astype(np.float64), b[y].astype(np.float64)
        exact = np.einsum("ij,ij->i", wa, wb) / np.sqrt(np.einsum("ij,ij->i", wa, wa) * np.einsum("ij,ij->i", wb, wb))
        yes[x, y] = exact >= least - 1e-9
    return yes


def _units_of(vectors: DataFrame, width: int) -> DataFrame:
    """``i, u``: usable vectors as packed unit rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = usable_rows(batch.column(1), width)
            yield pa.record_batch([batch.column(0).take(pa.array(at)), pack(units(raw))], names=["i", "u"])

    return vectors.mapInArrow(run, "i long, u binary")


def _draw() -> Column:
    return F.shiftrightunsigned(F.xxhash64("i"), 11).cast("double") * F.lit(2.0**-53)


class Pivots:
    """Pivots in the order they were found, numbered from 0; each round's are written to the shared folder."""

    def __init__(self, width: int):
        self.rounds: list[tuple[int, int, DataFrame]] = []
        self.width = width

    def __len__(self) -> int:
        return sum(n for _, n, _ in self.rounds)

    def add(self, spark: SparkSession, ids: np.ndarray, rows: np.ndarray) -> None:
        first = len(self)
        table = pa.table({"p": pa.array(np.arange(first, first + len(ids)), pa.int32()), "i": pa.array(ids), "u": pack(rows)})
        self.rounds.append((first, len(ids), stage(spark.createDataFrame(table), "pivots")))

    def blocks(self, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """The first number and the rows of blocks of rounds, of at most ``most`` rows where a round isn't larger itself."""
        at = 0
        while at < len(self.rounds):
            end, n = at + 1, self.rounds[at][1]
            while end < len(self.rounds) and n + self.rounds[end][1] <= most:
                n += self.rounds[end][1]
                end += 1
            parts = [unpack(df.sort("p").select("u").toArrow().column("u"), self.width) for _, _, df in self.rounds[at:end]]
            yield self.rounds[at][0], np.concatenate(parts)
            at = end


def _absorb(left: DataFrame, rows: np.ndarray, least: float) -> DataFrame:
    """The vectors that are not similar to any of the pivots."""
    shared = left.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            u = unpack(batch.column(1), p.shape[1])
            free = np.concatenate([~_similar(u[a : a + 1024], p, least).any(axis=1) for a in range(0, len(u), 1024)] or [np.empty(0, bool)])
            yield batch.filter(pa.array(free))

    return left.mapInArrow(run, "i long, u binary")


def find_pivots(vectors: DataFrame, width: int, least: float, batch: int = BATCH) -> Pivots:
    """Rounds of pivots until every usable vector is absorbed. ``vectors``: columns ``i, v``."""
    pivots, left = Pivots(width), _units_of(vectors, width)
    n, staged, reached = vectors.count(), None, 0.0
    while n:
        share = min(1.0, batch / n)
        # The batch is the beginning of what is left in the hash order: all before the last one's end is absorbed.
        reached = 1.0 if share == 1.0 else reached + share * (1 - reached)
        part = left.where(_draw() < reached).toArrow()
        ids, rows = part.column("i").to_numpy(), unpack(part.column("u"), width)
        order = np.argsort(priorities(ids, 3), kind="stable")
        ids, rows = ids[order], rows[order]
        chosen = greedy_pivots(rows, least)
        if len(chosen):
            pivots.add(vectors.sparkSession, ids[chosen], rows[chosen])
        if share == 1.0:
            break
        if len(chosen):
            fresh = stage(_absorb(left, rows[chosen], least), "left")
            if staged is not None:
                unstage(staged)
            staged = left = fresh
        n = left.count()
    if staged is not None:
        unstage(staged)
    return pivots


def _assign(unit: DataFrame, pivots: Pivots, least: float) -> tuple[DataFrame, DataFrame]:
    """``i, u, p`` with the closest pivot's number, and ``src, dst``: pivots linked by a vector similar to both."""
    spark, held = unit.sparkSession, None
    kept: DataFrame = unit.withColumns({"p": F.lit(-1), "c": F.lit(-2.0).cast("float"), "more": F.array().cast("array<int>")})
    for start, rows in pivots.blocks(4 * BATCH):
        if held is not None:  # one block of pivots at a time, in the workers as on the driver
            kept = held
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], start: int = start, shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for batch in batches:
                u = unpack(batch.column(1), p.shape[1])
                best, cosine = batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy()
                also = batch.column(4).to_pylist()
                for a in range(0, len(u), 512):
                    part = u[a : a + 512]
                    s = part @ p.T
                    top = s.argmax(axis=1)
                    value = s[np.arange(len(part)), top]
                    closer = value > cosine[a : a + 512]
                    x, y = np.nonzero(s >= np.float32(least - BAND))
                    sure = _pairs_similar(part, p, x, y, s, least)
                    for i, j in zip(x[sure], y[sure]):
                        also[a + i].append(start + int(j))
                    best[a : a + 512] = np.where(closer, start + top, best[a : a + 512])
                    cosine[a : a + 512] = np.where(closer, value, cosine[a : a + 512])
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(best, pa.int32()), pa.array(cosine, pa.float32()), pa.array(also, pa.list_(pa.int32()))], names=["i", "u", "p", "c", "more"])

        done = stage(kept.mapInArrow(run, "i long, u binary, p int, c float, more array<int>"), "assigned")
        if held is not None:
            unstage(held)
        held = done
    links = held.select("p", F.explode("more").alias("q")).where("p != q").select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst")).distinct()
    return held.select("i", "u", "p"), links


def _pairs_similar(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, s: np.ndarray, least: float) -> np.ndarray:
    sure = s[x, y] >= np.float32(least + BAND)
    close = np.flatnonzero(~sure)
    if len(close):
        wa, wb = a[x[close]].astype(np.float64), b[y[close]].astype(np.float64)
        exact = np.einsum("ij,ij->i", wa, wb) / np.sqrt(np.einsum("ij,ij->i", wa, wa) * np.einsum("ij,ij->i", wb, wb))
        sure[close] = exact >= least - 1e-9
    return sure


def _sums(held: DataFrame, width: int) -> DataFrame:
    """``p, n, total``: members and packed vector sums of each pivot cluster, added up batch by batch first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, p = unpack(batch.column(1), width).astype(np.float64), batch.column(2).to_numpy()
            own, at = np.unique(p, return_inverse=True)
            total = np.zeros((len(own), width))
            np.add.at(total, at, u)
            yield pa.record_batch([pa.array(own, pa.int32()), pa.array(np.bincount(at, minlength=len(own)), pa.int64()), pack(total)], names=["p", "n", "total"])

    def final(table: pa.Table) -> pa.Table:
        total = unpack(table.column("total"), width).astype(np.float64).sum(axis=0, keepdims=True)
        return pa.table([table.column("p")[:1], pa.array([int(table.column("n").to_numpy().sum())], pa.int64()), pack(total)], names=["p", "n", "total"])

    return held.mapInArrow(partial, "p int, n long, total binary").groupBy("p").applyInArrow(final, "p int, n long, total binary")


def _radii(held: DataFrame, sums: DataFrame, width: int) -> DataFrame:
    """``p, centre, least``: the centre of every cluster of several members and their lowest cosine to it.

    Centres go to the members in blocks of a bounded number, so members aren't shuffled.
    """
    several = sums.where("n > 1").select("p", "total")
    slices = max(1, -(-several.count() // BATCH))
    found = None
    for s in range(slices):
        part = (several if slices == 1 else several.where(F.pmod(F.xxhash64("p"), F.lit(slices)) == s)).sort("p").toArrow()
        shared = held.sparkSession.sparkContext.broadcast((part.column("p").to_numpy(), units(unpack(part.column("total"), width))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            number, centre = shared.value
            low = np.full(len(number), 2.0)
            for batch in batches:
                u, p = unpack(batch.column(0), width), batch.column(1).to_numpy()
                at = np.searchsorted(number, p)
                mine = np.flatnonzero((at < len(number)) & (number[np.minimum(at, len(number) - 1)] == p)) if len(number) else np.empty(0, np.int64)
                np.minimum.at(low, at[mine], np.einsum("ij,ij->i", u[mine].astype(np.float64), centre[at[mine]].astype(np.float64)))
            seen = np.flatnonzero(low < 2)
            yield pa.record_batch([pa.array(number[seen], pa.int32()), pa.array(low[seen])], names=["p", "least"])

        lowest = held.select("u", "p").mapInArrow(run, "p int, least double").groupBy("p").agg(F.min("least").alias("least"))
        found = lowest if found is None else found.unionByName(lowest)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pack(units(unpack(batch.column(1), width))), batch.column(2)], names=["p", "centre", "least"])

    return several.join(found, "p").mapInArrow(centred, "p int, centre binary, least double")


def _member_links(held: DataFrame, radii: DataFrame, component: DataFrame, width: int, least: float) -> DataFrame:
    """``src, dst``: pivot clusters of different components of which two members are similar.

    A member of one can be similar to a member of the other only if its angle to the other's centre is at most that
    cluster's radius plus the angle of the threshold. Both sides keep the members that pass, in slices that meet pairwise.
    Centres are read in blocks of a bounded number.
    """
    spark = held.sparkSession
    linked = bool(component.head(1))
    table = radii.join(component, radii["p"] == component["node"], "left").select("p", "centre", "least", F.coalesce("component", "p").alias("k"))
    theta = float(np.arccos(least))
    passing = None
    count = table.count()
    if count < 2:
        return spark.createDataFrame([], "src int, dst int")
    slices = -(-count // BATCH)
    for s in range(slices):
        part = (table if slices == 1 else table.where(F.pmod(F.xxhash64("p"), F.lit(slices)) == s)).toArrow()
        p, k = part.column("p").to_numpy(), part.column("k").to_numpy()
        limit = np.cos(np.minimum(np.pi, np.arccos(np.clip(part.column("least").to_numpy(), -1, 1)) + theta + 2e-3))
        shared = spark.sparkContext.broadcast((unpack(part.column("centre"), width), p, k, limit.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            centre, number, comp, low = shared.value
            for batch in batches:
                u, own, k = unpack(batch.column(1), width), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                for a in range(0, len(u), 512):
                    x, y = np.nonzero(u[a : a + 512] @ centre.T >= low)
                    x += a
                    other = comp[y] != k[x]
                    x, y = x[other], y[other]
                    if len(x):
                        yield pa.record_batch([pa.array(own[x]), pa.array(number[y].astype(np.int32)), batch.column(0).take(pa.array(x)), batch.column(1).take(pa.array(x))], names=["p", "q", "i", "u"])

        members = held.select("i", "u", "p", F.col("p").alias("k"))
        if linked:
            members = held.join(component, held["p"] == component["node"], "left").select("i", "u", "p", F.coalesce("component", "p").alias("k"))
        found = members.mapInArrow(run, "p int, q int, i long, u binary")
        passing = found if passing is None else passing.unionByName(found)
    passing = stage(passing, "passing")
    several = table.select(F.col("p").alias("m"))
    # Single vectors are pivots, which every vector has been compared with; the others need passing members on both sides.
    sizes = passing.groupBy("p", "q").agg(F.count("*").alias("n")).join(several, F.col("p") == F.col("m"), "left_semi")
    there, back = sizes.where("p < q"), sizes.where("p > q").select(F.col("q").alias("p"), F.col("p").alias("q"), F.col("n").alias("o"))
    pairs = there.join(back, ["p", "q"]).select("p", "q", F.ceil(F.col("n") / SIDE).cast("int").alias("a"), F.ceil(F.col("o") / SIDE).cast("int").alias("b"))
    cut = F.xxhash64("i")
    left = passing.join(pairs, ["p", "q"]).select("p", "q", F.pmod(cut, "a").alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("b") - F.lit(1).cast("bigint"))).alias("y"), F.lit(0).alias("side"), "u")
    other = passing.select(F.col("q").alias("p"), F.col("p").alias("q"), "i", "u").join(pairs, ["p", "q"])
    right = other.select("p", "q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("a") - F.lit(1).cast("bigint"))).alias("x"), F.pmod(cut, "b").alias("y"), F.lit(1).alias("side"), "u")

    def meet(part: pa.Table) -> pa.Table:
        side, u = part.column("side").to_numpy(), unpack(part.column("u"), width)
        a, b = u[side == 0], u[side == 1]
        linked = any(_similar(a[s : s + 512], b, least).any() for s in range(0, len(a), 512)) if len(b) else False
        return part.select(["p", "q"]).slice(0, int(linked)).rename_columns(["src", "dst"])

    return left.unionByName(right).groupBy("p", "q", "x", "y").applyInArrow(meet, "src int, dst int").distinct()


class SimilarityClusters:
    """Pivot clusters and their unions.

    ``held``: ``i, u, p``, every usable vector with its closest pivot's number; ``unions``: ``p, k``, the union each pivot
    cluster is in (by its smallest pivot number).
    """

    def __init__(self, vectors: DataFrame, key: str, vector: str, width: int, least: float, batch: int = BATCH):
        source = vectors.select(vectors[key].cast("long").alias("i"), vectors[vector].cast("array<float>").alias("v")).where(F.col("i").isNotNull())
        spark, self.width = source.sparkSession, width
        self.pivots = find_pivots(source, width, least, batch)
        if not len(self.pivots):
            self.held = spark.createDataFrame([], "i long, u binary, p int")
            self.unions = spark.createDataFrame([], "p int, k int")
            return
        self.held, links = _assign(_units_of(source, width), self.pivots, least)
        links = stage(links, "links")
        component = stage(connected_components(links), "component") if links.head(1) else spark.createDataFrame([], "node int, component int")
        self.sums = stage(_sums(self.held, width), "sums")
        more = stage(_member_links(self.held, _radii(self.held, self.sums, width), component, width, least), "links")
        if more.head(1):
            component = stage(connected_components(links.unionByName(more)), "component")
        self.unions = self.sums.select("p").join(component, F.col("p") == F.col("node"), "left").select("p", F.coalesce("component", "p").alias("k"))

    def members(self, least_size: int) -> DataFrame:
        """``i, first, size``: members of the unions of at least ``least_size`` vectors."""
        per_pivot = self.held.groupBy("p").agg(F.min("i").alias("first"), F.count("*").alias("n")).join(self.unions, "p")
        total = per_pivot.groupBy("k").agg(F.min("first").alias("first"), F.sum("n").alias("size")).where(F.col("size") >= least_size)
        named = per_pivot.select("p", "k").join(total, "k").select("p", "first", "size")
        return self.held.select("i", "p").join(named, "p").select("i", "first", "size")

    def described(self, least_size: int, typical: int) -> DataFrame:
        """``first, size, medoid, typical``: each union's size, its medoid, and its most typical members in order.

        The mean cosine of a member to all members is its cosine to their sum, so typical members are the highest of it.
        """
        sums = self.sums.join(self.unions, "p").select(F.col("k").alias("p"), "n", "total")
        width = self.width

        def final(table: pa.Table) -> pa.Table:
            total = unpack(table.column("total"), width).astype(np.float64).sum(axis=0, keepdims=True)
            return pa.table([table.column("p")[:1], pa.array([int(table.column("n").to_numpy().sum())], pa.int64()), pack(total)], names=["p", "n", "total"])

        merged = sums.groupBy("p").applyInArrow(final, "p int, n long, total binary").where(F.col("n") >= least_size).withColumnRenamed("p", "k")
        rows = self.held.join(self.unions.join(merged, "k"), "p").select("k", "i", "u", "total")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (unpack(batch.column(c), width).astype(np.float64) for c in (2, 3))
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.round(np.einsum("ij,ij->i", a, b), 6))], names=["k", "i", "score"])

        scored = rows.mapInArrow(score, "k int, i long, score double")
        best = Window.partitionBy("k").orderBy(F.desc("score"), "i")
        top = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= typical)
        lists = top.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "i"))), lambda x: x["i"]).alias("typical"))
        sizes = scored.groupBy("k").agg(F.min("i").alias("first"), F.count("*").alias("size"))
        return sizes.join(lists, "k").select("first", "size", F.get("typical", F.lit(0)).alias("medoid"), "typical")


def similarity_clusters(vectors: DataFrame, key: str, vector: str, width: int, least: float, least_size: int = 1, batch: int = BATCH) -> DataFrame:
    """``i, first, size``: every member of a cluster of at least ``least_size``, with the cluster's smallest id and size.

    Two vectors are in one cluster if their cosine is at least ``least``, also through others. Vectors that are null, of
    another width, all zero or not finite are in none; equal vectors are members each. Ids must be unique; rows with a null
    id and other columns are ignored; an empty table has no clusters. Exact up to the rounding of unit vectors to single
    precision (about 1e-7 of a cosine).
    """
    return SimilarityClusters(vectors, key, vector, width, least, batch).members(least_size)
