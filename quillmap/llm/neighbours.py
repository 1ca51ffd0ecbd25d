"""The k most similar vectors of every vector, by a permutation index.

Every vector is represented by its nearest pivots in order. Some pivots, less similar to each other than a bound, head
inverted files; a vector is posted in the file of the nearest head. A query reads its own file, and those of its first
heads if it lies far from its own; the rows it meets are ranked by the footrule distance of the orders of pivots, and the
first of them reranked by exact cosines. Queries for which some file not read may, by what is known of its rows' angles,
hold more similar vectors than those found then read these files too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.llm.vectors import best_columns, digests, greedy_pivots, pack, priorities, top_cosines, units, unpack, usable_rows
from quillmap.session import stage

#: The index is fitted on so many vectors of a fixed random order, or ROOTS for each square root of the rows if that is
#: more; all rows are indexed.
SAMPLE, ROOTS = 16_384, 52
#: Pivots beside the heads of files, for each square root of the rows.
EXTRA = 4
#: Heads are less similar than this to each other; a row less similar to its head is a stray.
SEPARATION = 0.8
#: A permutation is the PREFIX nearest pivots; places count in steps of STEP, so that a sum of them fits a byte.
PREFIX, STEP = 56, 8
#: Files a stray reads at first.
FIRST = 4
#: A file is read if its rows may be as similar as the k-th found, their angles lying so many deviations off.
DEVIATIONS = 5.0
#: Rows that are reranked of a meeting, by footrule; with ties, more. Where no more are met, all are.
KEEP = 1024
#: Rows of neighbouring files that meet each other; rows of a shelf of them, which is what readers meet. A file larger than
#: a shelf is split into parts that meet pairwise.
BLOCK, SHELF = 2048, 16_384
#: Readers of a shelf; more are split.
READERS = 65_536
#: Owners of equal vectors that get their common list in one task.
OWNERS = 50_000

_LEFT, _RIGHT, _READER, _SHELF = range(4)
_TILE = 256
_NEAR = "side int, id long, neighbor long, similarity double, open double, kth double, vector binary"
_PLACED = "shelf int, a int, b int, salt int, role int, side int, id long, block int, asked long, meetings int, open double, perm binary, vector binary"


@dataclass
class PermutationIndex:
    """What is known of the pivots and files; its size depends on the number of pivots, not of rows."""

    pivots: np.ndarray  # unit rows; the first ones head files
    count: np.ndarray  # rows of each file
    core: np.ndarray  # mean cosine of a file's head and its rows that are no strays
    stray: np.ndarray  # the same of its strays
    block: np.ndarray  # block of each file
    shelf: np.ndarray  # shelf of each file
    parts: np.ndarray  # parts of each shelf
    salts: np.ndarray  # splits of each shelf's readers
    deviations: float | None
    keep: int | None
    k: int
    separation: float

    def __post_init__(self) -> None:
        self.heads = len(self.count)
        self.starts = np.flatnonzero(np.diff(self.block, prepend=-1))  # first files of blocks
        self.shelf_of = self.shelf[self.starts]
        place = np.arange(len(self.starts)) - np.flatnonzero(np.diff(self.shelf_of, prepend=-1))[self.shelf_of]
        self.bit = np.int64(1) << np.minimum(place, 62).astype(np.int64)  # of a block among those of its shelf
        width = self.pivots.shape[1]
        off = np.float32((self.deviations or 0) / np.sqrt(width))
        self.reach = [(m.astype(np.float32), (off * np.sqrt(np.clip(1 - m**2, 0, 1))).astype(np.float32)) for m in (self.core, self.stray)]
        # The most similar any row may be of a file whose head has a cosine, for a grid of cosines.
        grid = np.linspace(-1, 1, 1025, dtype=np.float32)
        self.envelope = np.maximum.accumulate([self.likely(np.full((1, self.heads), c, np.float32)).max(initial=-1) for c in grid])

    def likely(self, cosines: np.ndarray) -> np.ndarray:
        """How similar a file's rows may be to a query, given the cosines of query and heads; -2 for empty files."""
        side = np.sqrt(np.clip(1 - cosines * cosines, 0, 1))
        out = cosines.copy()
        for mean, spread in self.reach:
            np.maximum(out, cosines * mean + side * spread, out=out)
        out[:, self.count == 0] = -2
        return out

    def orders(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit rows: the nearest heads and their cosines, FIRST + 1 of them, and the permutations."""
        heads, cosines, orders = [], [], []
        n, most = len(self.pivots), min(FIRST + 1, self.heads)
        tile = max(64, (1 << 21) // n)  # a tile of cosines has the same size for any number of pivots
        for a in range(0, len(rows), tile):
            s = rows[a : a + tile] @ self.pivots.T
            h, c = _first(s[:, : self.heads], most)
            heads.append(h)
            cosines.append(c)
            orders.append(_first(s, min(PREFIX, n))[0].astype(np.int32))
        if not heads:
            return np.empty((0, most), np.int64), np.empty((0, most), np.float32), np.empty((0, min(PREFIX, n)), np.int32)
        return np.concatenate(heads), np.concatenate(cosines), np.concatenate(orders)

    def opening(self, cosine: np.ndarray) -> np.ndarray:
        """A bound of what files hold whose heads are at most so similar; rows that have found better are settled."""
        if self.deviations is None:
            return np.full(len(cosine), np.inf)
        at = np.clip(np.ceil((cosine + 1) * 512).astype(np.int64), 0, 1024)
        return self.envelope[at]

    def begins(self, heads: np.ndarray, cosines: np.ndarray, side: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The blocks each query reads first beside its own, and the bound of what other files hold."""
        stray = (cosines[:, 0] < self.separation) | (self.count[heads[:, 0]] <= 2 * self.k)
        own = 1 if side == 0 else 0  # a row of the corpus meets its own block anyway
        reads = [np.setdiff1d(self.block[h[own : FIRST if s else 1]], self.block[h[:own]]) for h, s in zip(heads, stray)]
        at = np.where(stray, np.minimum(FIRST, heads.shape[1] - 1), min(1, heads.shape[1] - 1))
        return reads, self.opening(cosines[np.arange(len(cosines)), at])

    def asks(self, rows: np.ndarray, kth: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Row numbers and the blocks with files that may hold more similar rows than the k-th found."""
        tile = max(64, (1 << 21) // self.heads)
        for a in range(0, len(rows), tile):
            c = rows[a : a + tile] @ self.pivots[: self.heads].T
            files = (self.likely(c) >= kth[a : a + tile, None].astype(np.float32) - np.float32(1e-6)) if self.deviations is not None else np.broadcast_to(self.count > 0, c.shape)
            for i, read in enumerate(np.logical_or.reduceat(files, self.starts, axis=1)):
                yield a + i, np.flatnonzero(read)

    def by_shelf(self, blocks: np.ndarray) -> list[tuple[int, int]]:
        """Shelves of blocks, and which of a shelf's blocks they are, as bits."""
        out: dict[int, int] = {}
        for b in blocks.tolist():
            s = int(self.shelf_of[b])
            out[s] = out.get(s, 0) | int(self.bit[b])
        return list(out.items())


def _first(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the greatest scores of each row, in order."""
    top = np.asarray(best_columns(scores, most))
    c = np.take_along_axis(scores, top, axis=1)
    o = np.argsort(-c, axis=1, kind="stable")
    return np.take_along_axis(top, o, axis=1), np.take_along_axis(c, o, axis=1)


def _pack_orders(orders: np.ndarray) -> pa.Array:
    ends = np.arange(len(orders) + 1, dtype=np.int32) * (orders.shape[1] * orders.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(orders), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(orders).tobytes())])


def footrule_first(asked: np.ndarray, met: np.ndarray, keep: int) -> np.ndarray:
    """Which of the met rows are first by footrule for each asked row: at least ``keep``, with all ties of the last.

    A pivot that isn't in a permutation stands behind its end, so the distance of two permutations is the same for all
    pairs less twice the sum, over common pivots, of the smaller of the two heights above the end. That sum is ranked.
    """
    n, m, length = len(asked), len(met), asked.shape[1]
    height = (-(-length // STEP) - np.arange(length) // STEP).astype(np.uint8)
    known = np.unique(asked)
    number = np.zeros(max(int(known[-1]), int(met.max())) + 1, np.int32)
    number[known] = np.arange(1, len(known) + 1)
    table = np.zeros((len(known) + 1, n), np.uint8)
    for t in range(length):
        table[number[asked[:, t]], np.arange(n)] = height[t]
    local, common = number[met.T], np.zeros((m, n), np.uint8)
    for t, pivot in enumerate(local):
        if t % STEP == 0:
            low = np.minimum(table, height[t])
        at = np.flatnonzero(pivot)
        if len(at) * 2 > m:
            common += low[pivot]
        elif len(at):
            common[at] += low[pivot[at]]
    common = np.ascontiguousarray(common.T)
    counts = np.stack([np.bincount(row, minlength=256) for row in common])
    enough = np.cumsum(counts[:, ::-1], axis=1) >= min(keep, m)
    last = 255 - enough.argmax(axis=1)
    return common >= last.astype(np.uint8)[:, None]


def search(asked: tuple[np.ndarray, ...], met: tuple[np.ndarray, ...], k: int, keep: int | None, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, met row, cosine``: the k most similar of the first by footrule.

    ``asked``, ``met``: vectors, permutations, ids. ``same``: rows aren't their own neighbours.
    """
    (q, q_order, q_ids), (c, c_order, c_ids) = asked, met
    if not len(q) or not len(c):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if keep is None or keep >= len(c):
        return top_cosines(q, q_ids if same else None, c, c_ids, k)
    # Rows of the same files beside each other have many pivots in common, which makes ranking them cheap.
    order = np.lexsort((q_ids, q_order[:, 0]))
    q, q_order, q_ids = q[order], q_order[order], q_ids[order]
    row, best, sim = top_cosines(q, q_ids if same else None, c, c_ids, k, choose=lambda a, b: footrule_first(q_order[a:b], c_order, keep), tile=_TILE)
    return order[row], best, sim


def _first_of(row: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k first by similarity, then id, of each row."""
    order = np.lexsort((ids, -sim, row))
    starts = np.flatnonzero(np.diff(row[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) < k]


def sample_units(vectors: DataFrame, width: int, size: int, n: int) -> np.ndarray:
    """About ``size`` usable vectors of ``n`` in a random order that depends on their ids only."""
    share = min(1.0, size / max(n, 1))
    draw = F.shiftrightunsigned(F.xxhash64("i"), 11).cast("double") * F.lit(2.0**-53)
    table = (vectors if share == 1.0 else vectors.where(draw < share)).toArrow()
    at, rows = usable_rows(table.column("v"), width)
    if not len(at) and share < 1.0:  # hardly any row is usable: look among those that are
        table = vectors.mapInArrow(partial(_usable_only, width=width), vectors.schema).limit(size).toArrow()
        at, rows = usable_rows(table.column("v"), width)
    ids = table.column("i").to_numpy()[at]
    return units(rows[np.argsort(priorities(ids), kind="stable")])


def _usable_only(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, _ = usable_rows(batch.column(1), width)
        yield batch.take(pa.array(at, pa.int64()))


def _packed(sizes: np.ndarray, room: int) -> np.ndarray:
    """Numbers of bins for items in order, each bin of neighbours up to ``room``; a larger item is alone."""
    out, left, bin_ = np.zeros(len(sizes), np.int64), 0, -1
    for i, n in enumerate(sizes):
        if n > left or bin_ < 0:
            bin_, left = bin_ + 1, room
        out[i] = bin_
        left = max(0, left - int(n)) if n <= room else 0
    return out


def fit(vectors: DataFrame, width: int, k: int, sample: int = SAMPLE, separation: float = SEPARATION, block: int = BLOCK, shelf: int = SHELF, keep: int | None = KEEP, deviations: float | None = DEVIATIONS, readers: float = 0.0) -> PermutationIndex | None:
    """Pivots of a sample, and the sizes and angles of their files over all rows. None if no vector is usable.

    ``vectors``: the rows that are posted, without copies; ``readers``: queries for each of them.
    """
    n = vectors.count()
    rows = sample_units(vectors, width, max(sample, int(ROOTS * np.sqrt(n)) if sample >= SAMPLE else 0), n)
    if not len(rows):
        return None
    heads = greedy_pivots(rows, separation)
    extra = np.setdiff1d(np.arange(min(len(rows), int(np.ceil(EXTRA * np.sqrt(n))))), heads)
    pivots = rows[heads]
    # Neighbouring heads get neighbouring numbers, so that blocks and shelves hold files that are read together.
    coarse = _first(pivots @ pivots[:64].T, min(4, len(pivots)))[0]
    pivots = np.concatenate([pivots[np.lexsort(tuple(coarse[:, c] for c in range(coarse.shape[1] - 1, -1, -1)))], rows[extra]])
    h = len(heads)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots[:h])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        n, total = np.zeros((3, len(p)), np.int64), np.zeros((3, len(p)))
        for batch in batches:
            _, raw = usable_rows(batch.column(0), width)
            u = units(raw)
            for a in range(0, len(u), t := max(64, (1 << 21) // len(p))):
                s = u[a : a + t] @ p.T
                near = s.argmax(axis=1)
                c = s[np.arange(len(s)), near]
                kind = np.where(c > 1 - 1e-5, 2, np.where(c >= separation, 0, 1))  # a head itself says nothing of its file
                np.add.at(n, (kind, near), 1)
                np.add.at(total, (kind, near), c)
        kind, at = np.nonzero(n)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(kind, pa.int32()), pa.array(n[kind, at]), pa.array(total[kind, at])], names=["file", "kind", "n", "total"])

    found = vectors.select("v").mapInArrow(sizes, "file int, kind int, n long, total double").groupBy("file", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    count, mean = np.zeros((3, h), np.int64), np.ones((3, h))
    at = (found.column("kind").to_numpy(), found.column("file").to_numpy())
    count[at] = found.column("n").to_numpy()
    mean[at] = found.column("total").to_numpy() / count[at]
    total = count.sum(axis=0)
    blocks = _packed(total, block)
    shelves = _packed(held := np.bincount(blocks, total), shelf)
    parts = np.maximum(1, -(-np.bincount(shelves, held) // shelf)).astype(np.int64)
    index = PermutationIndex(pivots, total, mean[0], mean[1], blocks, shelves[blocks], parts, np.ones(len(parts), np.int64), deviations, keep, k, separation)
    # How many rows read each shelf is estimated from the sample, only to split the work evenly.
    near, cosines, _ = index.orders(rows)
    load = np.bincount(index.shelf_of[np.concatenate(index.begins(near, cosines, 0)[0]).astype(np.int64)], minlength=len(parts)) + np.bincount(index.shelf[near[:, 0]], minlength=len(parts)) * readers
    index.salts = np.maximum(1, np.ceil(load * (total.sum() / len(rows)) / READERS)).astype(np.int64)
    return index


def _place(vectors: DataFrame, index: PermutationIndex, width: int, side: int, begin: bool) -> DataFrame:
    """Every row of ``i, v`` at each meeting it takes part in: its shelf, and at the beginning what it reads first."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: PermutationIndex = shared.value
        for batch in batches:
            at, raw = usable_rows(batch.column(1), width)
            if not len(at):
                continue
            ids = batch.column(0).to_numpy()[at]
            heads, cosines, orders = ix.orders(units(raw))
            block = ix.block[heads[:, 0]]
            part, draw = priorities(ids, 1), priorities(ids, 2)
            reads, opening = ix.begins(heads, cosines, side) if begin else ([block[:0]] * len(ids), np.zeros(len(ids)))
            rows: list[tuple[int, int, int, int, int, int, int]] = []
            meetings = np.zeros(len(ids), np.int32)
            for n, home in enumerate(ix.shelf[heads[:, 0]].tolist()):
                before = len(rows)
                if side == 0:
                    own = int(ix.bit[block[n]])
                    parts = int(ix.parts[home])
                    mine = int(part[n] % parts)
                    if begin:
                        rows += [(n, home, min(mine, other), max(mine, other), 0, _LEFT if mine <= other else _RIGHT, own) for other in range(parts)]
                    rows += [(n, home, mine, mine, salt, _SHELF, own) for salt in range(int(begin), int(ix.salts[home]))]
                rows += [(n, s, c, c, int(draw[n] % ix.salts[s]), _READER, bits) for s, bits in ix.by_shelf(reads[n]) for c in range(int(ix.parts[s]))]
                meetings[n] = sum(r[5] != _SHELF for r in rows[before:])
            yield from _placed(np.array(rows, np.int64).reshape(-1, 7), np.full(len(ids), side), ids, block, meetings, opening, orders, raw, ix)

    return vectors.mapInArrow(place, _PLACED)


def _placed(table: np.ndarray, side: np.ndarray, ids: np.ndarray, block: np.ndarray, meetings: np.ndarray, opening: np.ndarray, orders: np.ndarray, raw: np.ndarray, ix: PermutationIndex) -> Iterator[pa.RecordBatch]:
    orders = orders.astype(np.int16 if len(ix.pivots) < 1 << 15 else np.int32)
    for a in range(0, len(table), 50_000):
        some = table[a : a + 50_000]
        n = some[:, 0]
        ints = [pa.array(some[:, c].astype(np.int32)) for c in range(1, 6)]
        own = [pa.array(side[n].astype(np.int32)), pa.array(ids[n]), pa.array(block[n].astype(np.int32)), pa.array(some[:, 6]), pa.array(meetings[n].astype(np.int32)), pa.array(opening[n].astype(np.float64))]
        yield pa.record_batch([*ints, *own, _pack_orders(orders[n]), pack(raw[n])], names=["shelf", "a", "b", "salt", "role", "side", "id", "block", "asked", "meetings", "open", "perm", "vector"])


def _read_on(unsettled: DataFrame, index: PermutationIndex, width: int) -> DataFrame:
    """The rows of ``side, id, kth, vector`` as readers of all blocks they ask for and haven't met."""
    shared = unsettled.sparkSession.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: PermutationIndex = shared.value
        for batch in batches:
            side, ids, kth = (batch.column(c).to_numpy() for c in range(3))
            raw = unpack(batch.column(3), width)
            if not len(ids):
                continue
            u = units(raw)
            heads, cosines, orders = ix.orders(u)
            block, draw = ix.block[heads[:, 0]], priorities(ids, 2)
            done = [ix.begins(heads[n : n + 1], cosines[n : n + 1], int(s))[0][0] for n, s in enumerate(side)]
            rows = []
            for n, blocks in ix.asks(u, kth):
                met = np.append(done[n], block[n]) if side[n] == 0 else done[n]
                for s, bits in ix.by_shelf(np.setdiff1d(blocks, met)):
                    rows += [(n, s, c, c, int(draw[n] % ix.salts[s]), _READER, bits) for c in range(int(ix.parts[s]))]
            yield from _placed(np.array(rows, np.int64).reshape(-1, 7), side, ids, block, np.zeros(len(ids)), np.zeros(len(ids)), orders, raw, ix)

    return unsettled.mapInArrow(place, _PLACED)


def _rerank(placed: DataFrame, width: int, k: int, keep: int | None, narrow: bool) -> DataFrame:
    """``side, id, neighbor, similarity``: the k best of each query at each meeting.

    At the beginning also a row without neighbor for each query that may not be settled: the bound ``open`` of files it
    hasn't read, its ``kth`` similarity here, and where that is below the bound its ``vector``. ``narrow``: the
    permutations' numbers have two bytes.
    """

    def meet(table: pa.Table) -> pa.Table:
        role, ids, sides, block, bits, meetings, opening = (table.column(c).to_numpy() for c in ("role", "id", "side", "block", "asked", "meetings", "open"))
        vectors = unpack(table.column("vector"), width)
        bare = table.column("perm").combine_chunks()
        orders = np.frombuffer(_bytes(bare), np.int16 if narrow else np.int32).reshape(len(bare), -1)
        rows = lambda at: (vectors[at], orders[at], ids[at])
        left, right, reader, shelf = (np.flatnonzero(role == r) for r in (_LEFT, _RIGHT, _READER, _SHELF))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # queries, and rows of the table and cosines of what they meet
        if table.column("a")[0] != table.column("b")[0]:
            jobs = [(left, right, False), (right, left, False)]
        else:
            order = left[np.argsort(block[left], kind="stable")]
            jobs = [(x, x, True) for x in np.split(order, np.flatnonzero(np.diff(block[order])) + 1)]
        for q, c, same in jobs:
            row, best, sim = search(rows(q), rows(c), k, keep, same)
            found.append((q, row, c[best], sim))
        held, several = np.concatenate([left, shelf]), []
        for bit in np.unique(bits[held]).tolist():
            at, c = np.flatnonzero(bits[reader] & bit), held[bits[held] == bit]
            row, best, sim = search(rows(reader[at]), rows(c), k, keep, False)
            several.append((at[row], c[best], sim))
        if len(reader) and several:
            row, best, sim = (np.concatenate(x) for x in zip(*several))
            first = _first_of(row, ids[best], sim, k)
            found.append((reader, row[first], best[first], sim[first]))
        out, open_rows = [], []
        for q, row, best, sim in found:
            if not len(q):
                continue
            out.append((sides[q[row]], ids[q[row]], ids[best], sim))
            if meetings[q[0]]:
                full, least = np.bincount(row, minlength=len(q)) >= k, np.full(len(q), np.inf)
                np.minimum.at(least, row, sim)
                kth = np.where(full, least, -2.0)
                told = np.flatnonzero((kth < opening[q]) | (meetings[q] > 1))
                open_rows.append((sides[q[told]], ids[q[told]], opening[q[told]], kth[told], q[told]))
        side, a, b, s = (np.concatenate(x) for x in zip(*out)) if out else [np.empty(0)] * 4
        o_side, o_id, o_open, o_kth, o_at = (np.concatenate(x) for x in zip(*open_rows)) if open_rows else [np.empty(0)] * 5
        n, m = len(a), len(o_id)
        blank, spare = pa.nulls(m), pa.nulls(n)
        carry = pc.if_else(pa.array(o_kth < o_open, pa.bool_()), pack(vectors[o_at.astype(np.int64)]), pa.scalar(None, pa.binary()))
        join = lambda x, y, t: pa.concat_arrays([x.cast(t), y.cast(t)])
        return pa.table(
            [
                pa.array(np.concatenate([side, o_side]).astype(np.int32)),
                pa.array(np.concatenate([a, o_id]).astype(np.int64)),
                join(pa.array(b.astype(np.int64)), blank, pa.int64()),
                join(pa.array(s.astype(np.float64)), blank, pa.float64()),
                join(spare, pa.array(o_open.astype(np.float64)), pa.float64()),
                join(spare, pa.array(o_kth.astype(np.float64)), pa.float64()),
                join(spare, carry, pa.binary()),
            ],
            names=["side", "id", "neighbor", "similarity", "open", "kth", "vector"],
        )

    return placed.groupBy("shelf", "a", "b", "salt").applyInArrow(meet, _NEAR)


def _bytes(column: pa.Array) -> bytes | memoryview:
    """The bytes of binary values one after another."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2])[ends[0] : ends[-1]]


def _copies(vectors: DataFrame, width: int) -> DataFrame:
    """``id, first, n``: vectors of which there are several, the smallest id of their equals and how many they are."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = usable_rows(batch.column(1), width)
            if len(at):
                a, b = digests(raw)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(a), pa.array(b)], names=["id", "h", "g"])

    keyed = vectors.mapInArrow(hashed, "id long, h long, g long")
    classes = keyed.groupBy("h", "g").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return stage(keyed.join(classes, ["h", "g"]).select("id", "first", "n"), "copies")


def permutation_index(corpus: DataFrame, asked: DataFrame | None, width: int, k: int, **settings) -> DataFrame | None:
    """``side, id, neighbor, similarity``: what the index finds for different vectors ``i, v``, k or more rows each."""
    more = asked.count() / max(1, corpus.count()) if asked is not None else 0.0
    index = fit(corpus, width, k, readers=more, **settings)
    if index is None:
        return None
    narrow = len(index.pivots) < 1 << 15
    placed = _place(corpus, index, width, 0, True)
    if asked is not None:
        placed = placed.unionByName(_place(asked, index, width, 1, True))
    found = stage(_rerank(placed, width, k, index.keep, narrow), "near")
    told = found.where("neighbor IS NULL").groupBy("side", "id").agg(F.max("kth").alias("kth"), F.max("open").alias("open"), F.max("vector").alias("vector"))
    unsettled = stage(told.where("kth < open").select("side", "id", "kth", "vector"), "unsettled")
    near = found.where("neighbor IS NOT NULL").select("side", "id", "neighbor", "similarity")
    if more := unsettled.count():
        index.salts = np.full(len(index.parts), -(-more // READERS))
        readers = _read_on(unsettled, index, width).unionByName(_place(corpus, index, width, 0, False))
        near = near.unionByName(_rerank(readers, width, k, index.keep, narrow).select("side", "id", "neighbor", "similarity"))
    return near


def nearest_vectors(corpus: DataFrame, key: str, vector: str, width: int, k: int, queries: DataFrame | None = None, query_key: str = "", query_vector: str = "", exact: bool = False, **settings) -> DataFrame:
    """``side, id, neighbor, similarity, rank``: the k most similar corpus vectors of every corpus and query vector.

    Similarity is the cosine in double precision, rounded to 12 decimals; ties go to the smaller id; a corpus vector isn't
    its own neighbour. Vectors that are null, of another width, all zero or not finite are neither answered nor found.
    Equal vectors are indexed once and share their list, in which all of them are found. With fewer than k others, there
    are fewer rows. Ids must be unique; rows with a null id or other columns are ignored; empty tables give no rows.

    Approximate unless ``exact``, which reads all files and reranks all rows: a query may miss neighbours in files it
    doesn't read and such that are far by footrule. ``settings``: ``sample``, ``separation``, ``block``, ``shelf``,
    ``keep`` and ``deviations`` of the index (see the constants). All rows are posted.
    """
    base = corpus.select(corpus[key].cast("long").alias("i"), corpus[vector].cast("array<float>").alias("v")).where(F.col("i").isNotNull())
    asked = queries.select(queries[query_key].cast("long").alias("i"), queries[query_vector].cast("array<float>").alias("v")).where(F.col("i").isNotNull()) if queries is not None else None
    copies = _copies(base, width)
    single = base.join(copies.where("id != first").select(F.col("id").alias("i")), "i", "left_anti")
    near = permutation_index(single, asked, width, k, **(settings | ({"keep": None, "deviations": None} if exact else {})))
    if near is None:
        return base.sparkSession.createDataFrame([], "side string, id long, neighbor long, similarity double, rank int")
    few = Window.partitionBy("first").orderBy("id")
    listed = copies.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).select("first", F.col("id").alias("member"))
    alike = listed.select(F.lit(0).alias("side"), F.col("first").alias("id"), F.col("member").alias("neighbor"), F.lit(1.0).alias("similarity"))
    whole = near.join(listed.withColumnRenamed("first", "neighbor"), "neighbor", "left").select("side", "id", F.coalesce("member", "neighbor").alias("neighbor"), "similarity")
    one = F.struct((-F.col("similarity")).alias("s"), F.col("neighbor").alias("n"))
    best = whole.unionByName(alike).groupBy("side", "id").agg(F.slice(F.array_sort(F.collect_list(one)), 1, k + 1).alias("best"))
    # A list of k and one goes to all owners of a vector, those of one in slices, before it becomes rows.
    slices = F.ceil(F.col("n") / OWNERS).cast("bigint")
    shares = copies.where("id = first").select(F.lit(0).alias("side"), "id", slices.alias("slices"))
    owners = copies.select(F.lit(0).alias("side"), F.col("first").alias("id"), F.pmod(F.xxhash64("id"), slices).alias("slice"), F.col("id").alias("owner"))
    spread = best.join(shares, ["side", "id"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("slices", F.lit(1).cast("bigint")) - 1)))
    each = spread.join(owners, ["side", "id", "slice"], "left").select("side", F.coalesce("owner", "id").alias("id"), "best")
    ranked = each.select("side", "id", F.posexplode(F.slice(F.filter("best", lambda x: (F.col("side") == 1) | (x["n"] != F.col("id"))), 1, k)).alias("rank", "one"))
    return ranked.select(F.when(F.col("side") == 0, "corpus").otherwise("query").alias("side"), "id", F.col("one.n").alias("neighbor"), (-F.col("one.s")).alias("similarity"), (F.col("rank") + 1).cast("int").alias("rank"))
