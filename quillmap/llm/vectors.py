"""Dense vectors in Arrow batches: which are usable, unit lengths, hashes, and exact top-k of a block."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Rows of a block that are multiplied at once.
TILE = 1024


def usable_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and float32 matrix of the usable vectors: not null, of this width, all finite, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    at = np.flatnonzero(lengths == width)
    if not len(at):
        return at, np.empty((0, width), np.float32)
    starts = np.asarray(column.offsets.to_numpy(zero_copy_only=False), np.int64)[at]
    flat = column.values.to_numpy(zero_copy_only=False)
    matrix = np.asarray(flat, np.float32)[starts[:, None] + np.arange(width)]
    good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
    return at[good], matrix[good]


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one, in float32."""
    wide = matrix.astype(np.float64)
    return (wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]).astype(np.float32)


def lengths(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", wide, wide))


def pack(matrix: np.ndarray) -> pa.Array:
    """Rows as binary values."""
    raw = np.ascontiguousarray(matrix, np.float32)
    ends = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw.tobytes())])


def unpack(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The matrix of a binary column made by ``pack``."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = []
    for c in chunks:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(-1, width))
    return np.concatenate(parts) if parts else np.empty((0, width), np.float32)


def digests(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the rows, as two columns; equal rows have equal hashes (0 and -0 are one value)."""
    raw = np.ascontiguousarray(matrix + np.float32(0))
    both = np.frombuffer(b"".join(hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in raw), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def priorities(ids: np.ndarray, salt: int = 0) -> np.ndarray:
    """A random order of ids that is the same everywhere, as non-negative int64."""
    # Increment and multipliers of splitmix64's finaliser, which is public.
    x = ids.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest scores of each row, unordered, by way of the maxima of column groups."""
    rows, n = scores.shape
    if n <= 4 * k or n < 64:
        return np.argpartition(-scores, min(k, n) - 1, axis=1)[:, :k] if n > k else np.broadcast_to(np.arange(n), (rows, n))
    groups = n // 16
    tops = scores[:, : groups * 16].reshape(rows, 16, groups).max(axis=1)
    take = min(k, groups)
    g = np.argpartition(-tops, take - 1, axis=1)[:, :take]
    columns = (g[:, :, None] + groups * np.arange(16)).reshape(rows, -1)
    if n > groups * 16:
        columns = np.concatenate([columns, np.broadcast_to(np.arange(groups * 16, n), (rows, n - groups * 16))], axis=1)
    inner = np.argpartition(-np.take_along_axis(scores, columns, axis=1), k - 1, axis=1)[:, :k]
    return np.take_along_axis(columns, inner, axis=1)


def _chosen_cosines(q: np.ndarray, c: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Cosines of the chosen pairs of unit rows, -3 for others."""
    if chosen.mean() * 16 > 1:  # one product of matrices is faster than that many of rows
        return np.where(chosen, q @ c.T, np.float32(-3))
    scores = np.full(chosen.shape, -3, np.float32)
    x, y = np.nonzero(chosen)
    for a in range(0, len(x), 65_536):
        i, j = x[a : a + 65_536], y[a : a + 65_536]
        scores[i, j] = np.einsum("ij,ij->i", q[i], c[j])
    return scores


def top_cosines(queries: np.ndarray, query_ids: np.ndarray | None, corpus: np.ndarray, corpus_ids: np.ndarray, k: int, slack: int = 8, band: float = 4e-6, choose: Callable[[int, int], np.ndarray] | None = None, tile: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, corpus row, cosine`` of each query's k most similar rows of a block, itself (by id) left out.

    Raw vectors in, cosines in double precision rounded to 12 decimals; ties go to the smaller id. A single-precision pass
    takes k and some more; where its last one is within rounding of the k-th, all rows in that band are computed exactly.
    Without ``query_ids`` nothing is left out. ``choose`` says of a range of queries which rows count for each of them, a
    matrix of booleans; where they are few, only their cosines are computed.
    """
    cu, cl, cw = units(corpus), lengths(corpus), corpus.astype(np.float64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(corpus_ids)
    if not len(corpus):
        queries = queries[:0]
    for a in range(0, len(queries), tile):
        q = queries[a : a + tile]
        chosen = choose(a, a + len(q)) if choose else None
        scores = units(q) @ cu.T if chosen is None else _chosen_cosines(units(q), cu, chosen)
        if query_ids is not None:
            qid = query_ids[a : a + tile]
            own = np.minimum(np.searchsorted(corpus_ids, qid, sorter=order), len(order) - 1)
            same = corpus_ids[order[own]] == qid
            scores[np.flatnonzero(same), order[own[same]]] = -3
        take = min(k + slack, len(corpus))
        picked = best_columns(scores, take)
        rough = np.take_along_axis(scores, picked, axis=1)
        ql, qw = lengths(q), q.astype(np.float64)
        if take < len(corpus):
            kth = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
            unsure = np.flatnonzero((rough.min(axis=1) > kth - band) & (kth > -2))
        else:
            unsure = np.empty(0, np.int64)
        exact = np.einsum("ijk,ik->ij", cw[picked], qw) / (ql[:, None] * cl[picked])
        exact = np.where(rough < -2, -np.inf, np.round(exact, 12))
        ids = corpus_ids[picked]
        rank = np.lexsort((ids, -exact), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(q)), rank.shape[1])
        best, sims = np.take_along_axis(picked, rank, axis=1).ravel(), np.take_along_axis(exact, rank, axis=1).ravel()
        keep = np.isfinite(sims)
        if len(unsure):
            keep &= ~np.isin(rows, unsure)
        out.append((a + rows[keep], best[keep], sims[keep]))
        for r in unsure:
            many = np.flatnonzero(scores[r] > kth[r] - band)
            sim = np.round(cw[many] @ qw[r] / (ql[r] * cl[many]), 12)
            first = np.lexsort((corpus_ids[many], -sim))[:k]
            out.append((np.full(len(first), a + r), many[first], sim[first]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def greedy_pivots(rows: np.ndarray, similarity: float, most: int | None = None, known: np.ndarray | None = None, block: int = 256) -> np.ndarray:
    """Numbers of the rows, in order, that are less similar than ``similarity`` to every pivot before them.

    Unit rows in, as if taken one by one; ``known``: pivots that are there already.
    """
    chosen: list[int] = []
    held = known if known is not None and len(known) else np.empty((0, rows.shape[1]), np.float32)
    store = np.empty((max(1024, 2 * len(held)), rows.shape[1]), np.float32)
    store[: len(held)] = held
    n = len(held)
    for a in range(0, len(rows), block):
        part = rows[a : a + block]
        free = np.ones(len(part), bool) if n == 0 else ((part @ store[:n].T) < similarity).all(axis=1)
        at = np.flatnonzero(free)
        inner = part[at] @ part[at].T >= similarity
        taken: list[int] = []
        for x in range(len(at)):
            if not inner[x, taken].any():
                taken.append(x)
        if n + len(taken) > len(store):
            store = np.concatenate([store, np.empty((max(len(store), len(taken)), rows.shape[1]), np.float32)])
        store[n : n + len(taken)] = part[at[taken]]
        n += len(taken)
        chosen += (a + at[taken]).tolist()
        if most is not None and len(chosen) >= most:
            return np.array(chosen[:most], np.int64)
    return np.array(chosen, np.int64)
