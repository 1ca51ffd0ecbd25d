"""A parametric projector: a small perceptron, applied as a map over the rows and fitted in rounds of all edges."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.vector import doubles
from quillmap.operators.sampling import hash_number
from quillmap.session import stage


@dataclass
class Projector:
    """ReLU layers and a linear end; ``residual`` adds a layer's input to its output where the widths are equal."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    residual: bool = False
    a: float = 1.577
    b: float = 0.895

    @classmethod
    def fresh(cls, width: int, hidden: int, layers: int, out: int = 2, seed: int = 0, residual: bool = False) -> Projector:
        rng = np.random.default_rng(seed)
        sizes = [width, *[hidden] * layers, out]
        return cls([rng.normal(size=(p, q)) * np.sqrt(2 / p) for p, q in zip(sizes, sizes[1:])], [np.zeros(q) for q in sizes[1:]], residual)

    def forward(self, x: np.ndarray, keep: bool = False):
        acts = [x]
        for n, (w, b) in enumerate(zip(self.weights, self.biases)):
            y = acts[-1] @ w + b
            if n < len(self.weights) - 1:
                y = np.maximum(y, 0)
                if self.residual and y.shape == acts[-1].shape:
                    y = y + acts[-1]
            acts.append(y)
        return acts if keep else acts[-1]

    def backward(self, acts: list[np.ndarray], grad: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        gw, gb = [None] * len(self.weights), [None] * len(self.weights)
        for n in range(len(self.weights) - 1, -1, -1):
            through = grad
            if n < len(self.weights) - 1:
                skip = self.residual and acts[n + 1].shape == acts[n].shape
                through = grad * ((acts[n + 1] - acts[n] if skip else acts[n + 1]) > 0)
            gw[n], gb[n] = acts[n].T @ through, through.sum(0)
            back = through @ self.weights[n].T
            grad = back + grad if n < len(self.weights) - 1 and self.residual and acts[n + 1].shape == acts[n].shape else back
        return gw, gb

    def save(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"w{n}": w for n, w in enumerate(self.weights)} | {f"b{n}": b for n, b in enumerate(self.biases)}
        np.savez(out, meta=json.dumps({"layers": len(self.weights), "residual": self.residual, "a": self.a, "b": self.b}), **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Projector:
        f = np.load(io.BytesIO(raw), allow_pickle=False)
        meta = json.loads(str(f["meta"]))
        n = range(meta["layers"])
        return cls([f[f"w{k}"] for k in n], [f[f"b{k}"] for k in n], meta["residual"], meta["a"], meta["b"])


def transform(points: DataFrame, model: Projector, key: str = "id", vector: str = "v") -> DataFrame:
    """``id, x, y`` of every row; the weights are sent once to each task, rows are independent."""
    shared = points.sparkSession.sparkContext.broadcast(model)
    kind = points.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        width = m.weights[0].shape[0]
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
            z = m.forward(flat) if len(flat) else np.empty((0, 2))
            yield pa.record_batch([batch.column(0), pa.array(z[:, 0]), pa.array(z[:, 1])], names=["id", "x", "y"])

    return points.select(F.col(key).alias("id"), doubles(vector).alias("v")).dropna().mapInArrow(run, f"id {kind}, x double, y double")


def learning_rate(update: int, total: int, peak: float, warmup: int) -> float:
    """Linear warm-up by (u + 1) / W, then a half cosine to 0."""
    if update < warmup:
        return peak * (update + 1) / warmup
    return peak * 0.5 * (1 + np.cos(np.pi * (update - warmup) / max(1, total - warmup)))


def correlation_loss(a: np.ndarray, b: np.ndarray, eps: float = 1e-8) -> float:
    """Minus the correlation of two sets of distances; 0 if either hardly varies."""
    return _correlation(a, b, eps)[0]


def _correlation(a: np.ndarray, b: np.ndarray, eps: float = 1e-8) -> tuple[float, np.ndarray]:
    """The correlation loss, and its slope in ``b``."""
    x, y = a - a.mean(), b - b.mean()
    xx, yy = (x * x).mean(), (y * y).mean()
    if xx < eps or yy < eps:
        return 0.0, np.zeros_like(b)
    r = (x * y).mean() / np.sqrt(xx * yy)
    return float(-r), -(x / np.sqrt(xx * yy) - r * y / yy) / len(b)


class _Adam:
    """AdamW over a model's weights and biases, in place; only weights decay."""

    def __init__(self, model: Projector, decay: float):
        self.model, self.decay, self.n = model, decay, 0
        self.first = [np.zeros_like(p) for p in model.weights + model.biases]
        self.second = [np.zeros_like(p) for p in self.first]

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        self.n += 1
        for k, (p, g) in enumerate(zip(self.model.weights + self.model.biases, grads)):
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            move = self.first[k] / (1 - 0.9**self.n) / (np.sqrt(self.second[k] / (1 - 0.999**self.n)) + 1e-8)
            p -= rate * (move + (self.decay * p if k < len(self.model.weights) else 0))


@dataclass(frozen=True)
class Terms:
    """Weights of the loss's terms beside cross entropy, and the share of pairs that are edges."""

    correlation: float = 0.1
    hold: float = 0.0
    ratio: float = 0.25
    decay: float = 1e-4


def pair_gradients(model: Projector, u: np.ndarray, v: np.ndarray, target: np.ndarray, terms: Terms) -> tuple[list[np.ndarray], float]:
    """Gradients and loss of a batch of pairs: cross entropy of map similarities, and correlation of distances of both spaces."""
    n = len(u)
    acts = model.forward(np.concatenate([u, v]), keep=True)
    d = acts[-1][:n] - acts[-1][n:]
    r2 = (d * d).sum(1) + 1e-12
    q = np.clip(1 / (1 + model.a * r2**model.b), 1e-4, 1 - 1e-4)
    loss = float(-(target * np.log(q) + (1 - target) * np.log(1 - q)).mean())
    slope = -(target / q - (1 - target) / (1 - q)) * (-(q**2) * model.a * model.b * r2 ** (model.b - 1)) / n
    grad = np.clip(2 * slope[:, None] * d, -1, 1)
    if terms.correlation:
        low = np.sqrt(r2)
        c, by = _correlation(np.sqrt(((u - v) ** 2).sum(1)), low)
        loss += terms.correlation * c
        grad += terms.correlation * (by / low)[:, None] * d
    gw, gb = model.backward(acts, np.concatenate([grad, -grad]))
    return gw + gb, loss


def place_gradients(model: Projector, x: np.ndarray, places: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients and loss of the squared distance of rows' places to given ones."""
    acts = model.forward(x, keep=True)
    off = acts[-1] - places
    gw, gb = model.backward(acts, 2 * off / off.size)
    return gw + gb, float((off**2).mean())


def check_anchors(anchors: DataFrame, points: DataFrame) -> None:
    """Anchors ``id, x, y`` must be there, be of different points of the table, and have finite places; an error otherwise."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    n = anchors.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.sum((bad("x") | bad("y") | F.col("id").isNull()).cast("int")).alias("bad")).first()
    if not n["n"] or n["bad"] or n["ids"] != n["n"]:
        raise ValueError(f"{n['n']} anchors, {n['ids']} ids, {n['bad'] or 0} without a finite place")
    lost = anchors.join(points.select("id"), "id", "left_anti").head(3)
    if lost:
        raise ValueError(f"anchors of no point: {lost}")


def split_anchors(anchors: DataFrame, holdout: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Anchors that are held, and those kept aside to measure their drift; by a hash of id and seed."""
    aside = hash_number(seed + 7, F.col("id")) < holdout * 16.0**13
    return anchors.where(~aside), anchors.where(aside)


def _averaged(rows: DataFrame, model: Projector, local: Callable[[Projector, _Adam, pa.Table], float], decay: float) -> tuple[Projector, float]:
    """One round: every partition trains a copy of the model on its rows; the copies are averaged by their rows.

    The driver gets as many models as there are partitions.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Projector.load(shared.value.save())
        adam, n, total = _Adam(own, decay), 0, 0.0
        for batch in batches:
            if batch.num_rows:
                total += local(own, adam, pa.Table.from_batches([batch])) * batch.num_rows
                n += batch.num_rows
        if n:
            yield pa.record_batch([pa.array([own.save()], pa.binary()), pa.array([n], pa.int64()), pa.array([total], pa.float64())], names=["model", "n", "loss"])

    # The order of arrival must not change a sum.
    found = sorted(rows.mapInArrow(run, "model binary, n long, loss double").collect(), key=lambda r: (r["n"], r["loss"], bytes(r["model"])))
    if not found:
        return model, 0.0
    models, n = [Projector.load(bytes(r["model"])) for r in found], np.array([r["n"] for r in found], float)
    mean = lambda arrays: sum(k * x for k, x in zip(n / n.sum(), arrays))
    merged = Projector([mean(x) for x in zip(*[m.weights for m in models])], [mean(x) for x in zip(*[m.biases for m in models])], model.residual, model.a, model.b)
    return merged, float(sum(r["loss"] for r in found) / n.sum())


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    n = len(column)
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _ordered(df: DataFrame, workers: int, seed: int, *ids: str) -> DataFrame:
    """The rows in ``workers`` partitions and an order that depend on their ids and the seed only, stored."""
    h = hash_number(seed, *[F.col(c) for c in ids])
    return stage(df.withColumn("h", h), "training").repartition(workers, "h").sortWithinPartitions("h", *ids)


def pretrain(points: DataFrame, anchors: DataFrame, model: Projector, epochs: int = 2, rate: float = 1e-3, batch: int = 512, workers: int = 8, decay: float = 1e-4) -> tuple[Projector, list[float]]:
    """The projector trained to put every anchor (``id, x, y``) at its place, by squared distance; a loss for each epoch."""
    check_anchors(anchors, points)
    rows = _ordered(points.select("id", doubles("v").alias("v")).dropna().join(anchors.select("id", "x", "y"), "id"), workers, 3, "id")

    def local(own: Projector, adam: _Adam, t: pa.Table) -> float:
        x, z = _vectors(t.column("v")), np.stack([t.column(c).to_numpy() for c in "xy"], axis=1).astype(float)
        losses = []
        for a in range(0, len(x), batch):
            grads, loss = place_gradients(own, x[a : a + batch], z[a : a + batch])
            adam.step(grads, rate)
            losses.append(loss)
        return float(np.mean(losses))

    losses = []
    for _ in range(epochs):
        model, loss = _averaged(rows, model, local, decay)
        losses.append(loss)
    return model, losses


def fit(points: DataFrame, edges: DataFrame, model: Projector, epochs: int = 5, batch: int = 512, peak: float = 1e-3, terms: Terms = Terms(), anchors: DataFrame | None = None, workers: int = 8, seed: int = 0) -> tuple[Projector, list[float]]:
    """Fits the projector to a graph ``src, dst, weight``; the model and the mean loss of each epoch.

    Every epoch goes over all edges, in ``workers`` partitions that train copies of the model, which are then averaged:
    no edge is left out and the driver holds ``workers`` models at most. An edge is a pair whose target is its weight;
    for each there are ``1 / ratio - 1`` pairs of target 0, of ends of different edges of the batch. Cross entropy of map
    similarities, and by ``terms`` the correlation of distances and the hold of ``anchors`` (``id, x, y``) at their places.
    Edges with an end that is no point, or without a weight, are left out; without edges the model comes back as it was.
    """
    p = points.select("id", doubles("v").alias("v")).dropna()
    a, b = p.select(F.col("id").alias("src"), F.col("v").alias("u")), p.select(F.col("id").alias("dst"), "v")
    pairs = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).dropna().join(a, "src").join(b, "dst")
    none = F.lit(None).cast("double")
    rows = pairs.select("src", "dst", "u", "v", "weight", none.alias("x"), none.alias("y"))
    if anchors is not None and terms.hold:
        check_anchors(anchors, points)
        held = p.join(anchors.select("id", "x", "y"), "id")
        rows = rows.unionByName(held.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("v").alias("u"), "v", none.alias("weight"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    rows = _ordered(rows, workers, seed, "src", "dst")
    others = max(1, round(1 / terms.ratio) - 1)
    losses = []
    for epoch in range(epochs):
        rate = learning_rate(epoch, epochs, peak, max(1, epochs // 10))

        def local(own: Projector, adam: _Adam, t: pa.Table, epoch: int = epoch, rate: float = rate) -> float:
            rng = np.random.default_rng([seed, epoch, t.num_rows])
            u, v, w = _vectors(t.column("u")), _vectors(t.column("v")), t.column("weight").to_numpy().astype(float)
            x, y = (t.column(c).to_numpy().astype(float) for c in "xy")
            order, found = rng.permutation(len(w)), []
            for start in range(0, len(order), batch):
                some = order[start : start + batch]
                edge, anchor = some[np.isfinite(w[some])], some[np.isfinite(x[some])]
                grads, loss = None, 0.0
                if len(edge):
                    i, j = np.tile(edge, others), rng.permutation(np.tile(edge, others))
                    grads, loss = pair_gradients(own, np.concatenate([u[edge], u[i]]), np.concatenate([v[edge], v[j]]), np.concatenate([w[edge], np.zeros(len(i))]), terms)
                if len(anchor):
                    held, off = place_gradients(own, u[anchor], np.stack([x[anchor], y[anchor]], axis=1))
                    held = [terms.hold * g for g in held]
                    grads, loss = held if grads is None else [g + k for g, k in zip(grads, held)], loss + terms.hold * off
                adam.step(grads, rate)
                found.append(loss)
            return float(np.mean(found))

        model, loss = _averaged(rows, model, local, terms.decay)
        losses.append(loss)
    return model, losses
