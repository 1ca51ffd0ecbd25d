"""Synthetic vectors for tests and benchmarks; any partition makes its rows from their ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def clustered(spark: SparkSession, n: int, width: int, clusters: int, seed: int, spread: float = 0.3) -> DataFrame:
    """``id, v, label``: unit vectors around random directions."""
    centres = np.random.default_rng(seed).normal(size=(clusters, width))
    centres /= np.linalg.norm(centres, axis=1)[:, None]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            noise = np.stack([np.random.default_rng((seed, int(i))).normal(size=width) for i in ids]) if len(ids) else np.empty((0, width))
            v = centres[ids % clusters] + noise * spread / np.sqrt(width)
            v /= np.linalg.norm(v, axis=1)[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), pa.array(v.astype(np.float32).ravel()))
            yield pa.record_batch([pa.array(ids), flat, pa.array((ids % clusters).astype(np.int32))], names=["id", "v", "label"])

    return spark.range(n).mapInArrow(make, "id long, v array<float>, label int")


def swiss_roll(spark: SparkSession, n: int, turns: float = 1.5) -> DataFrame:
    """``id, v, t``: a rolled sheet in three dimensions, evenly filled by two irrational steps."""
    a = (F.col("id") * 0.7548776662466927) % 1.0
    b = (F.col("id") * 0.5698402909980532) % 1.0
    t = (a + 0.5) * turns * 2 * 3.141592653589793
    return spark.range(n).select("id", F.array(t * F.cos(t), b * 20, t * F.sin(t)).alias("v"), t.alias("t"))


def random_edges(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    """``src, dst``: k targets of each node by hash, never itself."""
    from quillmap.operators.sampling import hash_number

    e = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("t"))
    return e.select("src", ((F.col("src") + 1 + hash_number(seed, F.col("src"), F.col("t")) % (n - 1)) % n).alias("dst"))
