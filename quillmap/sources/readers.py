"""Tables by the kind their path tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.sources import generators, shards


def read_table(spark: SparkSession, path: str, schema: str | None = None, dim: int | None = None) -> DataFrame:
    """Parquet, ORC, JSON lines, CSV, matrix shards, Lance (where its connector is installed), or ``synthetic:n:width``."""
    name = path.rstrip("/").lower()
    if name.startswith("synthetic:"):
        _, n, width = name.split(":")
        return generators.clustered(spark, int(n), int(width), 10, 42)
    reader = spark.read.schema(schema) if schema else spark.read
    if name.endswith((".jsonl", ".ndjson", ".json")):
        return reader.json(path)
    if name.endswith((".csv", ".tsv")):
        return reader.option("header", True).option("sep", "\t" if name.endswith(".tsv") else ",").csv(path)
    if name.endswith(".orc"):
        return reader.orc(path)
    if name.endswith((".npy", ".f32", ".npy/", "/shards")):
        return shards.read_shards(shards.list_shards(spark, path), dim)
    if name.endswith(".lance"):
        return spark.read.format("lance").load(path)
    if name.endswith((".h5", ".hdf5")):
        raise ValueError(f"{path}: HDF5 isn't read here; convert it to Parquet or matrix shards first")
    return reader.parquet(path)


def canonical_coordinates(df: DataFrame) -> DataFrame:
    """``id, x, y`` of a coordinate table in any case of names, with the id as ``ls_index``, ``row_id`` or both alike."""
    names = {c.lower(): c for c in df.columns}
    ids = [names[n] for n in ("id", "ls_index", "row_id") if n in names]
    if not ids or "x" not in names or "y" not in names:
        raise ValueError(f"no coordinates among {df.columns}")
    one = F.col(ids[0])
    for other in ids[1:]:
        one = F.when(F.col(other).eqNullSafe(F.col(ids[0])), one).otherwise(F.raise_error(F.lit(f"{ids[0]} and {other} disagree")))
    return df.select(one.cast("bigint").alias("id"), F.col(names["x"]).cast("double").alias("x"), F.col(names["y"]).cast("double").alias("y"))
