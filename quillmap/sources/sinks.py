"""Writing results: nothing is overwritten, and a table that is there is complete."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str) -> None:
    """Writes a table to a place that must be free."""
    df.write.mode("errorifexists").parquet(path)


def write_edges(edges: DataFrame, path: str, parts: int = 32) -> None:
    """Edges in (src, dst) order over range parts, so ranges of sources are read from few files."""
    publish(edges.repartitionByRange(parts, "src", "dst").sortWithinPartitions("src", "dst"), path)


def write_coordinates(z: DataFrame, path: str) -> None:
    """``x, y, ls_index`` in single precision."""
    publish(z.select(F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.col("id").cast("bigint").alias("ls_index")), path)


def write_scores(metrics: DataFrame, per_point: DataFrame, folder: str) -> None:
    """One row of metrics as JSON beside the table of per-point scores."""
    publish(per_point, f"{folder}/per_point")
    metrics.coalesce(1).write.mode("errorifexists").json(f"{folder}/metrics")


def column_metadata(df: DataFrame, most: int = 100) -> dict[str, dict]:
    """Type, number of values, extent, and the values where there are at most ``most`` of them, of each plain column."""
    plain = [f for f in df.schema if f.dataType.typeName() in ("string", "integer", "long", "double", "float", "boolean", "short", "byte", "date", "timestamp")]
    if not plain:
        return {}
    parts = []
    for f in plain:
        c = F.col(f"`{f.name}`")
        parts += [F.countDistinct(c).alias(f"n:{f.name}"), F.min(c).cast("string").alias(f"lo:{f.name}"), F.max(c).cast("string").alias(f"hi:{f.name}")]
    row = df.agg(*parts).first()
    out = {}
    for f in plain:
        out[f.name] = {"type": f.dataType.simpleString(), "unique": row[f"n:{f.name}"], "extent": [row[f"lo:{f.name}"], row[f"hi:{f.name}"]]}
        if f.dataType.typeName() == "string" and row[f"n:{f.name}"] <= most:
            out[f.name]["categories"] = [r[0] for r in df.select(f"`{f.name}`").dropna().distinct().orderBy(f"`{f.name}`").limit(most).collect()]
    return out


def write_dataset(df: DataFrame, folder: str, about: dict) -> dict:
    """A table with its column metadata beside it as JSON; returns the metadata."""
    publish(df, f"{folder}/rows")
    meta = about | {"columns": column_metadata(df)}
    df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/meta")
    return meta


def source_identity(transform: Callable) -> str:
    """The hash of a function's source."""
    return hashlib.sha256(inspect.getsource(transform).encode()).hexdigest()


def user_transform(df: DataFrame, transform: Callable[[pd.DataFrame], pd.DataFrame], schema: str, identity: str) -> DataFrame:
    """A plain function of batches applied to all rows, if its source has the stated hash."""
    if source_identity(transform) != identity:
        raise ValueError("the transform isn't the one that was stated")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield transform(batch)

    return df.mapInPandas(run, schema)
