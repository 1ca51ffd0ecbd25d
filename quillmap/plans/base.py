"""Registration of queries, and the tables and SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.operators import knn
from quillmap.session import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Searches ask for every row whose id this divides.
ASK = 50
K = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the same as SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def points(spark: SparkSession, root: str) -> DataFrame:
    """``id, v, label`` of the embeddings."""
    return load(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def flat_map(spark: SparkSession, root: str) -> DataFrame:
    """``id, x, y, label``: the map made of the first two components."""
    e = load(spark, root, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def asked(df: DataFrame) -> DataFrame:
    return df.where(F.col("id") % ASK == 0)


def space_knn(spark: SparkSession, root: str, k: int = K, anchors: bool = True, metric: str = "l2") -> DataFrame:
    p = points(spark, root)
    return knn.exact_knn(asked(p) if anchors else p, p, k, metric)


def map_knn(spark: SparkSession, root: str, k: int = K, anchors: bool = True) -> DataFrame:
    z = flat_map(spark, root).select("id", F.array("x", "y").alias("v"))
    return knn.exact_knn(asked(z) if anchors else z, z, k)


E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
Z = "z AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS v, label FROM embeddings)"
DISTANCE = {"l2": "list_distance({a}, {b})", "cosine": "1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))", "ip": "-list_dot_product({a}, {b})"}


def knn_sql(name: str, frame: str, k: int | None = K, anchors: bool = True, metric: str = "l2", a: str = "a.v", b: str = "b.v") -> str:
    """A common table of neighbours ``src, dst, dist, rank``."""
    d = DISTANCE[metric].format(a=a, b=b)
    only = f" AND a.id % {ASK} = 0" if anchors else ""
    cut = f" WHERE rank <= {k}" if k else ""
    return f"{name} AS (SELECT * FROM (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (SELECT a.id AS src, b.id AS dst, {d} AS dist FROM {frame} a JOIN {frame} b ON a.id <> b.id{only})){cut})"


def r6(column: str) -> F.Column:
    return F.round(column, 6).alias(column)
