"""Exact-duplicate families of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fingerprints(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """``id, h``: 128 bits of the SHA-256 of each row's content; rows of nulls only have none."""
    content = columns[0] if len(columns) == 1 and df.schema[columns[0]].dataType.simpleString() == "string" else None
    text = F.col(content) if content else F.to_json(F.struct(*columns))
    return df.select(F.col(key).alias("id"), F.substring(F.sha2(text, 256), 1, 32).alias("h")).where(F.col("h").isNotNull())


def families(prints: DataFrame) -> DataFrame:
    """``h, first, n``: content that occurs more than once, with its smallest id and number of copies."""
    return prints.groupBy("h").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")


def family_summary(fams: DataFrame, rows: int) -> DataFrame:
    """One row: families, members, copies beyond the first, their share of all rows, and the largest family."""
    f = fams.agg(F.count("*").alias("families"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("copies"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    return f.withColumn("share", F.round(F.col("copies") / F.lit(float(max(rows, 1))), 6))


def family_histogram(fams: DataFrame) -> DataFrame:
    return fams.groupBy(F.col("n").alias("size")).agg(F.count("*").alias("families"))


def cap_one(prints: DataFrame) -> DataFrame:
    """``id, first, kept``: every member of a family; the smallest id is kept, the others are left out.

    Families are joined back by hash with their summary, so a family of any size is never gathered.
    """
    return prints.join(families(prints), "h").select("id", "first", (F.col("id") == F.col("first")).alias("kept"))


def cap_report(capped: DataFrame) -> DataFrame:
    """One row of what a sound cap has as 0: families without one kept row, kept rows left out too, and the counts' gap."""
    per = capped.groupBy("first").agg(F.sum(F.col("kept").cast("bigint")).alias("kept"), F.count("*").alias("n"))
    return per.agg(F.sum((F.col("kept") != 1).cast("bigint")).alias("wrong_families"), F.sum("n").alias("members"), F.sum(F.col("n") - F.col("kept")).alias("excluded"), (F.sum(F.col("n") - 1) - F.sum(F.col("n") - F.col("kept"))).alias("gap"))


def top_families(fams: DataFrame, n: int) -> DataFrame:
    return fams.orderBy(F.desc("n"), "first").limit(n)


def without_excluded(edges: DataFrame, capped: DataFrame) -> DataFrame:
    """Edges whose source isn't left out."""
    return edges.join(capped.where(~F.col("kept")).select(F.col("id").alias("src")), "src", "left_anti")


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The newest row of each group."""
    w = Window.partitionBy(*by).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
