"""Checks of ids, alignment and cohorts, as tables of what is wrong; ``require`` turns findings into errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, what: str) -> None:
    """Raises if a table of findings isn't empty."""
    first = df.head(3)
    if first:
        raise ValueError(f"{what}: {first}")


def whole_number(c: Column) -> Column:
    """A number as bigint; fractions and values that aren't finite are an error of the query."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (c != F.floor(c))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a whole number: "), F.coalesce(c.cast("string"), F.lit("null"))))).otherwise(c.cast("bigint"))


def id_report(df: DataFrame, universe: int | None = None, key: str = "id") -> DataFrame:
    """One row of counts: rows, distinct ids, repeats, negatives, and ids beyond the universe."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    beyond = F.sum(F.when(F.col(key) >= universe, F.col("n")).otherwise(0)) if universe is not None else F.lit(0).cast("bigint")
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("ids"), F.sum(F.col("n") - 1).alias("repeats"), F.sum(F.when(F.col(key) < 0, F.col("n")).otherwise(0)).alias("negative"), beyond.alias("beyond"))


def unaligned(x: DataFrame, z: DataFrame, key: str = "id") -> DataFrame:
    """``id, side``: ids that only one of two tables has; aligned tables have none."""
    a = x.select(key).join(z.select(key), key, "left_anti").withColumn("side", F.lit("x"))
    return a.unionByName(z.select(key).join(x.select(key), key, "left_anti").withColumn("side", F.lit("z")))


def align(x: DataFrame, z: DataFrame, key: str = "id") -> DataFrame:
    """The rows of two tables of one universe side by side; any id without a partner is an error."""
    require(unaligned(x, z, key), "ids without a partner")
    return x.join(z, key)


def cohort_findings(cohorts: DataFrame, universe: DataFrame) -> DataFrame:
    """``id, finding``: ids in several cohorts (shared), in none (missing), or in a cohort only (foreign)."""
    per = cohorts.groupBy("id").agg(F.countDistinct("cohort").alias("n"))
    met = per.join(universe.select("id").distinct().withColumn("u", F.lit(True)), "id", "full_outer")
    finding = F.when(F.col("u").isNull(), "foreign").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "shared")
    return met.select("id", finding.alias("finding")).where("finding IS NOT NULL")


def scattered(rows: DataFrame, n: int, key: str = "id") -> DataFrame:
    """Rows placed at their ids among 0 ... n - 1; a place without a row is an error."""
    all_ids = rows.sparkSession.range(n).select(F.col("id").alias(key))
    require(all_ids.join(rows.select(key), key, "left_anti"), "places without a row")
    return all_ids.join(rows, key)


def order_breaks(df: DataFrame, *order: str) -> DataFrame:
    """Repeated keys of a table that is to be strictly ordered by them."""
    return df.groupBy(*order).agg(F.count("*").alias("n")).where("n > 1")


def against_manifest(df: DataFrame, manifest: dict, identity: Callable[[DataFrame], str]) -> str:
    """Whether a table is the one a manifest (``rows``, ``identity``) was made of: ``ok``, or what differs first."""
    if df.count() != manifest["rows"]:
        return "length"
    return "ok" if identity(df) == manifest["identity"] else "content"


def sound_weights(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """The edges, if all weights are finite, none is negative and one is positive; an error otherwise."""
    w = F.col(weight)
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")) | (w < 0)
    n = edges.agg(F.sum(bad.cast("int")).alias("bad"), F.sum((w > 0).cast("int")).alias("positive")).first()
    if n["bad"] or not n["positive"]:
        raise ValueError(f"{n['bad']} weights are missing, negative or not finite; {n['positive'] or 0} are positive")
    return edges
