"""Joins of tables in which few keys hold a large share of the rows of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of rows of one key that a task joins, about.
PAIRS = 1_000_000


def split_join(left: DataFrame, right: DataFrame, on: list[str], pairs: int | None = None) -> DataFrame:
    """The inner join of two tables on equal, non-null keys, with keys of more than ``pairs`` pairs (PAIRS) split.

    The rows of a heavy key are divided among slices on the left and repeated for each slice on the right, so that no task
    joins many more pairs than that; put the side with more rows of a key on the left. No row is dropped. Both tables are
    read twice: give tables that are stored. Columns other than the keys must differ in name.
    """
    pairs = pairs or PAIRS
    count = lambda df, name: df.dropna(subset=on).groupBy(*on).agg(F.count("*").alias(name))
    both = count(left, "_l").join(count(right, "_r"), on).where(F.col("_l") * F.col("_r") > pairs)
    slices = F.least(F.col("_l"), F.ceil(F.col("_l") * F.col("_r") / pairs)).cast("bigint")
    heavy = both.select(*on, slices.alias("_slices"))
    if heavy.isEmpty():
        return left.join(right, on)
    one = F.lit(1).cast("bigint")
    own = [c for c in left.columns if c not in on]
    mine = left.join(heavy, on, "left").withColumn("_slice", F.pmod(F.xxhash64(*[left[c] for c in own]) if own else F.rand(0).cast("bigint"), F.coalesce("_slices", one))).drop("_slices")
    each = right.join(heavy, on, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_slices", one) - one))).drop("_slices")
    return mine.join(each, [*on, "_slice"]).drop("_slice")
