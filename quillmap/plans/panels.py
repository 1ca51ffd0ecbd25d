"""Panel files whose fields drift: the report of changes and the consistent table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.operators import drift
from quillmap.session import load, stage


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return drift.changes(load(spark, root, "panel_lines"))


def p3_scripts(spark: SparkSession, root: str) -> DataFrame:
    """Cost and steps of the cheapest edit script between the schema trees of each file and the one before it."""
    scripts = drift.edit_scripts(load(spark, root, "panel_lines"))
    step = F.col("cost") > 0
    return scripts.groupBy("stream", F.col("later.file_name").alias("file_name")).agg(F.sum("cost").alias("distance"), F.sum(step.cast("bigint")).alias("steps"))


def p3_table(spark: SparkSession, root: str) -> DataFrame:
    """All lines as one table: a row for each member under its last name, with its value as text, as a number and as a truth value."""
    lines = load(spark, root, "panel_lines")
    named = drift.consistent(drift.member_rows(lines, ["line_id", *drift.FILE]), stage(drift.edit_scripts(lines), "scripts"))
    typed = {"number": "double", "boolean": "boolean"}
    values = [F.expr(f"CASE WHEN kind = '{k}' THEN try_cast(value AS {t}) END").alias(f"as_{k}") for k, t in typed.items()]
    return named.where(F.col("kind") != "object").select("line_id", "stream", "file_name", F.col("run").alias("run_dir"), "name", "kind", "value", *values)
