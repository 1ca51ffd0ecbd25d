"""Receipts of inputs and results: conventions, type contracts, input packs, run manifests, comparisons with earlier panels."""

from __future__ import annotations

import platform
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.operators.artefacts import check_seal, file_identity, seal

# The fields of a query convention in its older form, those added since, and what they may hold.
_OLD_FIELDS = ("model_id", "model_revision", "prompt_bytes_hex", "pooling", "normalization", "dimensions", "dtype")
_NEW_FIELDS = ("prompt_policy", "source_dtype", "storage_dtype", "dtype_conversion")
_FLOATS = ("float16", "float32", "float64")
_POOLINGS = ("lasttoken", "mean", "cls")
_NORMALIZATIONS = ("l2", "none")


def convention(value: dict) -> dict:
    """A query convention in its present form; an error names all that is wrong with it.

    The older form lacks the policy of prompts and the types of source and store, which follow from its other fields.
    """
    fields = set(value)
    if fields not in (set(_OLD_FIELDS), {*_OLD_FIELDS, *_NEW_FIELDS}):
        raise ValueError(f"fields of a convention: {sorted(fields)}")
    prompt = value["prompt_bytes_hex"]
    policy = "literal_prefix" if prompt else "raw_unprompted"
    whole = {"prompt_policy": policy, "source_dtype": value["dtype"], "storage_dtype": value["dtype"], "dtype_conversion": "identity_v1"} | value
    revision = str(whole["model_revision"])
    rules = {
        "model_id": bool(whole["model_id"]) and str(whole["model_id"]).lower() not in ("model", "placeholder", "unknown"),
        "model_revision": bool(re.fullmatch("[0-9a-f]{40}", revision)) and len(set(revision)) > 1,
        "prompt_bytes_hex": bool(re.fullmatch("([0-9a-f]{2})*", str(prompt))),
        "prompt_policy": whole["prompt_policy"] == policy,
        "pooling": whole["pooling"] in _POOLINGS,
        "normalization": whole["normalization"] in _NORMALIZATIONS,
        "dimensions": type(whole["dimensions"]) is int and whole["dimensions"] > 0,
        "storage_dtype": whole["storage_dtype"] in _FLOATS and whole["storage_dtype"] == whole["dtype"],
        "source_dtype": whole["source_dtype"] in _FLOATS,
        "dtype_conversion": (whole["dtype_conversion"] == "identity_v1") == (whole["source_dtype"] == whole["storage_dtype"]),
    }
    if wrong := [k for k, sound in rules.items() if not sound]:
        raise ValueError(f"unsound in a convention: {', '.join(wrong)}")
    return whole


def type_receipt(df: DataFrame, declared: dict[str, str]) -> dict:
    """The declared and found types of columns, sealed; columns of another type or missing ones are an error."""
    found = {c: df.schema[c].dataType.simpleString() if c in df.columns else "missing" for c in declared}
    if wrong := {c: (declared[c], found[c]) for c in declared if found[c] != declared[c]}:
        raise ValueError(f"types (declared, found): {wrong}")
    return seal({"declared": declared, "found": found})


def assemble_pack(spark: SparkSession, paths: dict[str, str]) -> dict:
    """The sealed list of a pack's tables: name, path, rows, schema, and size and hash of each of their files."""
    members = {}
    for name, path in sorted(paths.items()):
        df = spark.read.parquet(path)
        files = {r["name"]: [r["size"], r["sha256"]] for r in file_identity(spark, path).collect()}
        members[name] = {"path": path, "rows": df.count(), "schema": df.schema.simpleString(), "files": files}
    return seal({"members": members})


def reopen_pack(spark: SparkSession, pack: dict) -> dict[str, DataFrame]:
    """The tables of a pack, after its seal and every file have been checked again; what differs is an error."""
    check_seal(pack)
    again = assemble_pack(spark, {k: m["path"] for k, m in pack["members"].items()})
    if wrong := [k for k, m in pack["members"].items() if again["members"][k] != m]:
        raise ValueError(f"members that differ from the pack's: {', '.join(wrong)}")
    return {k: spark.read.parquet(m["path"]) for k, m in pack["members"].items()}


def run_manifest(spark: SparkSession, settings: dict, tables: dict[str, DataFrame]) -> dict:
    """What a run was made of, sealed: its settings, the tables' rows and schemas, and the versions that ran it."""
    read = {k: {"rows": df.count(), "schema": df.schema.simpleString()} for k, df in sorted(tables.items())}
    return seal({"settings": settings, "tables": read, "spark": spark.version, "python": platform.python_version()})


def against_prior(now: DataFrame, prior: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value, prior_value, delta`` of a panel and an earlier one; null where the earlier one has no such row or value."""
    old = prior.select(key, F.col(value).alias(f"prior_{value}"))
    return now.select(key, value).join(old, key, "left").withColumn("delta", F.col(value) - F.col(f"prior_{value}"))


def result_files(spark: SparkSession, pattern: str) -> DataFrame:
    """The JSON results that a path pattern finds, one row each with its ``file``; files that aren't JSON objects are left out."""
    text = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("result"))
    return text.where(F.schema_of_variant("result").startswith("OBJECT"))
