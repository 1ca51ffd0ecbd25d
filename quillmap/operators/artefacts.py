"""Artefacts with an identity: content keys, cached tables, sealed records, merges."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions.vector import cosine, doubles


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def seal(record: dict, field: str = "receipt_sha256") -> dict:
    """The record with the hash of its canonical form."""
    body = {k: v for k, v in record.items() if k != field}
    return body | {field: hashlib.sha256(canonical_json(body).encode()).hexdigest()}


def check_seal(record: dict, field: str = "receipt_sha256") -> None:
    if seal(record, field).get(field) != record.get(field):
        raise ValueError("the record's seal doesn't fit its content")


def flattened(value: object, prefix: str = "") -> dict[str, object]:
    """Dotted paths of a nested configuration's leaves."""
    if isinstance(value, dict) and value:
        return {k: v for name, x in value.items() for k, v in flattened(x, f"{prefix}.{name}" if prefix else str(name)).items()}
    return {prefix: value}


def config_difference(a: dict, b: dict) -> dict[str, tuple[object, object]]:
    """Leaves in which two configurations differ."""
    x, y = flattened(a), flattened(b)
    return {k: (x.get(k), y.get(k)) for k in sorted(x.keys() | y.keys()) if x.get(k) != y.get(k) or (k in x) != (k in y)}


def table_key(df: DataFrame, settings: dict) -> str:
    """A key of a table's content, whatever its order and partitioning, and of settings.

    Two 64-bit row hashes are summed (with the count), so one small row comes back; for finding a cache, not a proof.
    """
    a, b = F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)
    s = df.agg(F.count("*").alias("n"), F.sum(a.cast("decimal(38,0)")).alias("a"), F.sum(b.cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(canonical_json([s["n"], str(s["a"]), str(s["b"]), df.schema.simpleString(), settings]).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table under a key, built and written if it isn't there. A write that fails leaves no finished table."""
    path = f"{folder}/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def file_identity(spark: SparkSession, path: str) -> DataFrame:
    """``name, size, sha256`` of a file or of all files below a folder. Each is hashed by one task, a megabyte at a time.

    Names are relative to the path. Links and hidden files are none of a folder's files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            hashes = []
            for at in batch.column(0).to_pylist():
                system, inner = fs.FileSystem.from_uri(re.sub(r"^(\w+):/(?!/)", r"\1:///", at))
                h = hashlib.sha256()
                with system.open_input_stream(inner, compression=None) as f:
                    while piece := f.read(1 << 20):
                        h.update(piece)
                hashes.append(h.hexdigest())
            yield pa.record_batch([*batch.columns, pa.array(hashes, pa.string())], names=["path", "size", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"))
    found = files.mapInArrow(run, "path string, size long, sha256 string")
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return found.select(F.concat(F.lit(base), F.element_at(F.split("path", re.escape(base)), -1)).alias("name"), "size", "sha256")


def identity_tree(df: DataFrame, key: str, content: Column, width: int = 4096) -> str:
    """The root of a hash tree over rows in the order of a whole-number key: each level hashes ranges of ``width`` keys.

    No task holds more than ``width`` hashes. The tree depends on the keys and contents only.
    """
    level = df.select(F.col(key).cast("bigint").alias("k"), F.sha2(content, 256).alias("h"))
    while True:
        level = level.groupBy(F.floor(F.col("k") / width).alias("k")).agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: F.concat(x["k"].cast("string"), x["h"]))), 256).alias("h"))
        top = level.head(2)
        if len(top) < 2:
            return top[0]["h"] if top else hashlib.sha256(b"").hexdigest()


def merge_columns(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join of another table's columns; names that are taken get the lowest free number."""
    taken, names = set(base.columns), {}
    for c in other.columns:
        if c != key:
            name, n = c, 2
            while name in taken:
                name, n = f"{c}_{n}", n + 1
            names[c] = name
            taken.add(name)
    return base.join(other.withColumnsRenamed(names), key, "left")


def edge_cosines(edges: DataFrame, points: DataFrame) -> DataFrame:
    """``src, dst, dist``: cosine distances of the edges' ends, by two joins on ids."""
    p = points.select("id", doubles("v").alias("v"))
    a, b = p.select(F.col("id").alias("src"), F.col("v").alias("a")), p.select(F.col("id").alias("dst"), F.col("v").alias("b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.lit(1.0) - cosine(F.col("a"), F.col("b"))).alias("dist"))


def block_rows(width: int, budget_mb: float, strip: int = 512) -> int:
    """How many rows a block of vectors may have: two blocks in double precision and a strip of distances fit the budget."""
    return max(1, int(budget_mb * 2**20 / (2 * 8 * width + 8 * strip)))


def one_factor(a: dict, b: dict, factor: str) -> None:
    """Two configurations may differ in one leaf only."""
    found = sorted(config_difference(a, b))
    if found != [factor]:
        raise ValueError(f"the arms differ in {found}, not just in {factor}")


def load_structured(text: str) -> object:
    """A JSON document, or YAML where a parser is installed."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("not JSON, and no YAML parser is installed") from None
        return yaml.safe_load(text)


def expand_sweep(base: dict, sweep: dict[str, list]) -> list[dict]:
    """All configurations of a grid of dotted paths, the last path varying fastest."""
    from copy import deepcopy
    from itertools import product

    out = []
    for values in product(*sweep.values()):
        config = deepcopy(base)
        for path, value in zip(sweep, values):
            at = config
            *inner, leaf = path.split(".")
            for name in inner:
                at = at.setdefault(name, {})
            at[leaf] = value
        out.append(config)
    return out
