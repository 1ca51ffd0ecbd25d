"""Matrix shards: NumPy files and headerless float32 files, read in ranges by many tasks, and written from tables.

Paths may be local or anything ``pyarrow.fs`` resolves. Rows get global ids in the order of the sorted (or given) shards.
"""

from __future__ import annotations

import ast
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"\x93NUMPY"
#: Bytes that one task reads of a shard.
RANGE = 64 << 20


def _open(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs.open_input_file(inner)


def shard_header(path: str, dim: int | None = None) -> tuple[int, int, int, str]:
    """``rows, width, data start, dtype`` of a shard; headerless ones need ``dim`` and a length that fits it."""
    with _open(path) as f:
        size = f.size()
        head = f.read_at(min(size, 10), 0)
        if head[:6] != MAGIC:
            if not dim:
                raise ValueError(f"{path}: a headerless shard needs a dimension")
            if size % (4 * dim):
                raise ValueError(f"{path}: {size} bytes are no whole number of rows of {dim}")
            return size // (4 * dim), dim, 0, "<f4"
        start = 10 if head[6] == 1 else 12
        length = int.from_bytes(f.read_at(2 if start == 10 else 4, 8), "little")
        meta = ast.literal_eval(f.read_at(length, start).decode("latin-1").strip())
    if meta["fortran_order"]:
        raise ValueError(f"{path}: column order isn't supported")
    shape = meta["shape"]
    if len(shape) != 2:
        return 0, 0, start + length, meta["descr"]
    return shape[0], shape[1], start + length, meta["descr"]


def list_shards(spark: SparkSession, *places: str) -> DataFrame:
    """``path, length, place, pos``: files of folders or globs, sorted in each place, places in the given order."""
    parts = None
    for n, p in enumerate(places):
        files = spark.read.format("binaryFile").load(p).select("path", "length", F.lit(n).alias("place"))
        parts = files if parts is None else parts.unionByName(files)
    return parts.withColumn("pos", F.row_number().over(Window.orderBy("place", "path")) - 1)


def discovered(files: DataFrame) -> DataFrame:
    """Files named ``...-i-of-n``: ``path, i, n``; raises if numbers are missing, repeated or disagree on n."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    found = files.select("path", F.regexp_extract(name, r"-(\d+)-of-(\d+)", 1).alias("a"), F.regexp_extract(name, r"-(\d+)-of-(\d+)", 2).alias("b")).where("a != ''")
    found = found.select("path", F.col("a").cast("int").alias("i"), F.col("b").cast("int").alias("n"))
    s = found.agg(F.count("*").alias("c"), F.countDistinct("i").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("i").alias("first"), F.max("i").alias("last")).first()
    if s["c"] and not (s["c"] == s["d"] == s["lo"] == s["hi"] and s["last"] - s["first"] == s["c"] - 1):
        raise ValueError(f"shards are incomplete: {s.asDict()}")
    return found


def read_shards(files: DataFrame, dim: int | None = None, cap: int | None = None) -> DataFrame:
    """``id, place, shard, pos, v`` of all rows of 2-D shards of the dimension; others are skipped.

    ``cap``: at most so many first rows of each place (a corpus). Shards are read in ranges, so a task's memory doesn't
    grow with a shard's size. Half-precision values become float32.
    """

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shard_header(p.as_py(), dim) for p in batch.column(0)]
            cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.record_batch([*batch.columns, *cols], names=["path", "place", "shard", "rows", "width", "start", "kind"])

    shards = files.select("path", "place", F.col("pos").alias("shard")).mapInArrow(headers, "path string, place int, shard int, rows long, width long, start long, kind string")
    if dim:
        shards = shards.where(F.col("width") == dim)
    shards = shards.where("rows > 0 AND width > 0")
    upto = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0)))
    if cap is not None:
        shards = shards.withColumn("rows", F.least(F.col("rows"), F.greatest(F.lit(cap) - F.col("before"), F.lit(0)))).where("rows > 0")
    start = Window.orderBy("place", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("first", F.coalesce(F.sum("rows").over(start), F.lit(0)))
    step = F.greatest(F.lit(1), F.floor(F.lit(RANGE) / (F.col("width") * 4)))
    ranges = shards.withColumn("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1, step))).withColumn("b", F.least(F.col("a") + step, F.col("rows")))
    spread = ranges.select("path", "place", "shard", "width", "start", "kind", "first", "a", "b").repartition(F.col("path"), F.col("a"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                dtype = np.dtype(r["kind"])
                with _open(r["path"]) as f:
                    raw = f.read_at((r["b"] - r["a"]) * r["width"] * dtype.itemsize, r["start"] + r["a"] * r["width"] * dtype.itemsize)
                m = np.frombuffer(raw, dtype).reshape(-1, r["width"]).astype(np.float32)
                for s in range(0, len(m), 8192):
                    part = m[s : s + 8192]
                    pos = np.arange(r["a"] + s, r["a"] + s + len(part))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * r["width"]), pa.array(part.ravel()))
                    fixed = [pa.array(np.full(len(part), r[c]), pa.int32()) for c in ("place", "shard")]
                    yield pa.record_batch([pa.array(pos + r["first"]), *fixed, pa.array(pos), flat], names=["id", "place", "shard", "pos", "v"])

    return spread.mapInArrow(rows, "id long, place int, shard int, pos long, v array<float>")


def write_shards(df: DataFrame, folder: str, rows_per_shard: int, key: str = "id", vector: str = "v", dtype: str = "<f4", header: bool = True) -> DataFrame:
    """Writes ``data-i-of-n`` shards in id order and returns ``shard, rows, path``. Ids must be 0, 1, 2, ... without gaps.

    A task writes one shard. Raises if a shard exists or ids have gaps.
    """
    n_shards = max(1, -(-df.count() // rows_per_shard))
    place = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = df.select(F.floor(F.col(key) / rows_per_shard).cast("int").alias("shard"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def write(table: pa.Table) -> pa.Table:
        shard, ids = table.column("shard")[0].as_py(), table.column("id").to_numpy()
        order = np.argsort(ids)
        if (ids[order] != np.arange(shard * rows_per_shard, shard * rows_per_shard + len(ids))).any():
            raise ValueError(f"the ids of shard {shard} have gaps or repeats")
        m = np.asarray(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(ids), -1)[order].astype(dtype)
        out = io.BytesIO()
        np.save(out, m) if header else out.write(m.tobytes())
        path = f"{place}/data-{shard:05d}-of-{n_shards:05d}{'.npy' if header else '.f32'}"
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        if fs.get_file_info(inner).type != pyarrow.fs.FileType.NotFound:
            raise FileExistsError(path)
        with fs.open_output_stream(inner + ".part") as f:
            f.write(out.getbuffer())
        fs.move(inner + ".part", inner)
        return pa.table({"shard": pa.array([shard], pa.int32()), "rows": pa.array([len(ids)], pa.int64()), "path": [path]})

    return df.sparkSession.createDataFrame(rows.groupBy("shard").applyInArrow(write, "shard int, rows long, path string").collect(), "shard int, rows long, path string")


def natural_key(path: str) -> list:
    """Sort key of shard names with numbers in order of value."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", path)]
