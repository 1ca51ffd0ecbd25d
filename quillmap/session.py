"""Session helpers: reading tables, shared staging, and deterministic settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once for each application: they need not find it where the driver does."""
    context, here = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _SHIPPED or not here.is_dir():
        return
    _SHIPPED.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="quillmap-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/{here.name}.zip", "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, f"{here.name}/{path.relative_to(here)}")
    context.addPyFile(f"{folder}/{here.name}.zip")


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data folder; a single Parquet file and a folder of part files both work."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode an own one where that is unset."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="quillmap-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], True)
    return f"file://{_OWN_DIR[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; a leftover stage is only disk
        pass


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and lets several consumers read the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmap-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_delete, spark, path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    for path in df.inputFiles()[:1]:
        _delete(df.sparkSession, path.rsplit("/", 1)[0])
