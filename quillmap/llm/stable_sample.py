"""Reproducible samples that stay as the data grow: epoch-rate selection, and an audit of recorded selections.

A ledger holds each record's first-seen epoch, a rate table the rate frozen for each epoch when it was first met. A
record is selected if its own random number, drawn by a counter-based generator from its identifier and the seeds, is
below the rate of its first epoch. Neither number ever changes, so a selected record stays selected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillmap.functions.random import seed_key, uniform
from quillmap.session import stage


def first_epochs(rows: DataFrame, space: list[str], record: str, epoch: str) -> DataFrame:
    """The ledger ``space..., record, first_epoch``: the earliest epoch of each record of a space.

    Repeated deliveries count once. Rows without a space, a record id or an epoch are in no ledger: they can't be told
    apart or placed, and are never selected. An empty table gives an empty ledger.
    """
    known = rows.dropna(subset=[*space, record, epoch])
    return known.groupBy(*space, record).agg(F.min(epoch).alias("first_epoch"))


def freeze_rates(ledger: DataFrame, space: list[str], target: float) -> DataFrame:
    """Rates ``space..., first_epoch, rate``: the target size over the records known by the end of the epoch, 1 at most.

    An epoch's rate depends on no later epoch.
    """
    size = ledger.groupBy(*space, "first_epoch").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*space).orderBy("first_epoch").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.least(F.lit(1.0), F.lit(float(target)) / F.sum("n").over(upto))
    return size.select(*space, "first_epoch", rate.alias("rate"))


def select_records(ledger: DataFrame, record: str, seed: Column, anchor_seed: Column, rate: Column) -> DataFrame:
    """The records of a ledger whose draw is below ``rate`` (null: none)."""
    return ledger.where(uniform(F.col(record), seed_key(seed, anchor_seed)) < rate)


class SampleState:
    """Ledger and frozen rates of one table, persisted in a folder that all executors share.

    Every run that meets something new adds a folder ``run-N`` with the new records and the rates of new epochs; nothing
    is rewritten. The rates are written last, and a run without whole rates doesn't count, so a run that breaks off leaves
    the state as it was. The state belongs to one target; any number of seeds may share it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in fs.listStatus(base)) if fs.exists(base) else []
        return [f"{self.path}/{n}" for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/rates/_SUCCESS"))]

    def read(self, what: str, schema: StructType) -> DataFrame:
        paths = [f"{r}/{what}" for r in self.runs()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def extended(self, rows: DataFrame, space: list[str], record: str, epoch: str, target: float) -> tuple[DataFrame, DataFrame]:
        """Ledger and rates with the new records and epochs of ``rows`` added. What was there stays as it was."""
        seen = first_epochs(rows, space, record, epoch)
        rate = StructType([*[seen.schema[c] for c in space], seen.schema["first_epoch"], StructField("rate", DoubleType())])
        ledger, rates = self.read("ledger", seen.schema), self.read("rates", rate)
        before = len(self.runs())
        new = stage(seen.join(ledger.select(*space, record), [*space, record], "left_anti"), "ledger") if before else seen
        if before and new.isEmpty():
            return ledger, rates
        run = f"{self.path}/run-{before:08d}-{uuid.uuid4().hex}"
        new.write.parquet(f"{run}/ledger")
        whole = ledger.unionByName(self.spark.read.schema(seen.schema).parquet(f"{run}/ledger"))
        frozen = rates.select(*space, "first_epoch")
        freeze_rates(whole, space, target).join(frozen, [*space, "first_epoch"], "left_anti").write.parquet(f"{run}/rates")
        return self.read("ledger", seen.schema), self.read("rates", rate)


def stable_sample(rows: DataFrame, space: list[str], record: str, epoch: str, seed: int, anchor_seed: int, target: float, state: str | None = None) -> DataFrame:
    """The sample ``space..., record, first_epoch, rate`` of every space for one pair of seeds.

    About ``target`` records of the first epoch, and of each later one as many as its frozen rate gives. The draw depends
    on the seeds and the record only: neither order nor partitioning nor repeated rows change it. ``state``: the folder of
    ledger and rates (see SampleState), which are read and extended. With it a record that was selected stays selected
    whatever comes later, records of earlier epochs and earlier epochs of known records included; it stays in the sample
    even if its row is gone. Without it the rows at hand are all there is, and late rows of an epoch lower its rate.
    """
    if state is None:
        ledger = first_epochs(rows, space, record, epoch)
        rates = freeze_rates(ledger, space, target)
    else:
        ledger, rates = SampleState(rows.sparkSession, state).extended(rows, space, record, epoch, target)
    picked = select_records(ledger.join(rates, [*space, "first_epoch"]), record, F.lit(seed), F.lit(anchor_seed), F.col("rate"))
    return picked.select(*space, record, "first_epoch", "rate")


_GROUP = ["testbed_id", "seed", "anchor_seed"]
#: Classes of one group that a task compares with a slice of the group's broken ones; larger groups get more slices.
SLICE = 256


def audit_receipts(receipts: DataFrame) -> DataFrame:
    """Pairs ``receipt_a < receipt_b`` of recorded selections that can't both come from one stable sample.

    Receipts of equal testbed, seed and anchor seed are one group, and their lists give its ledger: a record's first epoch
    is the lowest snapshot whose receipts list it. What is selected stays selected, so the sample at a snapshot is the
    ledger up to it, and a receipt that lists all of that breaks nothing with an earlier one. Draws and rates play no part:
    the receipts record selections, whatever made them. Only receipts that lack some of it are compared, as classes of equal sets, with the group's classes of the same
    or lower snapshots; a pair is reported if the lower one (either one, at equal snapshots) lists a record the other
    lacks. Large groups are split in slices, each meeting the group's classes once.

    A receipt delivered again counts once; if deliveries differ, the earliest recorded (then smallest) counts. Null or
    repeated list elements don't count. Receipts with a null seed, anchor seed, testbed, snapshot or list are compared
    with none. Other columns are ignored; an empty table gives no pairs.
    """
    fields = ["recorded_at", *_GROUP, "snapshot_no", "sample_indices"]
    one = receipts.select("receipt_id", *fields).dropna(subset=["receipt_id", "seed"])
    one = one.groupBy("receipt_id").agg(F.min(F.struct(*fields)).alias("r")).select("receipt_id", "r.*")
    listed = F.array_sort(F.array_distinct(F.filter("sample_indices", lambda x: x.isNotNull())))
    one = one.dropna(subset=[*_GROUP, "snapshot_no", "sample_indices"]).withColumn("records", listed)
    one = one.withColumn("class", F.sha2(F.concat_ws(",", F.col("records").cast("array<string>")), 256)).select("receipt_id", *_GROUP, "snapshot_no", "class", "records")
    one = stage(one, "receipts")

    same = [*_GROUP, "snapshot_no", "class"]
    classes = stage(one.groupBy(*same).agg(F.min_by("records", "receipt_id").alias("records")), "classes")
    rows = classes.select(*_GROUP, "snapshot_no", F.explode("records").alias("row_id"))
    ledger = first_epochs(rows, _GROUP, "row_id", "snapshot_no")
    grown = ledger.groupBy(*_GROUP, "first_epoch").agg(F.count("*").alias("new"))
    upto = Window.partitionBy(*_GROUP).orderBy("snapshot_no").rangeBetween(Window.unboundedPreceding, 0)
    per_snapshot = classes.groupBy(*_GROUP, "snapshot_no").agg(F.count("*").alias("here"))
    # Every first epoch is the snapshot of some class, but an all-empty snapshot has no first epoch of its own.
    expected = per_snapshot.join(grown.withColumnRenamed("first_epoch", "snapshot_no"), [*_GROUP, "snapshot_no"], "left")
    expected = expected.select(*_GROUP, "snapshot_no", F.sum(F.coalesce("new", F.lit(0))).over(upto).alias("expected"), F.sum("here").over(Window.partitionBy(*_GROUP)).alias("classes"))

    sized = classes.join(expected, [*_GROUP, "snapshot_no"]).withColumn("slices", F.ceil(F.col("classes") / SLICE).cast("int"))
    broken = sized.where(F.size("records") < F.col("expected"))
    broken = broken.select(*_GROUP, F.pmod(F.xxhash64("class"), F.col("slices")).alias("slice"), F.col("snapshot_no").alias("later"), F.col("class").alias("later_class"), F.col("records").alias("later_records"))
    groups = broken.select(*_GROUP).distinct()
    met = sized.join(groups, _GROUP, "left_semi").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices").cast("bigint") - 1)))
    clash = met.join(broken, [*_GROUP, "slice"]).where((F.col("snapshot_no") <= F.col("later")) & ((F.col("snapshot_no") < F.col("later")) | (F.col("class") != F.col("later_class"))))
    clash = clash.where(F.size(F.array_except("records", "later_records")) > 0)
    # At equal snapshots both directions may clash; the pair is kept once.
    swap = (F.col("snapshot_no") == F.col("later")) & (F.col("class") > F.col("later_class"))
    first = F.struct(F.col("snapshot_no").alias("s"), F.col("class").alias("c"))
    second = F.struct(F.col("later").alias("s"), F.col("later_class").alias("c"))
    pairs = clash.select(*_GROUP, F.when(swap, second).otherwise(first).alias("a"), F.when(swap, first).otherwise(second).alias("b")).distinct()
    member = one.select(*_GROUP, F.struct(F.col("snapshot_no").alias("s"), F.col("class").alias("c")).alias("m"), "receipt_id")
    pairs = pairs.join(member.withColumnsRenamed({"m": "a", "receipt_id": "ra"}), [*_GROUP, "a"]).join(member.withColumnsRenamed({"m": "b", "receipt_id": "rb"}), [*_GROUP, "b"])
    return pairs.select(F.least("ra", "rb").alias("receipt_a"), F.greatest("ra", "rb").alias("receipt_b"))
