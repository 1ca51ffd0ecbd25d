"""Flat tables of evidence documents and status registries."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.operators.shred import Shredded, shred, shred_columns
from quillmap.session import load, stage

_COLLECTION = ("object", "array")
CONTENT = ("runs", "corpora")


class EvidenceTables:
    """Runs, panels, purities, corpora and deltas of the bodies; every child row holds its parents' names."""

    def __init__(self, docs: DataFrame, key: str = "record_id", body: str = "body"):
        self.shredded, self.key = Shredded(stage(shred(docs, key, body, CONTENT), "nodes"), key), key

    # Tables that others are built on are written once, so no plan holds the chain of joins twice.

    @cached_property
    def runs(self) -> DataFrame:
        t = self.shredded
        return stage(t.children(t.member(t.root(), "runs", _COLLECTION), "run", named_by="label").where(F.col("run").isNotNull()), "runs")

    @cached_property
    def panels(self) -> DataFrame:
        return stage(self.shredded.member(self.runs, "panel_full"), "panels")

    @cached_property
    def purities(self) -> DataFrame:
        t = self.shredded
        return t.children(t.member(self.panels, "purity"), "purity", kinds=None)

    @cached_property
    def arm_means(self) -> DataFrame:
        t = self.shredded
        metrics = t.children(t.member(self.corpora, "arm_means"), "metric")
        return t.with_own(t.children(metrics, "arm", kinds=None), "mean").dropna(subset=["metric", "arm"])

    @cached_property
    def corpora(self) -> DataFrame:
        t = self.shredded
        return stage(t.children(t.member(t.root(), "corpora", _COLLECTION), "corpus", named_by="corpus").where(F.col("corpus").isNotNull()), "corpora")

    @cached_property
    def deltas(self) -> DataFrame:
        t = self.shredded
        collections = stage(t.member(self.corpora, "paired_deltas", _COLLECTION), "deltas")
        flat = t.with_fields(t.children(collections.where(F.col("kind") == "array"), "place"), "contrast", "metric")
        contrasts = t.children(collections.where(F.col("kind") == "object"), "contrast", kinds=_COLLECTION)
        nested = t.children(contrasts, "metric", named_by="metric")
        columns = [self.key, "doc", "node", "corpus", "contrast", "metric"]
        return flat.select(*columns).unionByName(nested.select(*columns)).dropna(subset=["contrast", "metric"])


class RegistryTables:
    """Events and signatures of the nested column ``events``."""

    def __init__(self, registry: DataFrame, key: str = "registry_id"):
        self.shredded = t = Shredded(stage(shred_columns(registry, key, "events"), "nodes"), key)
        events = t.children(t.member(t.root(), "events", ("array",)), "place").drop("place")
        self.events = stage(t.with_fields(events, "event_id", "evidence_id", "recorded_utc", "status", "diagnostic_only").dropna(subset=["event_id"]), "events")
        signatures = t.children(t.member(self.events.select(key, "doc", "node", "event_id", F.lit("object").alias("kind")), "source_signatures", ("array",)), "place").drop("place")
        self.signatures = t.with_fields(signatures, "path", "sha256").dropna(subset=["path"])


def _rows(df: DataFrame, origin: str, key: str, entity: str, parent: Column, child: Column) -> DataFrame:
    return df.select(F.lit(origin).alias("origin"), F.col(key).cast("long").alias("record_id"), F.lit(entity).alias("entity"), parent.alias("parent_key"), child.alias("child_key"))


def children_found(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """One row for each child: ``origin, record_id, entity, parent_key, child_key``; repeated rows count once."""
    e, r, top = EvidenceTables(docs), RegistryTables(registry), F.lit("")
    at = ("evidence_docs", "record_id")
    parts = [
        _rows(e.runs, *at, "run", top, F.col("run")),
        _rows(e.panels, *at, "panel", F.col("run"), F.lit("panel_full")),
        _rows(e.purities, *at, "purity", F.col("run"), F.col("purity")),
        _rows(e.corpora, *at, "corpus", top, F.col("corpus")),
        _rows(e.deltas, *at, "delta", F.col("corpus"), F.concat_ws("/", "contrast", "metric")),
        _rows(r.events, "status_registry", "registry_id", "event", top, F.col("event_id")),
        _rows(r.signatures, "status_registry", "registry_id", "signature", F.col("event_id"), F.col("path")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return children_found(load(spark, root, "evidence_docs"), load(spark, root, "status_registry"))


def p2_runs(spark: SparkSession, root: str) -> DataFrame:
    """The table of runs with their scalar fields."""
    e = EvidenceTables(load(spark, root, "evidence_docs"))
    fields = ["run_dir", "wall_s", "ffr", "density", "recall@k", "hiD_reference_key", "no_model_reference"]
    wide = e.shredded.with_fields(e.runs, *fields).withColumnRenamed("recall@k", "recall_at_k")
    number = lambda c: F.expr(f"try_cast({c} as double)").alias(c)
    return wide.select("record_id", "run", "run_dir", number("wall_s"), number("ffr"), number("density"), number("recall_at_k"), "hiD_reference_key", F.expr("try_cast(no_model_reference as boolean)").alias("no_model_reference")).distinct()


def p2_deltas(spark: SparkSession, root: str) -> DataFrame:
    """The table of paired deltas with their statistics, each under its corpus."""
    e = EvidenceTables(load(spark, root, "evidence_docs"))
    wide = e.shredded.with_fields(e.deltas, "mean", "sd", "n")
    number = lambda c, kind: F.expr(f"try_cast({c} as {kind})").alias(c)
    return wide.select("record_id", "corpus", "contrast", "metric", number("mean", "double"), number("sd", "double"), number("n", "bigint")).distinct()


def p2_signatures(spark: SparkSession, root: str) -> DataFrame:
    r = RegistryTables(load(spark, root, "status_registry"))
    return r.signatures.select("registry_id", "event_id", "path", "sha256").distinct()


_FIELDS = {
    "run": {"run_dir": "string", "wall_s": "double", "ffr": "double", "purity_k256": "double", "purity_k1024": "double", "density": "double", "recall@k": "double", "hiD_reference_key": "string", "no_model_reference": "boolean"},
    "panel": {
        "schema": "string", "n": "bigint", "k_hit": "bigint", "anchor_seed": "bigint", "anchor_hash": "string",
        "provenance.scorer": "string", "provenance.device": "string", "provenance.coords_sha": "string", "provenance.peak_gpu_gb": "double",
        "guards.coords_finite": "boolean", "guards.emb_zero_rows": "bigint", "guards.hit_guard.boundary_min_gap": "double", "guards.hit_guard.overselect": "bigint",
    },
    "corpus": {"reference_key": "string", "n_maps": "bigint", "evaluator_wall_peak.max_wall_s": "double", "evaluator_wall_peak.wall_ok": "boolean"},
}


def column_of(path: str) -> str:
    return path.replace("@", "_at_").replace(".", "_")


def _wide(e: EvidenceTables, entities: DataFrame, fields: dict[str, str], *keys: str) -> DataFrame:
    wide = e.shredded.with_values(entities, **{column_of(p): p for p in fields})
    return wide.select(*keys, *[F.expr(f"try_cast({column_of(p)} as {kind})").alias(column_of(p)) for p, kind in fields.items()]).distinct()


def p2_runs_full(spark: SparkSession, root: str) -> DataFrame:
    """The table of runs with all the scalars that runs have; what else a body holds is in p2_values."""
    e = EvidenceTables(load(spark, root, "evidence_docs"))
    return _wide(e, e.runs, _FIELDS["run"], "record_id", "run")


def p2_panels(spark: SparkSession, root: str) -> DataFrame:
    """The table of full panels with their provenance and guards, each under its run."""
    e = EvidenceTables(load(spark, root, "evidence_docs"))
    return _wide(e, e.panels, _FIELDS["panel"], "record_id", "run")


def p2_purities(spark: SparkSession, root: str) -> DataFrame:
    e = EvidenceTables(load(spark, root, "evidence_docs"))
    return e.shredded.with_own(e.purities, "value").select("record_id", "run", "purity", F.expr("try_cast(value as double)").alias("value")).distinct()


def p2_corpora(spark: SparkSession, root: str) -> DataFrame:
    """The table of corpora; their arms' means are in p2_arm_means."""
    e = EvidenceTables(load(spark, root, "evidence_docs"))
    return _wide(e, e.corpora, _FIELDS["corpus"], "record_id", "corpus")


def p2_arm_means(spark: SparkSession, root: str) -> DataFrame:
    e = EvidenceTables(load(spark, root, "evidence_docs"))
    return e.arm_means.select("record_id", "corpus", "metric", "arm", F.expr("try_cast(mean as double)").alias("mean")).distinct()


def values_found(docs: DataFrame) -> DataFrame:
    """``record_id, entity, parent_key, child_key, path, kind, value``: every scalar of every record and of its children."""
    e, top = EvidenceTables(docs), F.lit("")
    apart = {"record": CONTENT, "run": ("panel_full",), "corpus": ("paired_deltas",)}
    parts = [
        ("record", e.shredded.root(), top, top),
        ("run", e.runs, top, F.col("run")),
        ("panel", e.panels, F.col("run"), F.lit("panel_full")),
        ("corpus", e.corpora, top, F.col("corpus")),
        ("delta", e.deltas, F.col("corpus"), F.concat_ws("/", "contrast", "metric")),
    ]
    out = []
    for entity, entities, parent, child in parts:
        keyed = entities.select("record_id", "doc", "node", parent.alias("parent_key"), child.alias("child_key"))
        met = keyed.join(e.shredded.values(entities, apart.get(entity, ())), ["record_id", "doc", "node"])
        out.append(met.select("record_id", F.lit(entity).alias("entity"), "parent_key", "child_key", "path", "kind", "value"))
    return reduce(DataFrame.unionByName, out).distinct()


def p2_values(spark: SparkSession, root: str) -> DataFrame:
    return values_found(load(spark, root, "evidence_docs"))


def p2_events(spark: SparkSession, root: str) -> DataFrame:
    """The table of events with all their members but the signatures; the column is typed, so times keep their microseconds."""
    e = load(spark, root, "status_registry").select("registry_id", F.explode("events").alias("e")).where("e.event_id IS NOT NULL")
    plain = [F.col(f"e.{c}").alias(c) for c in ("event_id", "evidence_id", "recorded_utc", "status", "reason")]
    source = [F.col(f"e.reviewer_source.{c}").alias(f"reviewer_source_{c}") for c in ("uri", "sha256")]
    return e.select("registry_id", *plain, *source, "e.replaces", "e.superseded_by", "e.diagnostic_only").distinct()
