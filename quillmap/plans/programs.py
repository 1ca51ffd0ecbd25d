"""Queries on artefacts around a map: merges, contracts, cached truths, exports, held-out queries, streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.functions import vector as vec
from quillmap.operators import artefacts, checks, graph, knn, projector, receipts, sampling
from quillmap.operators.metrics import as_points as knn_points
from quillmap.plans.base import ASK, E, K, Z, asked, flat_map, knn_sql, map_knn, points, query, r6, space_knn
from quillmap.plans.quality import K_FRAC_OUTSIDE, K_OUTSIDE, _frac
from quillmap.plans.tables import _h, _RUNS
from quillmap.session import delete_at_exit, load, shared_dir, stage
from quillmap.sources.readers import read_table
from quillmap.streaming.transform import stream_files, stream_transform

_ODD = "o AS (SELECT id, round(x * 2, 6) AS x, label + 1 AS score FROM z WHERE id % 2 = 1)"


@query(f"WITH {Z}, {_ODD} SELECT z.id, round(z.x, 6) AS x, o.x AS x_2, o.score FROM z LEFT JOIN o USING (id)")
def metric_merge(spark: SparkSession, root: str) -> DataFrame:
    """Columns merged by id; a name that is there already gets a number."""
    z = flat_map(spark, root).select("id", r6("x"))
    o = flat_map(spark, root).where("id % 2 = 1").select("id", F.round(F.col("x") * 2, 6).alias("x"), (F.col("label") + 1).alias("score"))
    return artefacts.merge_columns(z, o, "id")


@query("SELECT c.probe, c.n AS corpus_rows, q.n AS query_rows FROM (SELECT probe, count(*) AS n FROM probe_corpus GROUP BY probe) c FULL JOIN (SELECT probe, count(*) AS n FROM probe_queries GROUP BY probe) q USING (probe)")
def stem_join(spark: SparkSession, root: str) -> DataFrame:
    """Two collections paired by name, with their row counts."""
    a = load(spark, root, "probe_corpus").groupBy("probe").agg(F.count("*").alias("corpus_rows"))
    b = load(spark, root, "probe_queries").groupBy("probe").agg(F.count("*").alias("query_rows"))
    return a.join(b, "probe", "full_outer")


@query(f"WITH {E}, {knn_sql('n', 'e', anchors=False)}, d AS (SELECT src, dst, 1 - list_cosine_similarity(a.v, b.v) AS dist FROM n JOIN e a ON a.id = src JOIN e b ON b.id = dst), s AS (SELECT src, dst, dist FROM d UNION ALL SELECT id, id, 0 FROM e) SELECT src, dst, round(dist, 6) + 0.0 AS dist, row_number() OVER (PARTITION BY src ORDER BY round(dist, 9), dst <> src, dst) - 1 AS place FROM s")
def edge_distances(spark: SparkSession, root: str) -> DataFrame:
    """Exact cosine distances over the edges of a topology, each row's list ascending with itself in front."""
    p = points(spark, root)
    d = artefacts.edge_cosines(space_knn(spark, root, anchors=False).select("src", "dst"), p)
    both = d.unionByName(p.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist")))
    w = Window.partitionBy("src").orderBy(F.round("dist", 9), F.col("dst") != F.col("src"), "dst")
    return both.select("src", "dst", (F.round("dist", 6) + 0.0).alias("dist"), (F.row_number().over(w) - 1).cast("long").alias("place"))


@query(f"WITH {E}, {Z} SELECT e.id, round(x, 6) AS x, round(y, 6) AS y FROM e JOIN z USING (id)")
def teacher_targets(spark: SparkSession, root: str) -> DataFrame:
    """Row i takes the teacher's place i; a row without one is an error."""
    return _targets(points(spark, root).select("id"), flat_map(spark, root).select("id", "x", "y"))


def _targets(rows: DataFrame, teacher: DataFrame) -> DataFrame:
    checks.require(rows.join(teacher, "id", "left_anti"), "rows without a teacher")
    return rows.join(teacher, "id").select("id", r6("x"), r6("y"))


@query(f"WITH {E}, {knn_sql('n', 'e', anchors=False)} SELECT least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS n FROM n GROUP BY 1, 2")
def pair_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Both directions of a link under one key, the unordered pair itself."""
    n = space_knn(spark, root, anchors=False)
    return n.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.count("*").alias("n"))


@query(f"WITH {E}, {knn_sql('n', 'e', anchors=False)} SELECT src, dst FROM n WHERE src % 3 <> 0 ORDER BY {_h(41, 'src', 'dst')}, src, dst LIMIT 100")
def retained_edge_draws(spark: SparkSession, root: str) -> DataFrame:
    """Edges drawn among those whose source is retained: conditioned by taking the others out first."""
    n = space_knn(spark, root, anchors=False).where("src % 3 != 0").select("src", "dst")
    return n.withColumn("h", sampling.hash_number(41, F.col("src"), F.col("dst"))).orderBy("h", "src", "dst").limit(100).select("src", "dst")


@query(f"WITH {E}, {knn_sql('n', 'e', anchors=False)} SELECT src // 100 AS block, count(*) AS edges, min(src) AS first, max(src) AS last FROM n WHERE src % 10 = 3 GROUP BY 1")
def excluded_ranges(spark: SparkSession, root: str) -> DataFrame:
    """How many edges the excluded sources have, by range of sources."""
    n = space_knn(spark, root, anchors=False).where("src % 10 = 3")
    return n.groupBy(F.floor(F.col("src") / 100).alias("block")).agg(F.count("*").alias("edges"), F.min("src").alias("first"), F.max("src").alias("last"))


@query(f"WITH {E}, {knn_sql('n', 'e', anchors=False)}, p AS (SELECT src, dst, row_number() OVER (ORDER BY {_h(43, 'src', 'dst')}, src, dst) - 1 AS pos FROM n) SELECT pos // 256 AS batch, count(*) AS n, sum(src)::BIGINT AS sources FROM p GROUP BY 1")
def edge_batches(spark: SparkSession, root: str) -> DataFrame:
    """Shuffled batches of 256 edges."""
    n = space_knn(spark, root, anchors=False).select("src", "dst", sampling.hash_number(43, F.col("src"), F.col("dst")).alias("h"))
    placed = sampling.positions(n, ["h", "src", "dst"])
    return placed.groupBy(F.floor(F.col("pos") / 256).alias("batch")).agg(F.count("*").alias("n"), F.sum("src").alias("sources"))


@query(
    f"""WITH {E}, {Z}, h AS (SELECT id FROM e WHERE id % {ASK} = 0), t AS (SELECT id FROM e WHERE id % {ASK} <> 0), c AS (SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e)
    SELECT h.id AS query_id, norm, row_number() OVER (ORDER BY {_h(47, 'h.id')}, h.id) - 1 AS place FROM h JOIN c USING (id)"""
)
def held_out_queries(spark: SparkSession, root: str) -> DataFrame:
    """A query set that holds no training row, in a seeded order, with its lengths as proof of normalisation."""
    p = points(spark, root)
    held = asked(p)
    checks.require(held.select("id").intersect(p.where(F.col("id") % ASK != 0).select("id")), "queries among the training rows")
    rows = held.select("id", F.round(vec.norm(vec.doubles("v")), 6).alias("norm"), sampling.hash_number(47, F.col("id")).alias("h"))
    return sampling.positions(rows, ["h", "id"]).select(F.col("id").alias("query_id"), "norm", F.col("pos").cast("long").alias("place"))


@query(
    f"""WITH {E}, {Z}, {knn_sql('h', 'e')}, {knn_sql('l', 'z', None)}, s AS (SELECT greatest({K_OUTSIDE}, ceil(count(*) * {K_FRAC_OUTSIDE})) AS k FROM e), f AS (SELECT h.src, count(l.dst) FILTER (l.rank <= k) / 10 AS ffr FROM h CROSS JOIN s LEFT JOIN l ON l.src = h.src AND l.dst = h.dst GROUP BY h.src), g AS (SELECT label, avg(ffr) AS ffr FROM f JOIN e ON e.id = src GROUP BY label)
    SELECT label, round(ffr, 6) AS ffr, round(ffr / (SELECT avg(ffr) FROM f), 6) AS retention FROM g"""
)
def out_of_domain_panel(spark: SparkSession, root: str) -> DataFrame:
    """Fixed-fraction recall of each group of queries among the nearest max(50, 1 % of the rows), over that of all."""
    p = points(spark, root)
    lo = map_knn(spark, root, _frac(p.count(), K_OUTSIDE, K_FRAC_OUTSIDE))
    f = knn.recall(lo, space_knn(spark, root), K).select(F.col("src").alias("id"), "recall")
    met = f.join(p.select("id", "label"), "id")
    per = met.groupBy("label").agg(F.avg("recall").alias("ffr"))
    return per.crossJoin(met.agg(F.avg("recall").alias("all"))).select("label", r6("ffr"), F.round(F.col("ffr") / F.col("all"), 6).alias("retention"))


@query(f"WITH {E}, {knn_sql('n', 'e')} SELECT src, dst, rank::INTEGER AS rank FROM n")
def cached_truth(spark: SparkSession, root: str) -> DataFrame:
    """The map-independent neighbours, written under a key of their data and settings and read back at the next use in this application."""
    p = points(spark, root)
    key = artefacts.table_key(p.select("id", "v"), {"k": K, "metric": "l2", "ask": ASK})
    build = lambda: space_knn(spark, root)
    folder = f"{shared_dir(spark)}/quillmap-truth-{spark.sparkContext.applicationId}"
    delete_at_exit(spark, folder)
    first = artefacts.cached(spark, folder, key, build)
    again = artefacts.cached(spark, folder, key, build)
    checks.require(first.select("src", "dst").exceptAll(again.select("src", "dst")), "the cache differs")
    return again.select("src", "dst", "rank")


@query(f"WITH {E}, {knn_sql('n', 'e', 11)} SELECT src, round(max(dist) FILTER (rank = 11) - max(dist) FILTER (rank = 10), 6) AS gap FROM n GROUP BY src")
def boundary_gap(spark: SparkSession, root: str) -> DataFrame:
    """How clearly each list of ten is told from the eleventh: small gaps make ties of rounding possible."""
    n = space_knn(spark, root, 11)
    d = lambda r: F.max(F.when(F.col("rank") == r, F.col("dist")))
    return n.groupBy("src").agg(F.round(d(11) - d(10), 6).alias("gap"))


@query(f"WITH {E}, {knn_sql('n', 'e')} SELECT 0::BIGINT AS missing, 0::BIGINT AS beyond_tolerance, count(*) AS n FROM n")
def reproduction_canary(spark: SparkSession, root: str) -> DataFrame:
    """Stored lists against computed ones: swaps are allowed where the scores are equal within a tolerance."""
    p = points(spark, root)
    stored = knn.exact_knn(asked(p), p, K, block=64).select("src", "rank", F.col("dst").alias("a"), F.col("dist").alias("da"))
    fresh = space_knn(spark, root).select("src", "rank", F.col("dst").alias("b"), F.col("dist").alias("db"))
    met = stored.join(fresh, ["src", "rank"], "full_outer")
    return met.agg(F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("bigint")).alias("missing"), F.sum((F.abs(F.col("da") - F.col("db")) > 1e-7).cast("bigint")).alias("beyond_tolerance"), F.count("*").alias("n"))


@query(f"WITH {E} SELECT round(min(c), 6) AS row_floor, round(avg(c), 6) AS mean, min(c) >= 0.95 AS rows_ok, avg(c) >= 0.98 AS mean_ok FROM (SELECT list_cosine_similarity(v, list_transform(v, lambda x: round(x, 2))) AS c FROM e)")
def faithfulness(spark: SparkSession, root: str) -> DataFrame:
    """Cosines of stored and remade vectors (here: rounded to 2 decimals) against a floor for rows and for the mean."""
    v = vec.doubles("v")
    c = points(spark, root).select(vec.cosine(v, F.transform(v, lambda x: F.round(x, 2))).alias("c"))
    return c.agg(F.round(F.min("c"), 6).alias("row_floor"), F.round(F.avg("c"), 6).alias("mean"), (F.min("c") >= 0.95).alias("rows_ok"), (F.avg("c") >= 0.98).alias("mean_ok"))


@query(f"WITH {_RUNS}, p AS (SELECT stream, run_dir, row_number() OVER (PARTITION BY stream ORDER BY ffr DESC, run_dir) AS place, ffr FROM a) SELECT stream, run_dir, place::INTEGER AS place, round(ffr, 6) AS ffr FROM p WHERE place <= 3")
def gallery_order(spark: SparkSession, root: str) -> DataFrame:
    """The best three runs of each stream in order."""
    from quillmap.plans.tables import _runs

    w = Window.partitionBy("stream").orderBy(F.desc("ffr"), "run_dir")
    return _runs(spark, root).withColumn("place", F.row_number().over(w)).where("place <= 3").select("stream", "run_dir", "place", r6("ffr"))


@query()
def scalar_equivalence(spark: SparkSession, root: str) -> DataFrame:
    """Scalars of each run in successive files, path by path: where two reports of one run disagree."""
    from quillmap.operators import drift

    m = stage(drift.member_rows(load(spark, root, "panel_lines"), drift.FILE), "members")
    n = m.where("kind = 'number'").groupBy("stream", "run", "path").agg(F.count_distinct("file_name").alias("files"), F.min(F.col("value").cast("double")).alias("lo"), F.max(F.col("value").cast("double")).alias("hi"))
    return n.where("files > 1").groupBy("path").agg(F.count("*").alias("runs"), F.sum((F.col("hi") - F.col("lo") > 1e-9).cast("bigint")).alias("different"))


@query("SELECT doc_id, count(*) AS fields FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^ *([a-z_]+): *[^\\n]+$', 1)) AS k FROM documents WHERE contains(text, '```yaml')) GROUP BY doc_id")
def header_fields(spark: SparkSession, root: str) -> DataFrame:
    """Flat ``key: value`` lines of texts that hold a configuration."""
    d = load(spark, root, "documents").where(F.contains("text", F.lit("```yaml")))
    found = F.regexp_extract_all("text", F.lit(r"(?m)^ *([a-z_]+): *[^\n]+$"), F.lit(1))
    return d.select("doc_id", F.size(found).cast("long").alias("fields")).where("fields > 0")


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS effective, len(regexp_extract_all(text, '\\S+')) > 128 AS cut FROM documents WHERE text IS NOT NULL")
def effective_lengths(spark: SparkSession, root: str) -> DataFrame:
    """Words of each text, and whether a limit of 128 would cut it."""
    d = load(spark, root, "documents").where("text IS NOT NULL")
    n = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long")
    return d.select("doc_id", n.alias("effective"), (n > 128).alias("cut"))


@query(
    """WITH r AS (SELECT doc_id AS k, sha256(length(text)::VARCHAR || ':' || text) AS h FROM documents WHERE text IS NOT NULL), a AS (SELECT k // 4096 AS k, sha256(string_agg(k::VARCHAR || h, '' ORDER BY k)) AS h FROM r GROUP BY 1),
    b AS (SELECT k // 4096 AS k, sha256(string_agg(k::VARCHAR || h, '' ORDER BY k)) AS h FROM a GROUP BY 1) SELECT CASE WHEN (SELECT count(*) FROM a) = 1 THEN (SELECT max(h) FROM a) ELSE (SELECT max(h) FROM b) END AS identity"""
)
def text_identity(spark: SparkSession, root: str) -> DataFrame:
    """One hash over all texts in id order: a tree over hashes of length-prefixed rows."""
    d = load(spark, root, "documents").where("text IS NOT NULL")
    found = artefacts.identity_tree(d, "doc_id", F.concat(F.length("text").cast("string"), F.lit(":"), F.col("text")))
    return spark.createDataFrame([(found,)], "identity string")


@query()
def random_projection_floor(spark: SparkSession, root: str) -> DataFrame:
    """Recall of a map by a fixed random projection: what a map without any training reaches."""
    p = points(spark, root)
    w = np.random.default_rng(61).normal(size=(64, 2)) / 8
    z = knn_points(projector.transform(p, projector.Projector([w], [np.zeros(2)])))
    r = knn.recall(knn.exact_knn(asked(z), z, K), space_knn(spark, root), K)
    return r.agg(F.count("*").alias("anchors"), F.round(F.avg("recall"), 6).alias("recall"))


@query("WITH ev AS (SELECT DISTINCT registry_id, e.evidence_id AS evidence_id, lower(e.status) AS status FROM (SELECT registry_id, unnest(events) AS e FROM status_registry) WHERE e.event_id IS NOT NULL AND e.evidence_id IS NOT NULL) SELECT registry_id, evidence_id, coalesce(max(status) FILTER (status IN ('accepted', 'invalidated')), max(status), 'unknown') AS state FROM ev GROUP BY 1, 2")
def evidence_state(spark: SparkSession, root: str) -> DataFrame:
    """The state of each evidence: a review's verdict before any other status, unknown without one."""
    e = load(spark, root, "status_registry").select("registry_id", F.explode("events").alias("e")).where("e.event_id IS NOT NULL AND e.evidence_id IS NOT NULL")
    s = F.lower("e.status")
    verdict = F.max(F.when(s.isin("accepted", "invalidated"), s))
    return e.groupBy("registry_id", F.col("e.evidence_id").alias("evidence_id")).agg(F.coalesce(verdict, F.max(s), F.lit("unknown")).alias("state"))


@query("SELECT lr, k, seed FROM (SELECT unnest([0.1, 0.01])::DOUBLE AS lr), (SELECT unnest([5, 10, 15]) AS k), (SELECT unnest([1, 2]) AS seed)")
def sweep_grid(spark: SparkSession, root: str) -> DataFrame:
    """All settings of a sweep."""
    grid = artefacts.expand_sweep({"optimizer": {"lr": 1.0}}, {"optimizer.lr": [0.1, 0.01], "k": [5, 10, 15], "seed": [1, 2]})
    return spark.createDataFrame([(c["optimizer"]["lr"], c["k"], c["seed"]) for c in grid], "lr double, k int, seed int")


@query(f"WITH {Z}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM z) SELECT id, round((x - x0) / (x1 - x0), 6) AS x, round((y - y0) / (y1 - y0), 6) AS y, label FROM z, b ORDER BY {_h(53, 'id')}, id LIMIT 200")
def gallery_sample(spark: SparkSession, root: str) -> DataFrame:
    """The points of a gallery: one sample of ids for all maps, in the frame of the whole map."""
    z = flat_map(spark, root)
    box = z.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda c: F.round((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")), 6).alias(c)
    return sampling.sample(z, 200, 53).crossJoin(F.broadcast(box)).select("id", at("x"), at("y"), "label")


@query(f"WITH {Z} SELECT id, round(0.5 * x + 2 * y, 6) AS u FROM z")
def streamed_transform(spark: SparkSession, root: str) -> DataFrame:
    """A row-wise transform of files as a stream, a bounded batch at a time."""
    base = f"{shared_dir(spark)}/quillmap-stream-{uuid.uuid4().hex}"
    flat_map(spark, root).repartition(4).write.parquet(f"{base}/in")
    source = stream_files(spark, f"{base}/in", spark.read.parquet(f"{base}/in"), 2)
    stream_transform(source, lambda df: df.select("id", F.round(0.5 * F.col("x") + 2 * F.col("y"), 6).alias("u")), f"{base}/out", f"{base}/done")
    return spark.read.parquet(f"{base}/out")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_dispatch(spark: SparkSession, root: str) -> DataFrame:
    """A table by the kind its name tells: here the documents, written as JSON and read back."""
    path = f"{shared_dir(spark)}/quillmap-docs-{uuid.uuid4().hex}.jsonl"
    load(spark, root, "documents").select("doc_id", "source").write.option("ignoreNullFields", "false").json(path)
    return read_table(spark, path, "doc_id long, source string").groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {E}, {knn_sql('n', 'e', 5, anchors=False)}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM n), m AS (SELECT count(*) AS m FROM u), d AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id), c AS (SELECT label, sum(k) AS k FROM d JOIN e USING (id) GROUP BY label), w AS (SELECT x.label, count(*) AS w FROM u JOIN e x ON x.id = a JOIN e y ON y.id = b WHERE x.label = y.label GROUP BY x.label) SELECT round(sum(coalesce(w, 0) / m - pow(k / (2.0 * m), 2)), 6) AS modularity FROM c LEFT JOIN w USING (label), m")
def label_modularity(spark: SparkSession, root: str) -> DataFrame:
    """Modularity of the labels as communities of the neighbour graph."""
    p = points(spark, root).select("id", "label")
    u = graph.undirected(space_knn(spark, root, 5, anchors=False)).withColumn("weight", F.lit(1.0))
    return graph.modularity(u, p.withColumnRenamed("label", "community")).select(r6("modularity"))


@query(f"WITH {E}, {Z}, {knn_sql('l', 'z', 1, anchors=False)} SELECT count(*) FILTER (dist < 0.01) AS close, count(*) AS n FROM l")
def near_collisions(spark: SparkSession, root: str) -> DataFrame:
    """Map points that lie on top of another."""
    return map_knn(spark, root, 1, anchors=False).agg(F.sum((F.col("dist") < 0.01).cast("bigint")).alias("close"), F.count("*").alias("n"))


@query(
    f"""WITH {E}, {Z}, {knn_sql('h', 'e')}, {knn_sql('l', 'z', 50)}, f AS (SELECT h.src, count(l.dst) FILTER (l.rank <= 50) / 10 AS a, count(l.dst) FILTER (l.rank <= 10) / 10 AS b FROM h LEFT JOIN l ON l.src = h.src AND l.dst = h.dst GROUP BY h.src), g AS (SELECT label, round(avg(a), 6) AS ffr, round(avg(b), 6) AS prior_ffr FROM f JOIN e ON e.id = src GROUP BY label)
    SELECT label, ffr, CASE WHEN label <> 0 THEN prior_ffr END AS prior_ffr, CASE WHEN label <> 0 THEN round(ffr - prior_ffr, 6) END AS delta FROM g"""
)
def prior_panel_comparison(spark: SparkSession, root: str) -> DataFrame:
    """A panel held against an earlier one, which saw fewer neighbours and lacks a group."""
    p, lo, hi = points(spark, root), stage(map_knn(spark, root, 50), "lo"), stage(space_knn(spark, root), "hi")

    def panel(near: DataFrame) -> DataFrame:
        r = knn.recall(near, hi, K).select(F.col("src").alias("id"), "recall")
        return r.join(p.select("id", "label"), "id").groupBy("label").agg(F.round(F.avg("recall"), 6).alias("ffr"))

    found = receipts.against_prior(panel(lo), panel(lo.where("rank <= 10")).where("label != 0"), "label", "ffr")
    return found.select("label", "ffr", "prior_ffr", F.round("delta", 6).alias("delta"))


@query("SELECT DISTINCT registry_id, e.event_id AS event_id, e.evidence_id AS evidence_id FROM (SELECT registry_id, unnest(events) AS e FROM status_registry) WHERE e.event_id IS NOT NULL AND e.evidence_id IS NOT NULL AND lower(e.status) = 'accepted' AND NOT coalesce(e.diagnostic_only, false)")
def evidence_resolve(spark: SparkSession, root: str) -> DataFrame:
    """The events by which evidence is accepted, those for diagnosis only left out: what a reference to evidence may resolve to."""
    e = load(spark, root, "status_registry").select("registry_id", F.explode("events").alias("e")).where("e.event_id IS NOT NULL AND e.evidence_id IS NOT NULL")
    fits = (F.lower("e.status") == "accepted") & ~F.coalesce("e.diagnostic_only", F.lit(False))
    return e.where(fits).select("registry_id", "e.event_id", "e.evidence_id").distinct()
