"""Queries on sources, samples, duplicates, identities and registries."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.functions import text as words
from quillmap.functions import vector as vec
from quillmap.operators import artefacts, checks, dedup, graph, knn, metrics, projector, sampling
from quillmap.plans.base import ASK, E, K, Z, asked, flat_map, knn_sql, points, query, r6, space_knn
from quillmap.session import load, shared_dir, stage
from quillmap.sources import generators, shards

_MAX = float(16**13)


def _h(seed: int, *ids: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(ids)})), 1, 13))::BIGINT"


def _u(seed: int, *ids: str) -> str:
    return f"(({_h(seed, *ids)} + 0.5::DOUBLE) / {_MAX!r}::DOUBLE)"


_DENSE = "d AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, embedding AS v FROM embeddings)"


def _dense(spark: SparkSession, root: str) -> DataFrame:
    """The embeddings with ids 0, 1, 2, ... as a matrix has them."""
    return sampling.positions(points(spark, root).select("id", "v"), ["id"]).select(F.col("pos").cast("long").alias("id"), "v")


def _shards(spark: SparkSession, root: str, **kind) -> DataFrame:
    folder = f"{shared_dir(spark)}/quillmap-shards-{uuid.uuid4().hex}"
    shards.write_shards(_dense(spark, root), folder, 120, **kind)
    return shards.list_shards(spark, folder)


_SUMS = f"WITH {_DENSE} SELECT id, (id // 120)::INTEGER AS shard, round(list_sum(v::DOUBLE[]), 6) AS total FROM d"


# ---- sources and sinks


@query(_SUMS)
def source_npy_shards(spark: SparkSession, root: str) -> DataFrame:
    """The embeddings written to matrix shards and read back, with global row ids."""
    return shards.read_shards(_shards(spark, root), 64).select("id", "shard", F.round(vec.total(vec.doubles("v")), 6).alias("total"))


@query(_SUMS)
def source_raw_shards(spark: SparkSession, root: str) -> DataFrame:
    """The same without headers: the length must fit the dimension."""
    return shards.read_shards(_shards(spark, root, header=False), 64).select("id", "shard", F.round(vec.total(vec.doubles("v")), 6).alias("total"))


@query(f"WITH {_DENSE} SELECT DISTINCT (id // 120)::INTEGER AS i, ((SELECT count(*) FROM d) + 119) // 120 AS n FROM d")
def source_shard_discovery(spark: SparkSession, root: str) -> DataFrame:
    """Shards told by their names, with gaps rejected."""
    return shards.discovered(_shards(spark, root)).select("i", F.col("n").cast("long").alias("n"))


@query(f"WITH {_DENSE}, m AS MATERIALIZED (SELECT id, v FROM d ORDER BY id LIMIT 100), c AS (SELECT id, v, 0 AS place FROM m UNION ALL SELECT id + 100, v, 1 FROM m) SELECT id, place::INTEGER AS place, round(list_sum(v::DOUBLE[]), 6) AS total FROM c")
def source_capped_corpora(spark: SparkSession, root: str) -> DataFrame:
    """Two corpora, of each at most the first 100 rows, under one range of ids."""
    folder = f"{shared_dir(spark)}/quillmap-shards-{uuid.uuid4().hex}"
    for name in ("a", "b"):
        shards.write_shards(_dense(spark, root), f"{folder}/{name}", 70)
    files = shards.list_shards(spark, f"{folder}/a", f"{folder}/b")
    return shards.read_shards(files, 64, cap=100).select("id", "place", F.round(vec.total(vec.doubles("v")), 6).alias("total"))


@query(f"WITH {_DENSE} SELECT id, round(v[1]::DOUBLE, 6) AS first FROM d WHERE id BETWEEN 100 AND 180")
def source_range_read(spark: SparkSession, root: str) -> DataFrame:
    """A contiguous range of rows across shards."""
    rows = shards.read_shards(_shards(spark, root), 64)
    return rows.where(F.col("id").between(100, 180)).select("id", F.round(F.col("v")[0].cast("double"), 6).alias("first"))


@query("SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings")
def source_coordinates(spark: SparkSession, root: str) -> DataFrame:
    """Coordinates written as a table and read back: ids whole, unique and complete, columns of any case."""
    path = f"{shared_dir(spark)}/quillmap-coords-{uuid.uuid4().hex}"
    flat_map(spark, root).select(F.col("id").cast("double").alias("LS_index"), F.col("x").alias("X"), F.col("y").alias("Y")).write.parquet(path)
    read = spark.read.parquet(path)
    named = read.select(*[F.col(c).alias(c.lower()) for c in read.columns])
    z = named.select(checks.whole_number(F.col("ls_index")).alias("id"), "x", "y")
    checks.require(checks.order_breaks(z, "id"), "repeated ids")
    return checks.scattered(z, points(spark, root).count()).select("id", r6("x"), r6("y"))


@query(f"WITH {E}, {knn_sql('n', 'e', anchors=False)} SELECT count(*) AS edges, greatest(max(src), max(dst)) + 1 AS n_nodes FROM n")
def source_edge_list(spark: SparkSession, root: str) -> DataFrame:
    """Edges written in (src, dst) order and read back; the number of nodes is inferred."""
    path = f"{shared_dir(spark)}/quillmap-edges-{uuid.uuid4().hex}"
    e = space_knn(spark, root, anchors=False).select("src", "dst", F.lit(1.0 / K).cast("float").alias("weight"))
    e.repartitionByRange(4, "src", "dst").sortWithinPartitions("src", "dst").write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("edges"), (F.greatest(F.max("src"), F.max("dst")) + 1).alias("n_nodes"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 50 = 0")
def source_label_scan(spark: SparkSession, root: str) -> DataFrame:
    """Rows of wanted ids, by a semi join."""
    docs = load(spark, root, "documents")
    return docs.join(docs.where(F.col("doc_id") % ASK == 0).select("doc_id"), "doc_id", "left_semi").select("doc_id", "source", "n_chars")


@query("WITH w AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS pos FROM embeddings WHERE vec_id % 50 = 0) SELECT pos, doc_id, n_chars FROM w JOIN documents ON doc_id = vec_id")
def source_text_fetch(spark: SparkSession, root: str) -> DataFrame:
    """Texts of given ids, in the order the ids were given in."""
    ids = load(spark, root, "embeddings").where(F.col("vec_id") % ASK == 0).select("vec_id", F.md5(F.col("vec_id").cast("string")).alias("h"))
    wanted = sampling.positions(ids, ["h", "vec_id"]).select(F.col("vec_id").alias("doc_id"), "pos")
    return load(spark, root, "documents").join(wanted, "doc_id").select(F.col("pos").cast("long").alias("pos"), "doc_id", "n_chars")


@query("SELECT probe, side, count(*) AS n FROM (SELECT probe, 'corpus' AS side, len(corpus_vector) AS w FROM probe_corpus UNION ALL SELECT probe, 'query', len(query_vector) FROM probe_queries) WHERE w = 96 GROUP BY probe, side")
def source_probe_scan(spark: SparkSession, root: str) -> DataFrame:
    """Corpus and query vectors of the probes, those of the right width."""
    c = load(spark, root, "probe_corpus").select("probe", F.lit("corpus").alias("side"), F.size("corpus_vector").alias("w"))
    q = load(spark, root, "probe_queries").select("probe", F.lit("query").alias("side"), F.size("query_vector").alias("w"))
    return c.unionByName(q).where("w = 96").groupBy("probe", "side").agg(F.count("*").alias("n"))


@query()
def source_synthetic(spark: SparkSession, root: str) -> DataFrame:
    """Clustered unit vectors made on the spot: rows, spread and mean length by label."""
    g = generators.clustered(spark, 2000, 16, 10, 42)
    return g.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(vec.norm(vec.doubles("v"))), 6).alias("length"))


@query("SELECT id, round(t * cos(t), 6) + 0.0 AS x, round(b * 20, 6) + 0.0 AS y, round(t * sin(t), 6) + 0.0 AS z FROM (SELECT id, ((id * 0.7548776662466927::DOUBLE) % 1.0 + 0.5) * 1.5 * 2 * 3.141592653589793::DOUBLE AS t, (id * 0.5698402909980532::DOUBLE) % 1.0 AS b FROM (SELECT unnest(range(1000)) AS id))")
def source_swiss_roll(spark: SparkSession, root: str) -> DataFrame:
    v = F.col("v")
    return generators.swiss_roll(spark, 1000).select("id", F.round(v[0], 6).alias("x"), F.round(v[1], 6).alias("y"), F.round(v[2], 6).alias("z"))


@query(f"SELECT src, (src + 1 + {_h(5, 'src', 't')} % 999) % 1000 AS dst FROM (SELECT unnest(range(1000)) AS src), (SELECT unnest(range(4)) AS t)")
def source_random_edges(spark: SparkSession, root: str) -> DataFrame:
    return generators.random_edges(spark, 1000, 4, 5)


@query("SELECT regexp_extract(file_name, '([^/]+)$', 1) AS stem, count(*) AS n, max(written_at) AS written_at FROM panel_lines GROUP BY 1")
def asset_inventory(spark: SparkSession, root: str) -> DataFrame:
    p = load(spark, root, "panel_lines")
    return p.groupBy(F.regexp_extract("file_name", "([^/]+)$", 1).alias("stem")).agg(F.count("*").alias("n"), F.max("written_at").alias("written_at"))


# ---- identity, alignment, cohorts


@query(f"WITH {E} SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) - count(DISTINCT id) AS repeats, count(*) FILTER (id < 0) AS negative, count(*) FILTER (id >= 400) AS beyond FROM e")
def id_checks(spark: SparkSession, root: str) -> DataFrame:
    return checks.id_report(points(spark, root), 400)


@query(f"WITH {E}, {Z} SELECT e.id, round(e.v[3], 6) AS v3, round(z.x, 6) AS x FROM e JOIN z USING (id)")
def align_space_and_map(spark: SparkSession, root: str) -> DataFrame:
    """Space and map side by side; an id that only one has is an error."""
    met = checks.align(points(spark, root).select("id", "v"), flat_map(spark, root).select("id", "x"))
    return met.select("id", F.round(F.col("v")[2].cast("double"), 6).alias("v3"), r6("x"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 AND vec_id % 5 = 0 THEN 'shared' ELSE 'missing' END AS finding FROM embeddings WHERE (vec_id % 7 = 0 AND vec_id % 5 = 0) OR (vec_id % 7 <> 0 AND vec_id % 5 <> 0)")
def cohort_partition(spark: SparkSession, root: str) -> DataFrame:
    """Two cohorts against their universe: shared, missing and foreign ids."""
    u = points(spark, root).select("id")
    c = u.where("id % 7 = 0").withColumn("cohort", F.lit("a")).unionByName(u.where("id % 5 = 0").withColumn("cohort", F.lit("b")))
    return checks.cohort_findings(c, u)


@query("SELECT source, count(*) AS n, count(n_chars) AS sized FROM documents GROUP BY source HAVING count(*) <> count(n_chars)")
def shard_alignment(spark: SparkSession, root: str) -> DataFrame:
    """Sources whose texts and lengths aren't row for row."""
    d = load(spark, root, "documents")
    a = d.groupBy("source").agg(F.count("*").alias("n"))
    b = d.where(F.col("n_chars").isNotNull()).groupBy("source").agg(F.count("*").alias("sized"))
    met = a.join(b, a["source"].eqNullSafe(b["source"]), "left").select(a["source"], "n", F.coalesce("sized", F.lit(0).cast("bigint")).alias("sized"))
    return met.where("n != sized")


#: Numbers as whole multiples of 2^-40, which single-precision values of ordinary size are: one text for both engines.
_WHOLE = "list_transform({v}, lambda x: floor(x::DOUBLE * 1099511627776)::BIGINT)"
_ROW_HASH = f"sha256(concat_ws(';', vec_id::VARCHAR, coalesce(label::VARCHAR, 'null'), array_to_string({_WHOLE.format(v='embedding')}, ',')))"


def _row_hash() -> Column:
    whole = F.transform(vec.doubles("embedding"), lambda x: F.floor(x * 2.0**40).cast("bigint").cast("string"))
    return F.sha2(F.concat_ws(";", F.col("vec_id").cast("string"), F.coalesce(F.col("label").cast("string"), F.lit("null")), F.concat_ws(",", whole)), 256)


def _fingerprint(e: DataFrame, rows: int) -> DataFrame:
    hashed = e.where(F.col("vec_id") % max(1, rows // 2048) == 0).select("vec_id", _row_hash().alias("h"))
    return hashed.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "h"))), lambda x: x["h"])), 256).alias("identity"))


_STRIDED = "vec_id % greatest(1, (SELECT count(*) FROM embeddings) // 2048) = 0"


@query(f"SELECT sha256(string_agg(h, '' ORDER BY vec_id)) AS identity FROM (SELECT vec_id, {_ROW_HASH} AS h FROM embeddings WHERE {_STRIDED})")
def data_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """One hash over the vectors of a strided, ordered sample of 2,048 to 4,096 rows, whatever the table's size: it changes if vectors do or move."""
    e = load(spark, root, "embeddings")
    return _fingerprint(e, e.count())


def _marks(pair: str, engine: str) -> str:
    """A sum over hashes of edges, 60 bits each, which any change of an end or a weight moves."""
    return f"sum(('0x' || substr(md5({pair}), 1, 15))::BIGINT::HUGEINT)::VARCHAR" if engine == "duckdb" else f"cast(sum(cast(conv(substr(md5({pair}), 1, 15), 16, 10) AS decimal(20, 0))) AS string)"


@query(f"WITH {E}, {knn_sql('n', 'e', anchors=False)} SELECT count(*) AS edges, min(src) AS first, max(src) AS last, count(DISTINCT src) AS sources, {_marks("src || '>' || dst || ':' || rank", 'duckdb')} AS mark FROM n")
def graph_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Counts, bounds and a mark of a graph's content; its rows' order doesn't matter, their pairing does."""
    return _manifest(space_knn(spark, root, anchors=False))


def _manifest(n: DataFrame) -> DataFrame:
    return n.agg(F.count("*").alias("edges"), F.min("src").alias("first"), F.max("src").alias("last"), F.countDistinct("src").alias("sources"), F.expr(_marks("concat(src, '>', dst, ':', rank)", "spark")).alias("mark"))


_PRINT = f"sha256(string_agg({_ROW_HASH}, '' ORDER BY vec_id) FILTER ({_STRIDED}))"


@query(
    f"""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), s AS (SELECT * FROM e WHERE vec_id <> (SELECT max(vec_id) FROM e)),
    r AS (SELECT vec_id, label, coalesce(lead(embedding) OVER (ORDER BY vec_id), first_value(embedding) OVER (ORDER BY vec_id)) AS embedding FROM e),
    m AS (SELECT count(*) AS n, {_PRINT} AS h FROM e), t AS (SELECT 'same' AS data, count(*) AS n, {_PRINT} AS h FROM e UNION ALL SELECT 'shorter', count(*), {_PRINT} FROM s UNION ALL SELECT 'rotated', count(*), {_PRINT} FROM r)
    SELECT data, CASE WHEN t.n <> m.n THEN 'length' WHEN t.h = m.h THEN 'ok' ELSE 'content' END AS verdict FROM t, m"""
)
def manifest_check(spark: SparkSession, root: str) -> DataFrame:
    """A manifest of the embeddings held against them, against a table that lacks a row, and against one whose vectors have moved by one."""
    e = stage(load(spark, root, "embeddings").select("vec_id", "label", "embedding"), "embeddings")
    n = e.count()
    manifest = {"rows": n, "identity": _fingerprint(e, n).first()[0]}
    ids = sampling.positions(e.select("vec_id"), ["vec_id"])
    moved = ids.join(e, "vec_id").select("vec_id", "label", "pos").join(ids.join(e, "vec_id").select(F.pmod(F.col("pos") - 1, F.lit(n)).alias("pos"), "embedding"), "pos")
    last = e.agg(F.max("vec_id")).first()[0]
    found = [(name, checks.against_manifest(df, manifest, lambda d: _fingerprint(d, n).first()[0])) for name, df in (("same", e), ("shorter", e.where(F.col("vec_id") != last)), ("rotated", moved))]
    return spark.createDataFrame(found, "data string, verdict string")


@query()
def file_identity(spark: SparkSession, root: str) -> DataFrame:
    """Name, size and SHA-256 of every file of a folder's embeddings, read in pieces where it lies."""
    return artefacts.file_identity(spark, f"{root}/embeddings.parquet")


# ---- duplicates

_PRINTS = "p AS (SELECT doc_id AS id, substr(sha256(text), 1, 32) AS h FROM documents WHERE text IS NOT NULL)"
_FAM = f"WITH {_PRINTS}, f AS (SELECT h, min(id) AS first, count(*) AS n FROM p GROUP BY h HAVING count(*) > 1)"


def _prints(spark: SparkSession, root: str) -> DataFrame:
    return dedup.fingerprints(load(spark, root, "documents"), "doc_id", "text")


@query(f"WITH {_PRINTS} SELECT id, h FROM p")
def row_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return _prints(spark, root)


@query(f"{_FAM} SELECT first, n FROM f")
def duplicate_families(spark: SparkSession, root: str) -> DataFrame:
    return dedup.families(_prints(spark, root)).select("first", "n")


@query(f"{_FAM} SELECT count(*) AS families, sum(n)::BIGINT AS members, sum(n - 1)::BIGINT AS copies, max(n) AS largest, round(sum(n - 1)::DOUBLE / (SELECT count(*) FROM documents), 6) AS share FROM f")
def duplicate_summary(spark: SparkSession, root: str) -> DataFrame:
    return dedup.family_summary(dedup.families(_prints(spark, root)), load(spark, root, "documents").count())


@query(f"{_FAM} SELECT n AS size, count(*) AS families FROM f GROUP BY n")
def duplicate_histogram(spark: SparkSession, root: str) -> DataFrame:
    return dedup.family_histogram(dedup.families(_prints(spark, root)))


@query(f"{_FAM} SELECT id, first, id = first AS kept FROM p JOIN f USING (h)")
def duplicate_cap(spark: SparkSession, root: str) -> DataFrame:
    return dedup.cap_one(_prints(spark, root))


@query(f"{_FAM} SELECT 0::BIGINT AS wrong_families, sum(n)::BIGINT AS members, sum(n - 1)::BIGINT AS excluded, 0::BIGINT AS gap FROM f")
def duplicate_cap_check(spark: SparkSession, root: str) -> DataFrame:
    return dedup.cap_report(dedup.cap_one(_prints(spark, root)))


@query(f"{_FAM} SELECT first, n FROM f ORDER BY n DESC, first LIMIT 50")
def duplicate_top(spark: SparkSession, root: str) -> DataFrame:
    return dedup.top_families(dedup.families(_prints(spark, root)), 50).select("first", "n")


@query("SELECT round(embedding[1]::DOUBLE, 1) + 0.0 AS x, round(embedding[2]::DOUBLE, 1) + 0.0 AS y, count(*) AS n FROM embeddings GROUP BY 1, 2 ORDER BY n DESC, x, y LIMIT 10")
def repeated_coordinates(spark: SparkSession, root: str) -> DataFrame:
    """The places of a coarse map that hold most rows."""
    z = flat_map(spark, root).select(F.round("x", 1).alias("x"), F.round("y", 1).alias("y"))
    return z.groupBy("x", "y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x", "y").limit(10)


@query("SELECT testbed_id, row_id, count(*) AS n, min(delivery_id) AS kept FROM testbed_rows GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_deliveries(spark: SparkSession, root: str) -> DataFrame:
    t = load(spark, root, "testbed_rows")
    return t.groupBy("testbed_id", "row_id").agg(F.count("*").alias("n"), F.min("delivery_id").alias("kept")).where("n > 1")


@query(f"{_FAM}, x AS (SELECT id FROM p JOIN f USING (h) WHERE id <> first), n AS (SELECT vec_id AS src, (vec_id * 7 + 3) % 500 AS dst FROM embeddings) SELECT src, dst FROM n WHERE src NOT IN (SELECT id FROM x)")
def excluded_sources(spark: SparkSession, root: str) -> DataFrame:
    """Edges without those whose source is an excluded copy."""
    e = load(spark, root, "embeddings").select(F.col("vec_id").alias("src"), ((F.col("vec_id") * 7 + 3) % 500).alias("dst"))
    return dedup.without_excluded(e, dedup.cap_one(_prints(spark, root)))


# ---- samples


@query(f"SELECT vec_id AS id FROM embeddings ORDER BY {_h(7, 'vec_id')}, vec_id LIMIT 100")
def sample_rows(spark: SparkSession, root: str) -> DataFrame:
    return sampling.sample(points(spark, root).select("id"), 100, 7)


@query(f"SELECT vec_id AS id, CASE WHEN {_u(3, 'vec_id')} < 0.8 THEN 'train' ELSE 'test' END AS part FROM embeddings")
def train_test_split(spark: SparkSession, root: str) -> DataFrame:
    return sampling.split(points(spark, root), 0.8, 3).select("id", "part")


@query(f"SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 <> 0 ORDER BY {_h(9, 'vec_id')}, vec_id LIMIT 50")
def held_out_sample(spark: SparkSession, root: str) -> DataFrame:
    p = points(spark, root).select("id")
    return sampling.complement_sample(p, p.where("id % 3 = 0"), 50, 9)


_EDGES = f"WITH {E}, {knn_sql('n', 'e', anchors=False)}"


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return space_knn(spark, root, anchors=False)


@query(f"{_EDGES}, w AS (SELECT src, dst, round(1 - dist / 2, 6) AS weight FROM n) SELECT src, dst, weight FROM w ORDER BY round(-ln({_u(11, 'src', 'dst')}) / weight, 9), src, dst LIMIT 200")
def weighted_edge_sample(spark: SparkSession, root: str) -> DataFrame:
    w = _edges(spark, root).select("src", "dst", F.round(1 - F.col("dist") / 2, 6).alias("weight"))
    return sampling.weighted_sample(w, 200, 11)


@query(
    f"""{_EDGES}, w AS (SELECT src, dst, 1.0::DOUBLE AS weight FROM n), s AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS i, count(*) OVER () AS n FROM w), d AS (SELECT draw, {_u(13, 'draw')} AS u FROM (SELECT unnest(range(500)) AS draw))
    SELECT draw, src, dst FROM d JOIN s ON floor(u * n) + 1 = i"""
)
def edge_draws(spark: SparkSession, root: str) -> DataFrame:
    """Draws with replacement by inverse distribution, here of equal weights."""
    w = _edges(spark, root).select("src", "dst", F.lit(1.0).alias("weight"))
    return sampling.draws_by_mass(graph.running_mass(w), 500, 13)


@query(f"{_EDGES}, s AS (SELECT count(*) AS m FROM e) SELECT src, (src + 1 + {_h(17, 'src', 'dst')} % (m - 1)) % m AS dst FROM n, s")
def negatives_offset(spark: SparkSession, root: str) -> DataFrame:
    return sampling.offset_negatives(_edges(spark, root), points(spark, root).count(), 17)


@query(
    f"""{_EDGES}, s AS (SELECT count(*) AS m FROM e), c AS (SELECT src, dst, min(t) AS t FROM (SELECT id AS src, t, {_h(19, 'id', 't')} % m AS dst FROM e, s, (SELECT unnest(range(20)) AS t)) WHERE src <> dst GROUP BY src, dst)
    SELECT src, dst FROM (SELECT c.src, c.dst, row_number() OVER (PARTITION BY c.src ORDER BY t) AS r FROM c ANTI JOIN n ON n.src = c.src AND n.dst = c.dst) WHERE r <= 5"""
)
def negatives_rejected(spark: SparkSession, root: str) -> DataFrame:
    """Five negatives of every node that are neither itself nor its neighbours."""
    p = points(spark, root)
    return sampling.rejected_negatives(p, _edges(spark, root), p.count(), 5, 19)


@query(
    f"""{_EDGES}, s AS (SELECT count(*) AS m FROM e), g AS (SELECT src, (src + 1 + {_h(17, 'src', 'dst')} % (m - 1)) % m AS dst FROM n, s),
    p AS (SELECT src, dst, row_number() OVER (ORDER BY {_h(23, 'src', 'dst')}, src, dst) - 1 AS i FROM n), q AS (SELECT src, dst, row_number() OVER (ORDER BY {_h(24, 'src', 'dst')}, src, dst) - 1 AS i FROM (SELECT DISTINCT src, dst FROM g))
    SELECT batch, target, count(*) AS n FROM (SELECT i // 32 AS batch, 1.0::DOUBLE AS target FROM p UNION ALL SELECT i // 96, 0.0::DOUBLE FROM q) GROUP BY batch, target"""
)
def balanced_batches(spark: SparkSession, root: str) -> DataFrame:
    """Batches of 128 edges, a quarter of them positive."""
    e = _edges(spark, root).select("src", "dst")
    g = sampling.offset_negatives(e, points(spark, root).count(), 17).distinct()
    b = sampling.labelled_batches(e, g, 128, 0.25, 23)
    return b.groupBy(F.col("batch").cast("long").alias("batch"), "target").agg(F.count("*").alias("n"))


@query(
    f"""WITH {E}, s AS (SELECT count(*) AS m FROM e), c AS (SELECT id AS src, t, (id + 1 + {_h(29, 'id', 't')} % (m - 1)) % m AS dst FROM e, s, (SELECT unnest(range(6)) AS t)),
    r AS (SELECT c.src, c.dst, row_number() OVER (PARTITION BY c.src ORDER BY round(list_distance(a.v, b.v), 9), c.dst, t) AS r FROM c JOIN e a ON a.id = c.src JOIN e b ON b.id = c.dst) SELECT src, dst FROM r WHERE r = 2"""
)
def mid_near_pairs(spark: SparkSession, root: str) -> DataFrame:
    p = points(spark, root)
    return sampling.mid_near(p, p.count(), 29)


@query(f"WITH {Z} SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM z ORDER BY {_h(31, 'id')}, id LIMIT 40")
def landmarks(spark: SparkSession, root: str) -> DataFrame:
    """Landmark rows with their teacher coordinates."""
    return sampling.sample(flat_map(spark, root), 40, 31).select("id", r6("x"), r6("y"))


@query(f"WITH {_DENSE}, n AS (SELECT count(*) AS n FROM d), w AS (SELECT DISTINCT floor(i * (n - 1) / 24) AS id FROM n, (SELECT unnest(range(25)) AS i)) SELECT d.id FROM d JOIN w USING (id)")
def evenly_spaced_rows(spark: SparkSession, root: str) -> DataFrame:
    return sampling.evenly_spaced(_dense(spark, root).select("id"), 25)


#: Rows of an aligned chunk of adjacent row ids.
CHUNK = 64


@query(
    f"""WITH r AS (SELECT DISTINCT testbed_id, row_id FROM testbed_rows WHERE testbed_id IS NOT NULL AND row_id IS NOT NULL), c AS (SELECT testbed_id, row_id // {CHUNK} AS chunk, count(*) AS n FROM r GROUP BY 1, 2),
    b AS (SELECT testbed_id, chunk FROM c QUALIFY row_number() OVER (PARTITION BY testbed_id ORDER BY {_h(67, 'testbed_id', 'chunk')}, chunk) = 1) SELECT r.testbed_id, r.row_id FROM r JOIN b ON b.testbed_id = r.testbed_id AND b.chunk = r.row_id // {CHUNK}"""
)
def calibration_window(spark: SparkSession, root: str) -> DataFrame:
    """A seeded choice of one aligned chunk of adjacent rows for every testbed."""
    r = load(spark, root, "testbed_rows").select("testbed_id", "row_id").dropna().distinct().withColumn("chunk", F.floor(F.col("row_id") / CHUNK))
    order = F.struct(sampling.hash_number(67, F.col("testbed_id"), F.col("chunk")).alias("h"), "chunk")
    chosen = r.select("testbed_id", "chunk").distinct().groupBy("testbed_id").agg(F.min(order).alias("o")).select("testbed_id", F.col("o.chunk").alias("chunk"))
    return r.join(chosen, ["testbed_id", "chunk"]).select("testbed_id", "row_id")


# ---- aggregates and profiles


@query("SELECT 'lang' AS name, count(DISTINCT lang) AS distinct_n, min(lang) AS lowest, max(lang) AS highest FROM documents UNION ALL SELECT 'source', count(DISTINCT source), min(source), max(source) FROM documents UNION ALL SELECT 'round_no', count(DISTINCT round_no), min(round_no)::VARCHAR, max(round_no)::VARCHAR FROM documents")
def column_profile(spark: SparkSession, root: str) -> DataFrame:
    """Distinct values and extent of columns, all in one pass."""
    d = load(spark, root, "documents")
    names = ("lang", "source", "round_no")
    one = d.agg(*[F.struct(F.lit(c).alias("name"), F.countDistinct(c).alias("distinct_n"), F.min(c).cast("string").alias("lowest"), F.max(c).cast("string").alias("highest")).alias(c) for c in names])
    return one.select(F.explode(F.array(*names)).alias("r")).select("r.*")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def value_counts(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT round(quantile_cont(n_chars, 0.01), 4) AS p1, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.95), 4) AS p95, round(quantile_cont(n_chars, 0.99), 4) AS p99, max(n_chars) AS most FROM documents")
def length_percentiles(spark: SparkSession, root: str) -> DataFrame:
    p = lambda q, name: F.round(F.percentile("n_chars", F.lit(q)), 4).alias(name)
    return load(spark, root, "documents").agg(p(0.01, "p1"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"), F.max("n_chars").alias("most"))


@query("WITH p AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q), t AS (SELECT q, quantile_cont(n_chars, 0.1) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.9) AS c FROM documents, p GROUP BY q), v AS (SELECT q, CASE WHEN q < 0.2 THEN a WHEN q < 0.6 THEN b ELSE c END AS target FROM t) SELECT q, arg_min(doc_id, (abs(n_chars - target), doc_id)) AS doc_id FROM v, documents WHERE n_chars IS NOT NULL GROUP BY q")
def length_regimes(spark: SparkSession, root: str) -> DataFrame:
    """The row nearest each percentile of length."""
    d = load(spark, root, "documents").where(F.col("n_chars").isNotNull())
    qs = (0.1, 0.5, 0.9)
    t = d.agg(F.percentile("n_chars", F.array(*[F.lit(q) for q in qs])).alias("p")).select(F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in qs]).alias("q"), F.col("p"))).alias("t"))
    t = t.select(F.col("t.q").alias("q"), F.col("t.p").alias("target"))
    return d.crossJoin(F.broadcast(t)).groupBy("q").agg(F.min_by("doc_id", F.struct(F.abs(F.col("n_chars") - F.col("target")), F.col("doc_id"))).alias("doc_id"))


# ---- texts and registries


@query("SELECT doc_id, trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN length(flat) > 40 THEN rtrim(substr(flat, 1, 37), ' ') || '...' ELSE flat END AS label FROM (SELECT doc_id, source, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS flat FROM documents)")
def slugs(spark: SparkSession, root: str) -> DataFrame:
    d = load(spark, root, "documents")
    return d.select("doc_id", words.slug(F.col("source")).alias("slug"), words.short_label(F.col("text"), 40).alias("label"))


@query("SELECT doc_id, 'search_document: ' || text AS prompted FROM documents")
def prompt_prefix(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "documents").select("doc_id", words.with_prefix("search_document: ", F.col("text")).alias("prompted"))


_EVENTS = "ev AS (SELECT DISTINCT registry_id, e.event_id AS event_id, e.evidence_id AS evidence_id, lower(e.status) AS status, e.recorded_utc AS recorded_utc, coalesce(e.diagnostic_only, false) AS diagnostic, len(list_filter(e.superseded_by, lambda x: x IS NOT NULL)) AS superseded FROM (SELECT registry_id, unnest(events) AS e FROM status_registry) WHERE e.event_id IS NOT NULL)"


def _events(spark: SparkSession, root: str) -> DataFrame:
    e = load(spark, root, "status_registry").select("registry_id", F.explode("events").alias("e")).where("e.event_id IS NOT NULL")
    n = F.size(F.filter("e.superseded_by", lambda x: x.isNotNull()))
    return e.select("registry_id", "e.event_id", "e.evidence_id", F.lower("e.status").alias("status"), "e.recorded_utc", F.coalesce("e.diagnostic_only", F.lit(False)).alias("diagnostic"), F.when(F.col("e.superseded_by").isNotNull(), n).cast("long").alias("superseded")).distinct()


@query(f"WITH {_EVENTS} SELECT registry_id, event_id, evidence_id FROM ev WHERE status = 'accepted' AND NOT diagnostic AND coalesce(superseded, 0) = 0")
def evidence_discovery(spark: SparkSession, root: str) -> DataFrame:
    """Evidence that is accepted, not only diagnostic, and not superseded."""
    return _events(spark, root).where("status = 'accepted' AND NOT diagnostic AND coalesce(superseded, 0) = 0").select("registry_id", "event_id", "evidence_id")


@query(f"WITH {_EVENTS} SELECT registry_id, evidence_id, event_id, status FROM ev WHERE evidence_id IS NOT NULL AND recorded_utc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY registry_id, evidence_id ORDER BY recorded_utc DESC, event_id DESC) = 1")
def evidence_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest event of each evidence of a registry."""
    e = _events(spark, root).where("evidence_id IS NOT NULL AND recorded_utc IS NOT NULL")
    return dedup.latest(e, ["registry_id", "evidence_id"], ["recorded_utc", "event_id"]).select("registry_id", "evidence_id", "event_id", "status")


@query(f"WITH {_EVENTS} SELECT status, diagnostic, count(*) AS n FROM ev GROUP BY status, diagnostic")
def evidence_statuses(spark: SparkSession, root: str) -> DataFrame:
    return _events(spark, root).groupBy("status", "diagnostic").agg(F.count("*").alias("n"))


_RUNS = """b AS (SELECT DISTINCT stream, file_name, written_at, body FROM panel_lines WHERE json_valid(body)), r AS (SELECT stream, file_name, written_at, json_extract_string(body, '$.run_dir') AS run_dir, try_cast(json_extract_string(body, '$.ffr') AS DOUBLE) AS ffr, json_extract_string(body, '$.formula_version') AS version FROM b),
    l AS (SELECT * FROM (SELECT DISTINCT stream, run_dir, written_at, ffr FROM r WHERE ffr IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY stream, run_dir ORDER BY written_at DESC, ffr DESC) = 1),
    a AS (SELECT stream, run_dir, regexp_extract(run_dir, '^map_(.*)_s([0-9]+)_', 1) AS arm, try_cast(regexp_extract(run_dir, '^map_(.*)_s([0-9]+)_', 2) AS INTEGER) AS seed, ffr FROM l)"""


def _runs(spark: SparkSession, root: str) -> DataFrame:
    """The newest score of each run of a stream, with its arm and seed."""
    p = load(spark, root, "panel_lines").select("stream", "file_name", "written_at", F.try_parse_json("body").alias("v"))
    r = p.select("stream", "written_at", F.try_variant_get("v", "$.run_dir", "string").alias("run_dir"), F.try_variant_get("v", "$.ffr", "double").alias("ffr")).where("ffr IS NOT NULL").distinct()
    last = dedup.latest(r, ["stream", "run_dir"], ["written_at", "ffr"])
    label = F.regexp_replace(F.regexp_replace("run_dir", "^map_", ""), "_[^_]*$", "")
    return last.select("stream", "run_dir", words.arm(label).alias("arm"), words.seed(label).alias("seed"), "ffr")


@query(f"WITH {_RUNS} SELECT stream, run_dir, arm, seed, round(ffr, 6) AS ffr FROM a")
def run_scores(spark: SparkSession, root: str) -> DataFrame:
    """One row for each run: its newest score, arm and seed."""
    return _runs(spark, root).select("stream", "run_dir", "arm", "seed", r6("ffr"))


@query(f"WITH {_RUNS} SELECT arm, count(*) AS n, round(avg(ffr), 6) AS mean FROM a GROUP BY arm")
def arm_means(spark: SparkSession, root: str) -> DataFrame:
    return _runs(spark, root).groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("ffr"), 6).alias("mean"))


_DELTA = "m AS (SELECT arm, seed, avg(ffr) AS ffr FROM a GROUP BY arm, seed), d AS (SELECT o.arm, o.ffr - b.ffr AS delta FROM m o JOIN m b ON o.seed = b.seed AND b.arm = 'plain_lp' AND o.arm <> b.arm)"


def _deltas(spark: SparkSession, root: str) -> DataFrame:
    m = _runs(spark, root).groupBy("arm", "seed").agg(F.avg("ffr").alias("ffr"))
    b = m.where("arm = 'plain_lp'").select("seed", F.col("ffr").alias("base"))
    return m.where("arm != 'plain_lp'").join(b, "seed").select("arm", (F.col("ffr") - F.col("base")).alias("delta"))


@query(f"WITH {_RUNS}, {_DELTA} SELECT arm, count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd FROM d GROUP BY arm")
def paired_deltas(spark: SparkSession, root: str) -> DataFrame:
    """Seed-wise differences of each arm and the base arm."""
    return _deltas(spark, root).groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean"), F.round(F.stddev_samp("delta"), 6).alias("sd"))


@query(f"WITH {_RUNS}, {_DELTA} SELECT arm, CASE WHEN count(*) < 2 THEN 'escalate' WHEN round(avg(delta), 6) - round(stddev_samp(delta), 6) > 0 THEN 'adopt' WHEN round(avg(delta), 6) + round(stddev_samp(delta), 6) < 0 THEN 'reject' ELSE 'escalate' END AS decision FROM d GROUP BY arm")
def arm_decisions(spark: SparkSession, root: str) -> DataFrame:
    """Thresholded decisions from paired differences."""
    s = paired_deltas(spark, root)
    decision = F.when(F.col("n") < 2, "escalate").when(F.col("mean") - F.col("sd") > 0, "adopt").when(F.col("mean") + F.col("sd") < 0, "reject").otherwise("escalate")
    return s.select("arm", decision.alias("decision"))


@query(f"WITH {_RUNS} SELECT seed, round(avg(ffr) FILTER (arm = 'plain_lp') + 1e-9, 6) AS plain_lp, round(avg(ffr) FILTER (arm = 'prompted') + 1e-9, 6) AS prompted, round(avg(ffr) FILTER (arm = 'fitted_curve') + 1e-9, 6) AS fitted_curve FROM a GROUP BY seed")
def comparison_table(spark: SparkSession, root: str) -> DataFrame:
    """Scores by seed and arm as a wide table."""
    arms = ["plain_lp", "prompted", "fitted_curve"]
    wide = _runs(spark, root).groupBy("seed").pivot("arm", arms).agg(F.round(F.avg("ffr") + 1e-9, 6))
    return wide.select("seed", *arms)


@query(
    f"""WITH {_RUNS}, v AS (SELECT stream, file_name, max(version) FILTER (version IS NOT NULL) AS version, max(written_at) AS t FROM r GROUP BY stream, file_name), p AS (SELECT stream, file_name, version, lag(version) OVER (PARTITION BY stream ORDER BY t, file_name) AS before FROM v)
    SELECT stream, file_name, version, before FROM p WHERE version IS DISTINCT FROM before AND before IS NOT NULL"""
)
def config_changes(spark: SparkSession, root: str) -> DataFrame:
    """Files whose formula version differs from the file before."""
    p = load(spark, root, "panel_lines").select("stream", "file_name", "written_at", F.try_parse_json("body").alias("v")).where("v IS NOT NULL")
    v = p.groupBy("stream", "file_name").agg(F.max(F.try_variant_get("v", "$.formula_version", "string")).alias("version"), F.max("written_at").alias("t"))
    w = Window.partitionBy("stream").orderBy("t", "file_name")
    return v.withColumn("before", F.lag("version").over(w)).where(~F.col("version").eqNullSafe(F.col("before")) & F.col("before").isNotNull()).select("stream", "file_name", "version", "before")


# ---- models


@query()
def kmeans_cells(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each cell after Lloyd's rounds."""
    p = points(spark, root)
    return knn.centroid_labels(p, knn.lloyd(p, 10, 10)).groupBy("cid").agg(F.count("*").alias("n"))


def _weights() -> projector.Projector:
    """Fixed weights that SQL can state too: sines of the places."""
    w1 = np.sin(np.arange(1, 65)[:, None] * np.arange(1, 9)[None, :])
    w2 = np.cos(np.arange(1, 9)[:, None] * np.arange(1, 3)[None, :])
    return projector.Projector([w1, w2], [np.zeros(8), np.zeros(2)])


@query(f"WITH {E}, h AS (SELECT id, k, greatest(list_sum(list_transform(range(1, 65), lambda d: v[d] * sin(d * k))), 0) AS h FROM e, (SELECT unnest(range(1, 9)) AS k)) SELECT id, round(sum(h * cos(k)), 6) AS x, round(sum(h * cos(k * 2)), 6) AS y FROM h GROUP BY id")
def projector_transform(spark: SparkSession, root: str) -> DataFrame:
    """A perceptron applied to every row."""
    return projector.transform(points(spark, root), _weights()).select("id", r6("x"), r6("y"))


@query()
def projector_fit(spark: SparkSession, root: str) -> DataFrame:
    """A projector trained on PCA anchors, then fitted to the fuzzy graph while some are held: losses, recall and the drift of those kept aside."""
    p = stage(points(spark, root), "points")
    n = stage(space_knn(spark, root, anchors=False), "near")
    e = graph.t_conorm(graph.memberships(n, graph.sigmas(n, K)))
    anchors = stage(metrics.pca_map(p, 64, 5.0).select("id", "x", "y"), "anchors")
    held, aside = projector.split_anchors(anchors.where(F.col("id") % 10 == 0), 0.2)
    model, _ = projector.pretrain(p, anchors, projector.Projector.fresh(64, 64, 2))
    model, losses = projector.fit(p, e, model, terms=projector.Terms(hold=0.1), anchors=stage(held, "held"))
    places = stage(projector.transform(p, model), "places")
    z = metrics.as_points(places)
    r = knn.recall(knn.exact_knn(asked(z), z, K), n.where(F.col("src") % ASK == 0), K).agg(F.round(F.avg("recall"), 4).alias("recall"))
    moved = places.join(aside.withColumnsRenamed({"x": "tx", "y": "ty"}), "id").agg(F.round(F.avg(F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))), 4).alias("drift"))
    return r.crossJoin(moved).select("recall", "drift", F.lit(round(losses[0], 4)).alias("first_loss"), F.lit(round(losses[-1], 4)).alias("last_loss"))


@query()
def probe_gap(spark: SparkSession, root: str) -> DataFrame:
    """Accuracy of a linear probe for labels in the space and in the map, on held-out rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    p = points(spark, root).withColumn("label", F.col("label").cast("double"))

    def accuracy(df: DataFrame, name: str) -> DataFrame:
        rows = sampling.split(df.select("id", "label", array_to_vector(vec.doubles("v")).alias("features")), 0.7, 5)
        model = LogisticRegression(maxIter=30, regParam=1e-3).fit(rows.where("part = 'train'"))
        return model.transform(rows.where("part = 'test'")).agg(F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 6).alias(name))

    z = metrics.as_points(flat_map(spark, root)).join(p.select("id", "label"), "id")
    both = accuracy(p, "space").crossJoin(accuracy(z, "map"))
    return both.withColumn("gap", F.round(F.col("space") - F.col("map"), 6))


#: Rows of the sample that eigenspaces are compared on; smaller tables are taken whole.
SPECTRAL = 10_000


@query()
def grassmann_score(spark: SparkSession, root: str) -> DataFrame:
    """Agreement of the leading Laplacian eigenspaces of space and map, on a sample of at most SPECTRAL rows on the driver."""
    return _grassmann(spark, root, SPECTRAL)


def _grassmann(spark: SparkSession, root: str, size: int) -> DataFrame:
    p = sampling.sample(points(spark, root), size, 37).select("id", "v")
    z = metrics.as_points(flat_map(spark, root)).join(p.select("id"), "id", "left_semi")

    def basis(df: DataFrame, t: int = 10) -> np.ndarray:
        e = graph.either_way(knn.exact_knn(df, df, 15)).toPandas()
        at = {i: n for n, i in enumerate(sorted(set(e["src"])))}
        a = np.zeros((len(at), len(at)))
        a[[at[i] for i in e["src"]], [at[i] for i in e["dst"]]] = 1
        d = 1 / np.sqrt(a.sum(1))
        return np.linalg.eigh(np.eye(len(a)) - d[:, None] * a * d[None, :])[1][:, 1 : t + 1]

    angles = np.linalg.svd(basis(p).T @ basis(z), compute_uv=False)
    return spark.range(1).select(F.lit(round(float((angles**2).mean()), 6)).alias("score"))
