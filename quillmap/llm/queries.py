"""Queries of the operators for training data, and the same as SQL where SQL can say it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions.random import philox_sql
from quillmap.llm.clusters import SimilarityClusters, similarity_clusters
from quillmap.llm.leaks import leaked_passages, leaks
from quillmap.llm.neighbours import nearest_vectors
from quillmap.llm.pieces import split_documents
from quillmap.llm.stable_sample import audit_receipts, stable_sample
from quillmap.llm.tokens import encode_corpus
from quillmap.session import load, shared_dir

SEED, ANCHOR_SEED, TARGET = 42, 1001, 100
WIDTH, K_HIT = 96, 10
LINKED, SMALLEST, TYPICAL = 0.85, 5, 5


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return audit_receipts(load(spark, root, "sample_receipts"))


def p1_sample(spark: SparkSession, root: str) -> DataFrame:
    """The stable sample of every testbed, about TARGET rows of its first snapshot.

    Ledger and rates of the folder's table are kept in the shared folder, or where ``quillmap.sample.state`` says.
    """
    base = spark.conf.get("quillmap.sample.state", None) or f"{shared_dir(spark)}/quillmap-samples"
    state = f"{base}/{hashlib.sha256(root.encode()).hexdigest()[:16]}-{TARGET}"
    return stable_sample(load(spark, root, "testbed_rows"), ["testbed_id"], "row_id", "snapshot_no", SEED, ANCHOR_SEED, TARGET, state)


def p4_neighbors(spark: SparkSession, root: str) -> DataFrame:
    """The ten most similar corpus vectors of every corpus and query vector, with similarity and rank."""
    return nearest_vectors(load(spark, root, "probe_corpus"), "vec_id", "corpus_vector", WIDTH, K_HIT, load(spark, root, "probe_queries"), "query_id", "query_vector")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_neighbors(spark, root).select("side", F.col("id").alias("vec_id"), F.col("neighbor").alias("neighbor_id"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    found = similarity_clusters(load(spark, root, "probe_corpus"), "vec_id", "corpus_vector", WIDTH, LINKED, SMALLEST)
    return found.select(F.col("i").alias("vec_id"), F.col("first").alias("first_vec_id"))


def p5_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Each cluster's size, medoid and most typical members."""
    clusters = SimilarityClusters(load(spark, root, "probe_corpus"), "vec_id", "corpus_vector", WIDTH, LINKED)
    found = clusters.described(SMALLEST, TYPICAL)
    return found.select(F.col("first").alias("first_vec_id"), "size", "medoid", F.concat_ws(",", F.col("typical").cast("array<string>")).alias("typical"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_corpus(load(spark, root, "documents"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks(load(spark, root, "documents"), load(spark, root, "eval_items"))


def p7_overlaps(spark: SparkSession, root: str) -> DataFrame:
    """Every overlap a seed hits, with its longest run and its words followed over substitutions."""
    return leaked_passages(load(spark, root, "documents"), load(spark, root, "eval_items"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    cut = split_documents(load(spark, root, "documents"), oversized_only=True)
    return cut.where(F.col("piece_no") == 1).select("doc_id")


def p8_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of all documents; those within the limit are one piece."""
    return split_documents(load(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_sample, p4_found, p4_neighbors, p5_found, p5_clusters, p6_ids, p7_found, p7_overlaps, p8_found, p8_pieces)}

_KEY = "SELECT x0 FROM (" + philox_sql(str(SEED), str(ANCHOR_SEED), "(SELECT 1 AS one)", "one", words=True) + ")"

SQL: dict[str, str] = {
    "p1_found": """
        WITH r AS (SELECT DISTINCT receipt_id, testbed_id, seed, anchor_seed, snapshot_no, list_sort(list_distinct(sample_indices)) AS rows_ FROM sample_receipts WHERE seed IS NOT NULL)
        SELECT a.receipt_id AS receipt_a, b.receipt_id AS receipt_b
        FROM r a JOIN r b ON a.testbed_id = b.testbed_id AND a.seed = b.seed AND a.anchor_seed = b.anchor_seed AND a.receipt_id < b.receipt_id
        WHERE CASE WHEN a.snapshot_no = b.snapshot_no THEN a.rows_ <> b.rows_
                   WHEN a.snapshot_no < b.snapshot_no THEN NOT list_has_all(b.rows_, a.rows_)
                   ELSE NOT list_has_all(a.rows_, b.rows_) END""",
    "p1_sample": f"""
        WITH ledger AS (SELECT testbed_id, row_id, min(snapshot_no) AS first_epoch FROM testbed_rows
                        WHERE testbed_id IS NOT NULL AND row_id IS NOT NULL AND snapshot_no IS NOT NULL GROUP BY 1, 2),
             sizes AS (SELECT testbed_id, first_epoch, count(*) AS n FROM ledger GROUP BY 1, 2),
             rates AS (SELECT testbed_id, first_epoch, least(1.0::DOUBLE, {float(TARGET)}::DOUBLE / sum(n) OVER (PARTITION BY testbed_id ORDER BY first_epoch)) AS rate FROM sizes),
             seeded AS ({_KEY}),
             drawn AS ({philox_sql("row_id", "x0", "ledger, seeded", "testbed_id, row_id, first_epoch")})
        SELECT testbed_id, row_id, first_epoch, rate FROM drawn JOIN rates USING (testbed_id, first_epoch) WHERE draw < rate""",
}

_COSINE = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_USABLE = "len({v}) = 96 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"
_CORPUS = f"c AS MATERIALIZED (SELECT vec_id AS id, corpus_vector::DOUBLE[] AS v FROM probe_corpus WHERE {_USABLE.format(v='corpus_vector')})"
_ASKED = f"q AS MATERIALIZED (SELECT query_id AS id, query_vector::DOUBLE[] AS v FROM probe_queries WHERE {_USABLE.format(v='query_vector')})"

#: The ten nearest by brute force: equal to the index where one block holds all vectors, as in the small tables.
SQL["p4_found"] = f"""
    WITH {_CORPUS}, {_ASKED},
    s AS (SELECT 'corpus' AS side, a.id, b.id AS other, round({_COSINE}, 12) AS s FROM c a JOIN c b ON a.id <> b.id UNION ALL SELECT 'query', a.id, b.id, round({_COSINE}, 12) FROM q a, c b)
    SELECT side, id AS vec_id, other AS neighbor_id FROM s QUALIFY row_number() OVER (PARTITION BY side, id ORDER BY s DESC, other) <= {K_HIT}"""

SQL["p5_found"] = f"""
    WITH RECURSIVE {_CORPUS},
    l AS MATERIALIZED (SELECT a.id AS s, b.id AS t FROM c a JOIN c b ON a.id > b.id AND {_COSINE} >= {LINKED}), u AS MATERIALIZED (SELECT s, t FROM l UNION SELECT t, s FROM l),
    r(node, other) AS (SELECT id, id FROM c UNION SELECT r.node, u.t FROM r JOIN u ON u.s = r.other),
    k AS (SELECT node, min(other) AS first FROM r GROUP BY node), n AS (SELECT first, count(*) AS n FROM k GROUP BY first HAVING count(*) >= {SMALLEST})
    SELECT node AS vec_id, first AS first_vec_id FROM k JOIN n USING (first)"""
