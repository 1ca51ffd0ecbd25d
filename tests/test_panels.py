"""Panels on a table so large that the fixed fraction is more than the ten neighbours of recall."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import artefacts, checks, graph, knn
from quillmap.plans import quality, registry, tables
from tests.test_queries import canonical

N = 14_000


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('panel')}"
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 4)) * 2
    x = centres[rng.integers(0, 20, N)] + rng.normal(size=(N, 4))
    rows = [(i, [float(a) for a in v], i % 20) for i, v in enumerate(x.astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["fixed_fraction_recall", "region_purity", "decision_panel", "out_of_domain_panel", "data_fingerprint", "manifest_check"])
def test_share_of_a_large_table(spark, root, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{root.removeprefix('file://')}/embeddings.parquet/*.parquet'")
    cursor = db.execute(registry.SQL[name])
    df = registry.QUERIES[name](spark, root)
    want = canonical([c[0] for c in cursor.description], cursor.fetchall())
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


def test_the_share_differs_from_the_hits():
    assert quality._frac(N) == math.ceil(N / 1000) > quality.K and quality._frac(500) == quality.K
    assert quality._frac(N, quality.K_OUTSIDE, quality.K_FRAC_OUTSIDE) == N // 100 > quality.K_OUTSIDE


def test_unsound_maps_are_refused(spark, tmp_path):
    flat = f"file://{tmp_path}/flat"
    spark.createDataFrame([(i, [1.0, 1.0, float(i)], 0) for i in range(60)], "vec_id long, embedding array<float>, label int").write.parquet(f"{flat}/embeddings.parquet")
    with pytest.raises(ValueError, match="can't be scored"):
        quality.decision_panel(spark, flat)


def test_files_have_identities(spark, root):
    from pathlib import Path

    base = Path(root.removeprefix("file://")) / "embeddings.parquet"
    want = {f"embeddings.parquet/{p.name}": (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in base.glob("*.parquet")}
    assert {r["name"]: (r["size"], r["sha256"]) for r in tables.file_identity(spark, root).collect()} == want
    one = next(base.glob("*.parquet"))
    assert [r["sha256"] for r in artefacts.file_identity(spark, f"file://{one}").collect()] == [want[f"embeddings.parquet/{one.name}"][1]]


def test_manifests_catch_swapped_ends(spark):
    edges = spark.createDataFrame([(0, 1, 1), (2, 3, 1), (4, 5, 2)], "src long, dst long, rank int")
    swapped = spark.createDataFrame([(0, 3, 1), (2, 1, 1), (4, 5, 2)], "src long, dst long, rank int")
    mark = lambda df: tables._manifest(df).first()
    assert mark(edges) == mark(edges.repartition(3)) and mark(edges) != mark(swapped)


@pytest.mark.parametrize("weights", [[1.0, None], [1.0, -0.5], [1.0, float("nan")], [1.0, float("inf")], [0.0, 0.0], []])
def test_bad_weights_are_refused(spark, weights):
    edges = spark.createDataFrame([(i, i + 1, w) for i, w in enumerate(weights)], "src long, dst long, weight double")
    with pytest.raises(ValueError, match="weights"):
        graph.running_mass(edges)
    with pytest.raises(ValueError, match="weights"):
        checks.sound_weights(edges)


def test_draws_follow_unequal_weights(spark):
    from quillmap.operators import sampling

    edges = spark.createDataFrame([(i, i + 1, float(i)) for i in range(10)], "src long, dst long, weight double")
    n = 20_000
    drawn = {r["src"]: r["count"] for r in sampling.draws_by_mass(graph.running_mass(edges), n, 13).groupBy("src").count().collect()}
    assert sum(drawn.values()) == n and 0 not in drawn
    assert all(abs(drawn[i] / n - i / 45) < 0.02 for i in range(1, 10))


def test_recall_grows_with_probes(spark):
    rng = np.random.default_rng(3)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 6)))], "id long, v array<double>")
    q = p.where(F.col("id") % 50 == 0)
    truth = knn.exact_knn(q, p, 10)
    share = [knn.recall(knn.ivf_knn(q, p, 10, probes=n), truth, 10).agg(F.avg("recall")).first()[0] for n in (2, 16, 60)]
    assert share[0] < share[1] <= share[2] == 1.0
