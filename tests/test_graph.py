import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.operators import graph, knn, metrics, sampling
from quillmap.operators.components import connected_components


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "id long, v array<double>")


def brute(x, k, metric="l2"):
    out = {}
    for i in range(len(x)):
        d = []
        for j in range(len(x)):
            if i != j:
                s = float(x[i] @ x[j])
                d.append((math.dist(x[i], x[j]) if metric == "l2" else -s if metric == "ip" else 1 - s / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])), j))
        out[i] = [j for _, j in sorted(d)[:k]]
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
@pytest.mark.parametrize("width", [2, 24])
def test_exact_knn_is_brute_force_over_blocks(spark, metric, width):
    x = np.random.default_rng(1).normal(size=(70, width))
    v = vectors(spark, x)
    got = {}
    for r in knn.exact_knn(v, v, 5, metric, block=20).orderBy("src", "rank").collect():
        got.setdefault(r["src"], []).append(r["dst"])
    assert got == brute(x, 5, metric)


def test_ties_near_duplicates_and_short_lists(spark):
    x = np.zeros((12, 24))
    x[6:] += 1e-9 * np.arange(6)[:, None]
    v = vectors(spark, x)
    rows = knn.exact_knn(v, v, 3, block=5).where("src = 0").orderBy("rank").collect()
    assert [r["dst"] for r in rows] == [1, 2, 3]
    few = vectors(spark, np.eye(3))
    assert knn.exact_knn(few, few, 10).count() == 6
    assert knn.exact_knn(few.where("id < 0"), few, 10).count() == 0


def test_ranks_of_pairs(spark):
    x = np.random.default_rng(2).normal(size=(40, 6))
    v = vectors(spark, x)
    full = brute(x, 39)
    pairs = spark.createDataFrame([(0, 5), (0, 9), (3, 1), (39, 0)], "src long, dst long")
    for block in (7, 4096):
        got = {(r["src"], r["dst"]): r["rank"] for r in knn.ranks_of(pairs, v, block).collect()}
        assert got == {(a, b): full[a].index(b) + 1 for a, b in got} and len(got) == 4


def test_label_distances(spark):
    x = np.random.default_rng(3).normal(size=(30, 2))
    v = vectors(spark, x).selectExpr("id", "v", "id % 3 AS label")
    for r in knn.label_distances(v.where("id < 4"), v, 7).collect():
        d = [math.dist(x[r["id"]], x[j]) for j in range(30) if j % 3 == r["label"] and j != r["id"]]
        assert r["n"] == len(d) and r["total"] == pytest.approx(sum(d))


def test_inverted_lists_with_all_probes_are_exact(spark):
    v = vectors(spark, np.random.default_rng(3).normal(size=(200, 8)))
    a = {(r["src"], r["dst"]) for r in knn.exact_knn(v, v, 5).collect()}
    assert a == {(r["src"], r["dst"]) for r in knn.ivf_knn(v, v, 5, cells=8, probes=8, block=30).collect()}


def test_sigma_meets_its_target(spark):
    x = np.random.default_rng(4).normal(size=(60, 5))
    v = vectors(spark, x)
    n = knn.exact_knn(v, v, 8)
    d = {}
    for r in n.orderBy("src", "rank").collect():
        d.setdefault(r["src"], []).append(r["dist"])
    for r in graph.sigmas(n, 8).collect():
        assert r["rho"] == pytest.approx(d[r["src"]][0])
        assert sum(math.exp(-max(t - r["rho"], 0) / r["sigma"]) for t in d[r["src"]]) == pytest.approx(math.log2(8), abs=1e-4)


@settings(max_examples=8, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.sampled_from([0.1, 0.25, 0.5])), max_size=14))
def test_t_conorm(spark, edges):
    p = {}
    for a, b, w in edges:
        p[a, b] = p.get((a, b), 0) + w
    want = {}
    for a, b in set(p) | {(b, a) for a, b in p}:
        x, y = p.get((a, b), 0), p.get((b, a), 0)
        if a == b:
            y = p[a, a]
        want[a, b] = round(x + y - x * y, 9)
    got = {(r["src"], r["dst"]): round(r["weight"], 9) for r in graph.t_conorm(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    assert got == {k: w for k, w in want.items() if w}


@settings(max_examples=10, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=18))
def test_components(spark, edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in list(parent)}


def test_long_chain(spark):
    e = spark.range(200).selectExpr("(id * 37) % 201 AS src", "((id + 1) * 37) % 201 AS dst")
    c = connected_components(e)
    assert c.select("component").distinct().count() == 1 and c.count() == 201


def test_running_mass_is_a_partition_of_the_unit_interval(spark):
    e = spark.range(500).selectExpr("id % 50 AS src", "id AS dst", "(id % 7 + 1) / 7.0D AS weight")
    rows = graph.running_mass(e, 8).orderBy("src", "dst").collect()
    assert rows[0]["lo"] == pytest.approx(0, abs=1e-12) and rows[-1]["hi"] == pytest.approx(1)
    assert all(a["hi"] == pytest.approx(b["lo"]) for a, b in zip(rows, rows[1:]))


def test_samples_do_not_depend_on_partitioning(spark):
    a = spark.range(1000)
    one = {r["id"] for r in sampling.sample(a, 40, 3).collect()}
    assert one == {r["id"] for r in sampling.sample(a.repartition(7), 40, 3).collect()} and len(one) == 40
    assert one != {r["id"] for r in sampling.sample(a, 40, 4).collect()}


def test_weighted_sample_prefers_weight(spark):
    e = spark.range(2000).selectExpr("id AS src", "id AS dst", "if(id < 200, 10.0D, if(id = 500, 0.0D, 0.1D)) AS weight")
    got = [r["src"] for r in sampling.weighted_sample(e, 150, 1).collect()]
    assert sum(x < 200 for x in got) > 120 and 500 not in got


def test_perfect_and_turned_maps(spark):
    x = np.random.default_rng(5).normal(size=(80, 2))
    z = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    t = spark.createDataFrame([(i, float(3 * b + 1), float(-3 * a)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    fit, ax, ay = metrics.procrustes(z, t)
    assert fit["disparity"] == pytest.approx(0, abs=1e-9)
    moved = {r["id"]: (r["a"], r["b"]) for r in t.select("id", ax.alias("a"), ay.alias("b")).collect()}
    assert np.allclose([moved[i] for i in range(80)], x)
    p = metrics.as_points(z)
    hi, lo = metrics.neighbour_ranks(p, p), knn.exact_knn(p, p, 5)
    assert all(r["score"] == 1.0 for r in metrics.rank_penalty(hi, lo, 5, 80).collect())
