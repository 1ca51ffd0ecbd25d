import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.functions import vector as vec
from quillmap.functions.random import philox, philox_sql, seed_key, uniform
from quillmap.operators import checks, dedup, projector
from quillmap.sources import shards


def test_philox_known_answers_and_sql(spark):
    import duckdb

    r = spark.range(1).select(philox(F.lit(0), F.lit(0)).alias("p")).first()["p"]
    assert (r["x0"], r["x1"]) == (0xFF1DAE59, 0x6CD10DF2)
    mine = [x["u"] for x in spark.range(50).select(uniform(F.col("id") * 987654321987 - 5, seed_key(F.lit(-3), F.lit(8))).alias("u")).collect()]
    key = spark.range(1).select(seed_key(F.lit(-3), F.lit(8)).alias("k")).first()["k"]
    theirs = duckdb.sql(philox_sql("id * 987654321987 - 5", str(key), "range(50) t(id)", "id", "u")).fetchall()
    assert mine == [u for _, u in sorted(theirs)]
    assert abs(np.mean(mine) - 0.5) < 0.15


def test_half_precision_is_numpys(spark):
    x = np.concatenate([np.random.default_rng(0).normal(size=300), [0.0, 65504, 70000, 1e-7, -3e-5, 2**-24, 1 / 3]])
    df = spark.createDataFrame([(x.tolist(),)], "v array<double>").select(vec.half(F.col("v")).alias("h"))
    with np.errstate(over="ignore"):
        assert np.array_equal(np.array(df.first()["h"]), x.astype(np.float16).astype(float))


def test_whole_numbers_fail_closed(spark):
    ok = spark.createDataFrame([(2.0,)], "x double").select(checks.whole_number(F.col("x")).alias("x"))
    assert ok.first()["x"] == 2
    for bad in (2.5, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="not a whole number"):
            spark.createDataFrame([(bad,)], "x double").select(checks.whole_number(F.col("x")).alias("x")).collect()


def test_alignment_needs_equal_ids(spark):
    with pytest.raises(ValueError, match="partner"):
        checks.align(spark.range(5), spark.range(4))
    assert checks.align(spark.range(5), spark.range(5)).count() == 5


def test_families(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, ""), (7, ""), (8, "a")], "id long, t string")
    prints = dedup.fingerprints(df, "id", "t")
    assert sorted((r["first"], r["n"]) for r in dedup.families(prints).collect()) == [(1, 3), (6, 2)]
    assert {r["id"] for r in dedup.cap_one(prints).where("NOT kept").collect()} == {3, 7, 8}
    assert dedup.family_summary(dedup.families(prints.where("id < 0")), 0).first()["families"] == 0


def test_shards_round_trip_and_reject(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(25, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    for header in (True, False):
        where = f"{tmp_path}/{header}"
        assert shards.write_shards(df, where, 10, header=header).count() == 3
        rows = shards.read_shards(shards.list_shards(spark, where), 4).orderBy("id").collect()
        assert [r["id"] for r in rows] == list(range(25)) and np.array_equal([r["v"] for r in rows], x)
        with pytest.raises(Exception, match="data-0000"):
            shards.write_shards(df, where, 10, header=header)
    assert shards.discovered(shards.list_shards(spark, f"{tmp_path}/True")).count() == 3
    with pytest.raises(ValueError, match="incomplete"):
        shards.discovered(shards.list_shards(spark, f"{tmp_path}/True/data-0000[02]*"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.f32").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole number of rows"):
        shards.read_shards(shards.list_shards(spark, f"{tmp_path}/bad"), 4).collect()
    with pytest.raises(Exception, match="gaps"):
        shards.write_shards(df.where("id != 3"), f"{tmp_path}/gap", 10)


def test_projector_gradient_and_storage():
    rng = np.random.default_rng(0)
    for residual in (False, True):
        m = projector.Projector.fresh(6, 6, 2, residual=residual)
        x, g = rng.normal(size=(5, 6)), rng.normal(size=(5, 2))
        gw, _ = m.backward(m.forward(x, keep=True), g)
        for n in range(3):
            w = m.weights[n]
            w[1, 1] += 1e-6
            up = (m.forward(x) * g).sum()
            w[1, 1] -= 2e-6
            down = (m.forward(x) * g).sum()
            w[1, 1] += 1e-6
            assert gw[n][1, 1] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-7)
        again = projector.Projector.load(m.save())
        assert np.array_equal(again.forward(x), m.forward(x))


def test_projector_learns(spark):
    from quillmap.operators import graph, knn
    from quillmap.sources.generators import clustered

    p = clustered(spark, 300, 12, 5, 3)
    e = graph.t_conorm(graph.uniform(knn.exact_knn(p, p, 8), 8))
    _, losses = projector.fit(p, e, projector.Projector.fresh(12, 24, 2), epochs=12, batch=128, workers=2)
    assert len(losses) == 12 and losses[-1] < losses[0] - 0.05
    anchors = p.selectExpr("id", "v[0] * 3 AS x", "v[1] - v[2] AS y")
    start, off = projector.pretrain(p, anchors, projector.Projector.fresh(12, 24, 2), epochs=30, batch=32, rate=5e-3, workers=2)
    assert off[-1] < off[0] / 4
    held, aside = projector.split_anchors(anchors, 0.25)
    assert held.count() + aside.count() == 300 and 40 < aside.count() < 110 and held.join(aside, "id").count() == 0

    def drift(model):
        z = projector.transform(p, model).withColumnsRenamed({"x": "mx", "y": "my"})
        return z.join(held, "id").selectExpr("avg(hypot(mx - x, my - y))").first()[0]

    free, tied = (projector.fit(p, e, start, epochs=10, batch=128, workers=2, terms=projector.Terms(hold=h), anchors=held)[0] for h in (0.0, 20.0))
    assert drift(tied) < drift(free)
    assert projector.fit(p, e.where("false"), start)[1] == [0.0] * 5


def test_unsound_anchors_are_refused(spark):
    p = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "id long, v array<double>")
    for rows in ([], [(1, 0.0, 0.0), (1, 1.0, 1.0)], [(1, None, 0.0)], [(1, float("nan"), 0.0)], [(9, 0.0, 0.0)], [(None, 0.0, 0.0)]):
        with pytest.raises(ValueError, match="anchors"):
            projector.check_anchors(spark.createDataFrame(rows, "id long, x double, y double"), p)


def test_gradients_of_pairs():
    rng = np.random.default_rng(2)
    m = projector.Projector.fresh(5, 7, 2, seed=3)
    u, v, t = rng.normal(size=(9, 5)), rng.normal(size=(9, 5)), rng.random(9)
    terms = projector.Terms(correlation=0.7)
    grads, _ = projector.pair_gradients(m, u, v, t, terms)
    for k, p in enumerate(m.weights + m.biases):
        at = tuple(rng.integers(0, n) for n in p.shape)
        held, eps = p[at], 1e-6
        p[at] = held + eps
        up = projector.pair_gradients(m, u, v, t, terms)[1]
        p[at] = held - eps
        down = projector.pair_gradients(m, u, v, t, terms)[1]
        p[at] = held
        assert grads[k][at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


def test_learning_rate():
    assert projector.learning_rate(0, 100, 1.0, 10) == 0.1 and projector.learning_rate(9, 100, 1.0, 10) == 1.0
    assert projector.learning_rate(100, 100, 1.0, 10) == pytest.approx(0)
