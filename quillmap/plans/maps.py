"""Queries on vectors, neighbour graphs and map quality."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.functions import vector as vec
from quillmap.operators import graph, knn, metrics, sampling
from quillmap.operators.components import connected_components
from quillmap.plans.base import ASK, E, K, Z, asked, flat_map, knn_sql, map_knn, points, query, r6, space_knn
from quillmap.session import stage

# ---- row-level vector scalars


@query(f"WITH {E} SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e")
def vector_norm(spark: SparkSession, root: str) -> DataFrame:
    return points(spark, root).select("id", F.round(vec.norm(vec.doubles("v")), 6).alias("norm"))


@query(f"WITH {E}, n AS (SELECT sqrt(list_dot_product(v, v)) AS n FROM e) SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd, round(min(n), 6) AS lowest, round(max(n), 6) AS highest, sum((abs(n - 1) > 0.01)::BIGINT)::BIGINT AS off FROM n")
def norm_stats(spark: SparkSession, root: str) -> DataFrame:
    """Row norms, and how many are off length one by more than 0.01."""
    n = F.col("n")
    d = points(spark, root).select(vec.norm(vec.doubles("v")).alias("n"))
    return d.agg(F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("sd"), F.round(F.min(n), 6).alias("lowest"), F.round(F.max(n), 6).alias("highest"), F.sum((F.abs(n - 1) > 0.01).cast("bigint")).alias("off"))


@query(f"WITH {E} SELECT id, round(list_sum(list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))), 6) AS total FROM e")
def l2_normalise(spark: SparkSession, root: str) -> DataFrame:
    return points(spark, root).select("id", F.round(vec.total(vec.unit(vec.doubles("v"))), 6).alias("total"))


@query(f"WITH {E}, t AS (SELECT id, v[1:16] AS w FROM e) SELECT id, round(w[1] / sqrt(list_dot_product(w, w)), 6) AS head, round(sqrt(list_dot_product(w, w)), 6) AS kept FROM t")
def matryoshka_truncate(spark: SparkSession, root: str) -> DataFrame:
    """The first 16 dimensions at length one: their first component, and the length that was kept."""
    v = vec.doubles("v")
    return points(spark, root).select("id", F.round(vec.truncate(v, 16)[0], 6).alias("head"), F.round(vec.norm(F.slice(v, 1, 16)), 6).alias("kept"))


@query(f"WITH {E}, p AS (SELECT a.id, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS c FROM e a JOIN e b ON b.id = a.id + 1) SELECT count(*) AS n, round(avg(c), 6) AS mean, round(min(c), 6) AS lowest, round(max(c), 6) AS highest FROM p")
def cosine_summary(spark: SparkSession, root: str) -> DataFrame:
    """Cosines of row pairs (each id with the next)."""
    p = points(spark, root)
    a, b = p.select("id", vec.doubles("v").alias("a")), p.select((F.col("id") - 1).alias("id"), vec.doubles("v").alias("b"))
    c = a.join(b, "id").select(vec.cosine(F.col("a"), F.col("b")).alias("c"))
    return c.agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.round(F.min("c"), 6).alias("lowest"), F.round(F.max("c"), 6).alias("highest"))


@query(
    f"""WITH {E}, x AS (SELECT id, unnest(v) AS x FROM e),
    h AS (SELECT id, x, round_even(x / pow(2.0, greatest(floor(log2(greatest(abs(x), 1e-300))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(greatest(abs(x), 1e-300))), -14) - 10) AS y FROM x),
    r AS (SELECT id, sum(abs(x - y)) AS ae, sum((x - y) * (x - y)) AS se, max(abs(x - y)) AS me, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS c, abs(sqrt(sum(x * x)) - sqrt(sum(y * y))) AS ne FROM h GROUP BY id)
    SELECT count(*) AS row_count, round(sum(ae), 6) AS absolute_error_sum, round(sum(se), 9) AS squared_error_sum, round(max(me), 9) AS max_absolute_error, round(avg(c), 6) AS mean_cosine, round(min(c), 6) AS min_cosine, round(sum(ne), 6) AS norm_absolute_error_sum FROM r"""
)
def half_precision_geometry(spark: SparkSession, root: str) -> DataFrame:
    """Errors of storing vectors in half precision: mergeable sums, extremes and cosines."""
    d = points(spark, root).select(vec.doubles("v").alias("v")).withColumn("h", vec.half(F.col("v")))
    e = F.zip_with("v", "h", lambda a, b: F.abs(a - b))
    r = d.select(vec.total(e).alias("ae"), vec.dot(e, e).alias("se"), F.array_max(e).alias("me"), vec.cosine(F.col("v"), F.col("h")).alias("c"), F.abs(vec.norm(F.col("v")) - vec.norm(F.col("h"))).alias("ne"))
    return r.agg(
        F.count("*").alias("row_count"), F.round(F.sum("ae"), 6).alias("absolute_error_sum"), F.round(F.sum("se"), 9).alias("squared_error_sum"), F.round(F.max("me"), 9).alias("max_absolute_error"),
        F.round(F.avg("c"), 6).alias("mean_cosine"), F.round(F.min("c"), 6).alias("min_cosine"), F.round(F.sum("ne"), 6).alias("norm_absolute_error_sum"),
    )


@query(f"WITH {Z}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM z) SELECT id, round(2 * (x - x0) / CASE WHEN x1 > x0 THEN x1 - x0 ELSE 1 END - 1, 6) AS x, round(2 * (y - y0) / CASE WHEN y1 > y0 THEN y1 - y0 ELSE 1 END - 1, 6) AS y FROM z, b")
def minmax_unit(spark: SparkSession, root: str) -> DataFrame:
    """Each axis on [-1, 1]."""
    z = flat_map(spark, root)
    box = z.agg(*[f(c).alias(n) for c in ("x", "y") for f, n in ((F.min, f"{c}0"), (F.max, f"{c}1"))])
    at = lambda c: F.round(2 * (F.col(c) - F.col(f"{c}0")) / F.when(F.col(f"{c}1") > F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"{c}0")).otherwise(1.0) - 1, 6).alias(c)
    return z.crossJoin(F.broadcast(box)).select("id", at("x"), at("y"))


@query(f"WITH {Z}, b AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, greatest(max(x) - min(x), max(y) - min(y)) / 2 * 1.02 AS half FROM z) SELECT id, round((x - cx) / half, 6) AS x, round((y - cy) / half, 6) AS y FROM z, b")
def uniform_unit(spark: SparkSession, root: str) -> DataFrame:
    """Both axes in one square frame with 2 % padding, the aspect kept."""
    z = flat_map(spark, root)
    middle = lambda c: ((F.min(c) + F.max(c)) / 2).alias(f"c{c}")
    box = z.agg(middle("x"), middle("y"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / 2 * 1.02).alias("half"))
    return z.crossJoin(F.broadcast(box)).select("id", F.round((F.col("x") - F.col("cx")) / F.col("half"), 6).alias("x"), F.round((F.col("y") - F.col("cy")) / F.col("half"), 6).alias("y"))


@query(f"WITH {E}, {Z} SELECT (SELECT count(*) FROM e WHERE list_dot_product(v, v) = 0) AS zero_rows, (SELECT count(*) FROM e WHERE len(list_filter(v, lambda x: NOT isfinite(x))) > 0) AS not_finite, (SELECT count(*) FROM z WHERE NOT isfinite(x) OR NOT isfinite(y)) AS bad_coordinates, (SELECT count(DISTINCT (x, y)) = 1 FROM z) AS collapsed")
def data_guards(spark: SparkSession, root: str) -> DataFrame:
    """Zero rows, values that aren't finite, and a map of one point, over all rows."""
    v = vec.doubles("v")
    e = points(spark, root).agg(F.sum((vec.norm(v) == 0).cast("bigint")).alias("zero_rows"), F.sum((~vec.all_finite(v)).cast("bigint")).alias("not_finite"))
    z = flat_map(spark, root)
    bad = ~vec.all_finite(F.array("x", "y"))
    return e.crossJoin(z.agg(F.sum(bad.cast("bigint")).alias("bad_coordinates"), (F.countDistinct("x", "y") == 1).alias("collapsed")))


@query(f"WITH {E}, {knn_sql('n', 'e')} SELECT src, dst, round(ln(1 + dist), 6) AS moved FROM n")
def log_distance(spark: SparkSession, root: str) -> DataFrame:
    return space_knn(spark, root).select("src", "dst", F.round(F.log1p("dist"), 6).alias("moved"))


@query(f"WITH {Z}, {knn_sql('n', 'z')} SELECT src, dst, round(CASE WHEN dist = 0 THEN 1 ELSE 1 / (1 + 1.577 * pow(dist * dist, 0.895)) END, 6) AS q FROM n")
def low_similarity_kernel(spark: SparkSession, root: str) -> DataFrame:
    return map_knn(spark, root).select("src", "dst", F.round(vec.low_kernel(F.col("dist") * F.col("dist"), 1.577, 0.895), 6).alias("q"))


# ---- neighbours

_NEAR = "SELECT src, dst, rank::INTEGER AS rank, round(dist, 6) AS dist FROM n"


@query(f"WITH {E}, {knn_sql('n', 'e')} {_NEAR}")
def knn_exact(spark: SparkSession, root: str) -> DataFrame:
    """Exact l2 neighbours of the asked rows, by blocks."""
    return space_knn(spark, root).select("src", "dst", "rank", r6("dist"))


@query(f"WITH {E}, {knn_sql('n', 'e', metric='cosine')} {_NEAR}")
def knn_cosine(spark: SparkSession, root: str) -> DataFrame:
    return space_knn(spark, root, metric="cosine").select("src", "dst", "rank", r6("dist"))


@query(f"WITH {E}, {knn_sql('n', 'e', metric='ip')} {_NEAR}")
def knn_inner_product(spark: SparkSession, root: str) -> DataFrame:
    return space_knn(spark, root, metric="ip").select("src", "dst", "rank", r6("dist"))


@query(f"WITH {Z}, {knn_sql('n', 'z')} {_NEAR}")
def knn_map(spark: SparkSession, root: str) -> DataFrame:
    """Neighbours in two dimensions, where distances are direct differences."""
    return map_knn(spark, root).select("src", "dst", "rank", r6("dist"))


@query(
    f"""WITH {E}, c AS (SELECT * FROM e WHERE id % 2 = 1), q AS (SELECT * FROM e WHERE id % {ASK} = 0),
    n AS (SELECT q.id AS src, c.id AS dst, list_distance(q.v, c.v) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, c.v), c.id) AS rank FROM q, c QUALIFY rank <= {K}) {_NEAR}"""
)
def knn_cross(spark: SparkSession, root: str) -> DataFrame:
    """Queries that aren't in the corpus (here the corpus is the odd ids)."""
    p = points(spark, root)
    return knn.exact_knn(asked(p), p.where("id % 2 = 1"), K, exclude_self=False).select("src", "dst", "rank", r6("dist"))


@query(f"WITH {E}, {knn_sql('n', 'e', 15)}, s AS (SELECT 5 AS k UNION ALL SELECT 10 UNION ALL SELECT 15) SELECT k::INTEGER AS k, src, dst, rank::INTEGER AS rank FROM n JOIN s ON rank <= k")
def knn_several_k(spark: SparkSession, root: str) -> DataFrame:
    """The longest list once, cut to several lengths."""
    n = space_knn(spark, root, 15)
    return n.withColumn("k", F.explode(F.array(F.lit(5), F.lit(10), F.lit(15)))).where("rank <= k").select("k", "src", "dst", "rank")


@query()
def knn_inverted_lists(spark: SparkSession, root: str) -> DataFrame:
    """Approximate neighbours of the asked rows from inverted lists."""
    p = points(spark, root)
    return knn.ivf_knn(asked(p), p, K).select("src", "dst", "rank", r6("dist"))


@query()
def knn_honesty(spark: SparkSession, root: str) -> DataFrame:
    """Recall of the approximate against the exact neighbours."""
    p = points(spark, root)
    truth = stage(space_knn(spark, root), "truth")
    parts = []
    for probes in (1, 4, 16):
        r = knn.recall(knn.ivf_knn(asked(p), p, K, probes=probes), truth, K)
        parts.append(r.agg(F.lit(probes).alias("probes"), F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.min("hits").alias("fewest_hits")))
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {E}, {knn_sql('n', 'e')} SELECT src, count(*) AS n, count(DISTINCT dst) AS distinct_n FROM n WHERE src <> dst GROUP BY src HAVING count(*) <> {K} OR count(DISTINCT dst) <> {K}")
def knn_without_self(spark: SparkSession, root: str) -> DataFrame:
    """Lists that include the query itself, with it taken out: those that aren't k distinct others (none)."""
    p = points(spark, root)
    with_self = knn.exact_knn(asked(p), p, K + 1, exclude_self=False)
    return knn.short_or_repeated(knn.without_self(with_self, K), K)


_CENTRES = "c AS (SELECT label AS cid, list(m ORDER BY d) AS v FROM (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e) GROUP BY label, d) GROUP BY label)"


@query(f"WITH {E}, {_CENTRES} SELECT id, arg_min(cid, (round(list_distance(e.v, c.v), 9), cid)) AS cid, round(min(list_distance(e.v, c.v)), 6) AS dist FROM e, c GROUP BY id")
def nearest_centroid(spark: SparkSession, root: str) -> DataFrame:
    """The nearest of the label means of each row; the means are as many as labels."""
    p = points(spark, root)
    means = p.select("label", F.posexplode(vec.doubles("v")).alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("m"))
    named = means.groupBy(F.col("label").cast(p.schema["id"].dataType).alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("v"))
    found = knn.exact_knn(p, stage(named, "means"), 1, exclude_self=False)
    return found.select(F.col("src").alias("id"), F.col("dst").cast(p.schema["label"].dataType).alias("cid"), r6("dist"))


@query(f"WITH {E}, {Z}, {knn_sql('n', 'e')} SELECT src, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM n JOIN z ON z.id = dst GROUP BY src")
def knn_regression(spark: SparkSession, root: str) -> DataFrame:
    """A query's place as the mean of its neighbours' places."""
    return knn.regress(space_knn(spark, root), flat_map(spark, root), "x", "y").select("src", r6("x"), r6("y"))


@query(f"WITH {Z}, {knn_sql('n', 'z', 15)} SELECT src, round(avg(dist), 6) AS density FROM n GROUP BY src")
def local_density(spark: SparkSession, root: str) -> DataFrame:
    return metrics.mean_radius(map_knn(spark, root, 15)).select("src", F.round("radius", 6).alias("density"))


# ---- graphs


def _all(spark: SparkSession, root: str, k: int = K) -> DataFrame:
    """Neighbours of all rows: a graph needs every node."""
    return space_knn(spark, root, k, anchors=False)


_HI = f"WITH {E}, {knn_sql('n', 'e', anchors=False)}"
_SYM = "pair AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, sum(CASE WHEN src <= dst THEN weight ELSE 0 END) AS a, sum(CASE WHEN src < dst THEN 0 ELSE weight END) - CASE WHEN least(src, dst) = greatest(src, dst) THEN sum(weight) ELSE 0 END AS b FROM w GROUP BY 1, 2), s AS (SELECT u AS src, v AS dst, a + b - a * b AS weight FROM pair UNION ALL SELECT v, u, a + b - a * b FROM pair WHERE u <> v)"


@query()
def fuzzy_graph_lists(spark: SparkSession, root: str) -> DataFrame:
    """The fuzzy graph over approximate neighbours of all rows: the way where exact ones are too many."""
    p = points(spark, root)
    n = stage(knn.ivf_knn(p, p, K), "near")
    return graph.t_conorm(graph.memberships(n, graph.sigmas(n, K))).select("src", "dst", r6("weight"))


@query(f"{_HI} SELECT src, dst, round(1.0 / {K}, 6)::DOUBLE AS weight FROM n")
def graph_uniform(spark: SparkSession, root: str) -> DataFrame:
    return graph.uniform(_all(spark, root), K).select("src", "dst", r6("weight"))


@query(f"{_HI}, w AS (SELECT src, dst, (1.0 / {K})::DOUBLE AS weight FROM n), {_SYM} SELECT src, dst, round(weight, 6) AS weight FROM s")
def graph_uniform_symmetric(spark: SparkSession, root: str) -> DataFrame:
    """Uniform neighbours joined both ways by the t-conorm."""
    return graph.t_conorm(graph.uniform(_all(spark, root), K)).select("src", "dst", r6("weight"))


def _halvings(k: int, steps: int = 40) -> str:
    """Bisection as nested SQL: each level halves the bracket of sigma."""
    target = math.log2(k)
    sql = "SELECT src, d, 1e-5::DOUBLE AS lo, 10.0::DOUBLE AS hi FROM lists"
    for _ in range(steps):
        sql = f"SELECT src, d, CASE WHEN e > 0 THEN lo ELSE m END AS lo, CASE WHEN e > 0 THEN m ELSE hi END AS hi FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(x - d[1], 0) / m))) - {target!r} AS e FROM (SELECT *, (lo + hi) / 2 AS m FROM ({sql})))"
    return f"c AS (SELECT src, d[1] AS rho, (lo + hi) / 2 AS sigma FROM ({sql}))"


_LISTS = "lists AS (SELECT src, list(dist ORDER BY dist, dst) AS d FROM n GROUP BY src)"


@query(f"{_HI}, {_LISTS}, {_halvings(K)} SELECT src, round(rho, 6) AS rho, round(sigma, 5) AS sigma FROM c")
def sigma_calibration(spark: SparkSession, root: str) -> DataFrame:
    """Distance of the nearest neighbour, and the width at which memberships add up to log2 k."""
    return graph.sigmas(_all(spark, root), K, tolerance=1e-11).select("src", r6("rho"), F.round("sigma", 5).alias("sigma"))


_W = "w AS (SELECT src, dst, CASE WHEN dist <= rho OR sigma = 0 THEN 1 ELSE exp(-(dist - rho) / sigma) END AS weight FROM n JOIN c USING (src))"


@query(f"{_HI}, {_LISTS}, {_halvings(K)}, {_W} SELECT src, dst, round(weight, 5) AS weight FROM w WHERE weight > 0")
def directed_membership(spark: SparkSession, root: str) -> DataFrame:
    n = _all(spark, root)
    return graph.memberships(n, graph.sigmas(n, K, tolerance=1e-11)).select("src", "dst", F.round("weight", 5).alias("weight"))


@query(f"{_HI}, {_LISTS}, {_halvings(K)}, {_W}, {_SYM} SELECT src, dst, round(weight, 5) AS weight FROM s")
def fuzzy_graph(spark: SparkSession, root: str) -> DataFrame:
    """The fuzzy graph end to end: neighbours, calibration, memberships, t-conorm."""
    n = _all(spark, root)
    return graph.t_conorm(graph.memberships(n, graph.sigmas(n, K, tolerance=1e-11))).select("src", "dst", F.round("weight", 5).alias("weight"))


@query(f"{_HI}, w AS (SELECT src, dst, round(1 - dist / 2, 6) AS weight FROM n) SELECT a.src, a.dst, a.weight, coalesce(b.weight, 0) AS reverse FROM w a LEFT JOIN w b ON a.src = b.dst AND a.dst = b.src")
def reverse_edges(spark: SparkSession, root: str) -> DataFrame:
    w = _all(spark, root).select("src", "dst", F.round(1 - F.col("dist") / 2, 6).alias("weight"))
    return graph.reverse_weights(w)


@query(f"{_HI} SELECT id, count(src) AS n FROM e LEFT JOIN n ON n.dst = e.id GROUP BY id")
def in_degree(spark: SparkSession, root: str) -> DataFrame:
    return graph.in_degrees(_all(spark, root), points(spark, root))


@query(
    f"""{_HI}, d AS (SELECT id, count(src) AS n FROM e LEFT JOIN n ON n.dst = e.id GROUP BY id), m AS (SELECT avg(n) AS mu, stddev_pop(n) AS sd FROM d)
    SELECT round(avg(pow((n - mu) / sd, 3)), 6) AS skew, max(n) AS most, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd, sum((n >= {2 * K})::BIGINT)::BIGINT AS hubs, sum((n = 0)::BIGINT)::BIGINT AS anti_hubs FROM d, m"""
)
def hubness(spark: SparkSession, root: str) -> DataFrame:
    h = graph.hubness(_all(spark, root), points(spark, root), K)
    return h.select(r6("skew"), "most", r6("mean"), r6("sd"), "hubs", "anti_hubs")


@query(f"{_HI}, s AS (SELECT count(*) AS nodes FROM e), p AS (SELECT src, count(*) AS n, count(DISTINCT dst) AS d, sum((src = dst)::BIGINT) AS own, sum((dst < 0 OR dst >= nodes)::BIGINT) AS t_out, bool_or(src < 0 OR src >= nodes) AS s_out FROM n, s GROUP BY src) SELECT sum((n <> {K})::BIGINT)::BIGINT AS wrong_degree, sum((d <> n)::BIGINT)::BIGINT AS repeated, sum(own)::BIGINT AS self_slots, sum(t_out)::BIGINT AS targets_out, sum(s_out::BIGINT)::BIGINT AS sources_out, count(*) AS sources FROM p")
def topology_scan(spark: SparkSession, root: str) -> DataFrame:
    return graph.topology_report(_all(spark, root), points(spark, root).count(), K)


@query(f"{_HI}, w AS (SELECT src, dst, (1.0 / {K})::DOUBLE AS weight FROM n) SELECT count(*) AS edges, 0::BIGINT AS out_of_range, sum((src = dst)::BIGINT)::BIGINT AS self_edges, sum((weight <= 0 OR weight > 1)::BIGINT)::BIGINT AS bad_weights, (count(*) - count(DISTINCT (src, dst)))::BIGINT AS repeats, round(min(weight), 6) AS min_weight, round(max(weight), 6) AS max_weight FROM w")
def edge_scan(spark: SparkSession, root: str) -> DataFrame:
    r = graph.edge_report(graph.uniform(_all(spark, root), K), points(spark, root).count())
    return r.select("edges", "out_of_range", "self_edges", "bad_weights", "repeats", r6("min_weight"), r6("max_weight"))


@query(f"SELECT {1 / K}::DOUBLE AS lowest, {1 / K}::DOUBLE AS highest, true AS constant")
def constant_weights(spark: SparkSession, root: str) -> DataFrame:
    return graph.constant_weight(graph.uniform(_all(spark, root), K))


@query(f"{_HI} SELECT src, array_to_string(list(dst ORDER BY dst), ',') AS neighbours FROM n GROUP BY src")
def adjacency(spark: SparkSession, root: str) -> DataFrame:
    return graph.adjacency_sets(_all(spark, root)).select("src", F.concat_ws(",", F.col("neighbours").cast("array<string>")).alias("neighbours"))


@query(f"{_HI}, s AS (SELECT count(*) // 2 AS half FROM e) SELECT src, dst FROM n, s WHERE src < half AND dst < half")
def prefix_graph(spark: SparkSession, root: str) -> DataFrame:
    """Edges among the first half of the ids: the pairing of a graph with a literal prefix of its data."""
    return graph.both_inside(_all(spark, root), points(spark, root).count() // 2).select("src", "dst")


@query(f"{_HI}, r AS (SELECT src, (src * 7 + dst) % (SELECT count(*) FROM e) AS dst FROM n), c AS (SELECT round(avg(list_cosine_similarity(a.v, b.v)), 6) AS edge_cosine, (SELECT round(avg(list_cosine_similarity(a.v, b.v)), 6) FROM r JOIN e a ON a.id = r.src JOIN e b ON b.id = r.dst WHERE r.src <> r.dst) AS other_cosine FROM n JOIN e a ON a.id = n.src JOIN e b ON b.id = n.dst) SELECT *, round(edge_cosine - other_cosine, 6) AS margin, round(edge_cosine - other_cosine, 6) >= 0.15 AS aligned FROM c")
def endpoint_alignment(spark: SparkSession, root: str) -> DataFrame:
    """Mean cosine over the ends of edges, and over other pairs of the same rows: a graph of other data has no margin."""
    p = points(spark, root).select("id", vec.doubles("v").alias("v"))
    n, e = p.count(), _all(spark, root).select("src", "dst")
    other = e.select("src", ((F.col("src") * 7 + F.col("dst")) % n).alias("dst")).where("src != dst")

    def mean(pairs: DataFrame, name: str) -> DataFrame:
        a, b = p.select(F.col("id").alias("src"), F.col("v").alias("a")), p.select(F.col("id").alias("dst"), F.col("v").alias("b"))
        return pairs.join(a, "src").join(b, "dst").agg(F.round(F.avg(vec.cosine(F.col("a"), F.col("b"))), 6).alias(name))

    both = mean(e, "edge_cosine").crossJoin(mean(other, "other_cosine"))
    margin = F.round(F.col("edge_cosine") - F.col("other_cosine"), 6)
    return both.select("edge_cosine", "other_cosine", margin.alias("margin"), (margin >= 0.15).alias("aligned"))


@query(f"{_HI}, m AS (SELECT count(*) AS m FROM e), h AS (SELECT greatest(max(src), max(dst)) + 1 AS top FROM n) SELECT part, CASE WHEN top < rows_ THEN 'too small' WHEN top = rows_ THEN 'whole' ELSE 'prefix' END AS pairing FROM h, (SELECT 'all' AS part, m AS rows_ FROM m UNION ALL SELECT 'half', m // 2 FROM m UNION ALL SELECT 'more', m + 1 FROM m)")
def graph_data_pairing(spark: SparkSession, root: str) -> DataFrame:
    """How the graph fits tables of all rows, of half of them and of one more: whole, by its prefix only, or not at all."""
    n, e = points(spark, root).count(), stage(_all(spark, root), "edges")
    return spark.createDataFrame([(name, graph.pairing(e, rows)) for name, rows in (("all", n), ("half", n // 2), ("more", n + 1))], "part string, pairing string")


@query(f"{_HI}, o AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS i FROM n UNION ALL SELECT src, dst, row_number() OVER (ORDER BY src, dst) FROM n WHERE src % 50 = 0), b AS (SELECT src, dst, lag(src) OVER (ORDER BY src, dst) AS s, lag(dst) OVER (ORDER BY src, dst) AS d FROM o) SELECT src, dst FROM b WHERE src = s AND dst = d")
def repeated_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges that stand twice in (src, dst) order, of a graph to which the asked rows' edges were added again."""
    e = _all(spark, root).select("src", "dst")
    return e.unionByName(asked(e.withColumn("id", F.col("src"))).drop("id")).groupBy("src", "dst").agg(F.count("*").alias("n")).where("n > 1").select("src", "dst")


@query(f"{_HI}, u AS (SELECT src, dst FROM n UNION SELECT dst, src FROM n) SELECT src, dst FROM u WHERE src <> dst")
def symmetric_adjacency(spark: SparkSession, root: str) -> DataFrame:
    return graph.either_way(_all(spark, root))


@query(f"{_HI} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM n WHERE src <> dst")
def undirected_edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.undirected(_all(spark, root))


@query(f"{_HI}, w AS (SELECT src, dst, 1 - dist / 2 AS weight FROM n), s AS (SELECT src, dst, weight, sum(weight) OVER (ORDER BY src, dst) AS upto, sum(weight) OVER () AS total FROM w) SELECT src, dst, round((upto - weight) / total, 6) AS lo, round(upto / total, 6) AS hi FROM s")
def weight_cdf(spark: SparkSession, root: str) -> DataFrame:
    """The part of [0, 1) each edge has in drawing by weight."""
    w = _all(spark, root).select("src", "dst", (1 - F.col("dist") / 2).alias("weight"))
    return graph.running_mass(w).select("src", "dst", r6("lo"), r6("hi"))


@query(
    f"""{_HI}, w AS (SELECT src, dst, 1 - dist / 2 AS weight FROM n), t AS (SELECT *, ntile(10) OVER (ORDER BY weight, src, dst) AS decile FROM w)
    SELECT decile::INTEGER AS decile, count(*) AS n, round(sum(weight) / (SELECT sum(weight) FROM w), 6) AS mass FROM t GROUP BY decile"""
)
def weight_deciles(spark: SparkSession, root: str) -> DataFrame:
    """The share of draws each decile of edges is to have."""
    w = _all(spark, root).select("src", "dst", (1 - F.col("dist") / 2).alias("weight"))
    n = w.count()
    small, more = n // 10, n % 10  # the first deciles have one more where ten doesn't divide the edges
    pos = F.col("pos")
    decile = F.when(pos < more * (small + 1), F.floor(pos / (small + 1))).otherwise(more + F.floor((pos - more * (small + 1)) / max(1, small))) + 1
    t = sampling.positions(w, ["weight", "src", "dst"]).withColumn("decile", decile.cast("int"))
    per = t.groupBy("decile").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return per.select("decile", "n", F.round(F.col("w") / F.sum("w").over(Window.partitionBy()), 6).alias("mass"))


@query(f"{_HI}, w AS (SELECT src, dst, (1.0 / {K})::DOUBLE AS weight FROM n), {_SYM} SELECT count(*) AS n, round(min(weight), 6) AS lowest, round(max(weight), 6) AS highest, round(avg(weight), 6) AS mean, round(quantile_cont(weight, 0.5), 6) AS median FROM s")
def weight_summary(spark: SparkSession, root: str) -> DataFrame:
    s = graph.t_conorm(graph.uniform(_all(spark, root), K))
    w = F.col("weight")
    return s.agg(F.count("*").alias("n"), F.round(F.min(w), 6).alias("lowest"), F.round(F.max(w), 6).alias("highest"), F.round(F.avg(w), 6).alias("mean"), F.round(F.percentile(w, F.lit(0.5)), 6).alias("median"))


@query(f"{_HI}, m AS (SELECT src, dst FROM n WHERE rank <= 5) SELECT (SELECT count(*) FROM n JOIN m USING (src, dst)) AS both_, (SELECT count(*) FROM n ANTI JOIN m USING (src, dst)) AS only_a, 0::BIGINT AS only_b, 0.1::DOUBLE AS max_difference")
def graph_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Two graphs edge by edge: 10 neighbours at 1/10 against 5 at 1/5."""
    n = _all(spark, root)
    d = graph.graph_difference(graph.uniform(n, K), graph.uniform(n.where("rank <= 5"), 5))
    return d.select(F.col("both").alias("both_"), "only_a", "only_b", r6("max_difference"))


@query(
    f"""WITH RECURSIVE {E}, {knn_sql('n', 'e', 1, anchors=False)}, u AS (SELECT src, dst FROM n UNION SELECT dst, src FROM n),
    r(node, other) AS (SELECT id, id FROM e UNION SELECT r.node, u.dst FROM r JOIN u ON u.src = r.other) SELECT node, min(other) AS component FROM r GROUP BY node"""
)
def graph_components(spark: SparkSession, root: str) -> DataFrame:
    """Components of the nearest-neighbour graph."""
    return connected_components(_all(spark, root, 1))


@query()
def graph_communities(spark: SparkSession, root: str) -> DataFrame:
    """Communities by local moves (an approximation of modularity communities), with sizes and the modularity they reach."""
    e = stage(graph.t_conorm(graph.uniform(_all(spark, root), K)), "graph")
    c = graph.communities(e)
    m = graph.modularity(e.where("src < dst"), c)
    return c.groupBy("community").agg(F.count("*").alias("n")).crossJoin(m.select(r6("modularity")))


@query(
    f"""WITH RECURSIVE {Z}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM z),
    c AS (SELECT DISTINCT least(floor((x - x0) / (x1 - x0) * 64), 63)::BIGINT AS cx, least(floor((y - y0) / (y1 - y0) * 64), 63)::BIGINT AS cy FROM z, b),
    g AS (SELECT cx * 64 + cy AS cell, cx, cy FROM c), u AS (SELECT a.cell AS s, b.cell AS t FROM g a JOIN g b ON abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1),
    r(node, other) AS (SELECT cell, cell FROM g UNION SELECT r.node, u.t FROM r JOIN u ON u.s = r.other), k AS (SELECT node, min(other) AS k FROM r GROUP BY node)
    SELECT count(DISTINCT k) AS components, count(*) AS occupied, (SELECT max(n) FROM (SELECT count(*) AS n FROM k GROUP BY k)) AS largest FROM k"""
)
def occupied_cell_components(spark: SparkSession, root: str) -> DataFrame:
    """4-connected components of the occupied cells of a 64 x 64 grid."""
    z = flat_map(spark, root)
    box = z.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * 64), F.lit(63))
    cells = z.crossJoin(F.broadcast(box)).select(at("x").alias("cx"), at("y").alias("cy")).distinct().withColumn("cell", F.col("cx") * 64 + F.col("cy"))
    beside = F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")), F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    steps = cells.withColumn("d", F.explode(beside)).select("cell", (F.col("cx") + F.col("d.dx")).alias("ex"), (F.col("cy") + F.col("d.dy")).alias("ey"))
    links = steps.join(cells.select(F.col("cx").alias("ex"), F.col("cy").alias("ey"), F.col("cell").alias("other")), ["ex", "ey"]).select(F.col("cell").alias("src"), F.col("other").alias("dst"))
    sizes = connected_components(links).groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("components"), F.sum("n").alias("occupied"), F.max("n").alias("largest"))
