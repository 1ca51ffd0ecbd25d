"""Queries that score a map: the first two components of each embedding stand for a trained projection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.functions import vector as vec
from quillmap.operators import checks, knn, metrics
from quillmap.plans.base import ASK, E, K, Z, asked, flat_map, knn_sql, map_knn, points, query, r6, space_knn
from quillmap.session import stage

_BOTH = f"WITH {E}, {Z}, {knn_sql('h', 'e')}, {knn_sql('l', 'z')}"
_ANCHORS = f"a AS (SELECT id AS src FROM e WHERE id % {ASK} = 0)"


#: The share of all rows whose nearest count at a fixed fraction, and the same for queries from other domains.
K_FRAC, K_FRAC_OUTSIDE, K_OUTSIDE = 0.001, 0.01, 50


def _frac(n: int, hit: int = K, share: float = K_FRAC) -> int:
    return max(hit, math.ceil(n * share))


@query(f"{_BOTH}, {_ANCHORS} SELECT a.src, count(l.dst) AS hits, round(count(l.dst) / {K}, 6) AS recall FROM a JOIN h USING (src) LEFT JOIN l ON l.src = h.src AND l.dst = h.dst GROUP BY a.src")
def knn_recall(spark: SparkSession, root: str) -> DataFrame:
    """Hits of each anchor's true neighbours among its neighbours in the map, both against all rows; no hit counts as 0."""
    return knn.recall(map_knn(spark, root), space_knn(spark, root), K).select("src", "hits", r6("recall"))


@query(
    f"""WITH {E}, {Z}, {knn_sql('h', 'e')}, {knn_sql('m', 'z', None)}, f AS (SELECT greatest({K}, ceil(count(*) * {K_FRAC})) AS k FROM e), l AS (SELECT m.* FROM m, f WHERE rank <= k)
    SELECT count(*) AS anchors, round(avg(hits / {K}), 6) AS ffr FROM (SELECT h.src, count(l.dst) AS hits FROM h LEFT JOIN l ON l.src = h.src AND l.dst = h.dst GROUP BY h.src)"""
)
def fixed_fraction_recall(spark: SparkSession, root: str) -> DataFrame:
    """The true top 10 found in the nearest max(10, K_FRAC of the rows) of the map."""
    n = points(spark, root).count()
    r = knn.recall(map_knn(spark, root, _frac(n)), space_knn(spark, root), K)
    return r.agg(F.count("*").alias("anchors"), F.round(F.avg("recall"), 6).alias("ffr"))


_OVERLAP = "o AS (SELECT src, count(*) FILTER (a AND b) AS both_, count(*) AS either, count(*) FILTER (a) AS n FROM (SELECT coalesce(h.src, l.src) AS src, h.dst IS NOT NULL AS a, l.dst IS NOT NULL AS b FROM h FULL JOIN l ON h.src = l.src AND h.dst = l.dst) GROUP BY src)"


@query(f"{_BOTH}, {_OVERLAP} SELECT src, both_, either, round(both_ / either, 6) AS jaccard, round(both_ / n, 6) AS retention FROM o")
def neighbour_overlap(spark: SparkSession, root: str) -> DataFrame:
    o = metrics.overlap(space_knn(spark, root), map_knn(spark, root))
    return o.select("src", F.col("both").alias("both_"), "either", r6("jaccard"), r6("retention"))


def _pair(spark: SparkSession, root: str, anchors: bool = True) -> tuple[DataFrame, DataFrame]:
    return space_knn(spark, root, 15, anchors), map_knn(spark, root, 15, anchors)


@query(f"WITH {E}, {Z}, {knn_sql('h', 'e', 15)}, {knn_sql('l', 'z', 15)}, a AS (SELECT src, ln(avg(dist) + 1e-12) AS a FROM h GROUP BY src), b AS (SELECT src, ln(avg(dist) + 1e-12) AS b FROM l GROUP BY src) SELECT round(corr(a, b), 6) AS density FROM a JOIN b USING (src)")
def density_preservation(spark: SparkSession, root: str) -> DataFrame:
    return metrics.density_preservation(*_pair(spark, root)).select(r6("density"))


@query(
    f"""WITH {E}, {Z}, {knn_sql('h', 'e', None)}, {knn_sql('l', 'z', None)}, m AS (SELECT count(*) AS m FROM e),
    t AS (SELECT l.src, 1 - 2.0 / ({K} * (2 * m - {3 * K + 1})) * sum(greatest(h.rank - {K}, 0)) AS t FROM l JOIN h USING (src, dst), m WHERE l.rank <= {K} GROUP BY l.src, m),
    c AS (SELECT h.src, 1 - 2.0 / ({K} * (2 * m - {3 * K + 1})) * sum(greatest(l.rank - {K}, 0)) AS c FROM h JOIN l USING (src, dst), m WHERE h.rank <= {K} GROUP BY h.src, m)
    SELECT src, round(t, 6) AS trustworthiness, round(c, 6) AS continuity FROM t JOIN c USING (src)"""
)
def trustworthiness_continuity(spark: SparkSession, root: str) -> DataFrame:
    """Per anchor, from its ranks of all points in space and map."""
    p, z = points(spark, root), metrics.as_points(flat_map(spark, root))
    near_hi, near_lo, m = stage(space_knn(spark, root), "near"), stage(map_knn(spark, root), "near"), p.count()
    hi, lo = knn.ranks_of(near_lo, p), knn.ranks_of(near_hi, z)
    t = metrics.rank_penalty(hi, near_lo, K, m).select("src", F.round("score", 6).alias("trustworthiness"))
    return t.join(metrics.rank_penalty(lo, near_hi, K, m).select("src", F.round("score", 6).alias("continuity")), "src")


#: Pairs of each id with others at fixed strides: as many for each row, none with itself.
_STRIDES = (1, 7, 31, 101)
_PAIRS_SQL = f"p AS (SELECT e.id AS i, (e.id + s) % n AS j FROM e, (SELECT count(*) AS n FROM e), (SELECT unnest([{', '.join(map(str, _STRIDES))}]) AS s)), d AS (SELECT i, j, list_distance(a.v, b.v) AS hi, list_distance(za.v, zb.v) AS lo FROM p JOIN e a ON a.id = i JOIN e b ON b.id = j JOIN z za ON za.id = i JOIN z zb ON zb.id = j)"


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    p = points(spark, root)
    n = p.count()
    return p.select(F.col("id").alias("i"), F.explode(F.array(*[((F.col("id") + s) % n) for s in _STRIDES])).alias("j")).where("i != j")


@query(f"WITH {E}, {Z}, {_PAIRS_SQL}, r AS (SELECT rank() OVER (ORDER BY round(hi, 9)) + (count(*) OVER (PARTITION BY round(hi, 9)) - 1) / 2 AS a, rank() OVER (ORDER BY round(lo, 9)) + (count(*) OVER (PARTITION BY round(lo, 9)) - 1) / 2 AS b FROM d) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman_distances(spark: SparkSession, root: str) -> DataFrame:
    d = metrics.pair_distances(_pairs(spark, root), points(spark, root), flat_map(spark, root))
    return metrics.spearman(d.select(F.round("hi", 9).alias("hi"), F.round("lo", 9).alias("lo")), "hi", "lo").select(r6("spearman"))


@query(f"WITH {E}, {Z}, {_PAIRS_SQL} SELECT round(corr(hi, lo), 6) AS pearson FROM d")
def pearson_distances(spark: SparkSession, root: str) -> DataFrame:
    d = metrics.pair_distances(_pairs(spark, root), points(spark, root), flat_map(spark, root))
    return d.agg(F.round(F.corr("hi", "lo"), 6).alias("pearson"))


@query(
    f"""WITH {E}, {Z}, n AS (SELECT count(*) AS n FROM e), t AS (SELECT id AS i, (id + 7) % n AS j, (id + 31) % n AS l FROM e, n)
    SELECT count(*) AS n, round(avg((sign(list_distance(a.v, b.v) - list_distance(a.v, c.v)) = sign(list_distance(x.v, y.v) - list_distance(x.v, w.v)))::INTEGER), 6) AS accuracy
    FROM t JOIN e a ON a.id = i JOIN e b ON b.id = j JOIN e c ON c.id = l JOIN z x ON x.id = i JOIN z y ON y.id = j JOIN z w ON w.id = l"""
)
def triplet_accuracy(spark: SparkSession, root: str) -> DataFrame:
    p = points(spark, root)
    n = p.count()
    t = p.select(F.col("id").alias("i"), ((F.col("id") + 7) % n).alias("j"), ((F.col("id") + 31) % n).alias("l"))
    return metrics.triplet_accuracy(t, p, flat_map(spark, root)).select("n", r6("accuracy"))


@query(
    f"""WITH {E}, {Z}, c AS (SELECT * FROM e WHERE id % {ASK} <> 0), q AS (SELECT * FROM e WHERE id % {ASK} = 0), zc AS (SELECT * FROM z WHERE id % {ASK} <> 0), zq AS (SELECT * FROM z WHERE id % {ASK} = 0),
    h AS (SELECT q.id AS src, c.id AS dst FROM q, c QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, c.v), c.id) <= {K}),
    l AS (SELECT q.id AS src, c.id AS dst FROM zq q, zc c QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, c.v), c.id) <= {K})
    SELECT src, count(l.dst) AS hits FROM h LEFT JOIN l USING (src, dst) GROUP BY src"""
)
def projection_fidelity(spark: SparkSession, root: str) -> DataFrame:
    """Recall of queries that aren't in the training rows."""
    p, z = points(spark, root), metrics.as_points(flat_map(spark, root))
    rest = F.col("id") % ASK != 0
    hi = knn.exact_knn(asked(p), p.where(rest), K, exclude_self=False)
    lo = knn.exact_knn(asked(z), z.where(rest), K, exclude_self=False)
    return knn.recall(lo, hi, K).select("src", "hits")


_TURNED = "w AS (SELECT id, 0.8 * x - 0.6 * y + 0.01 * (id % 7) + 3 AS x, 0.6 * x + 0.8 * y - 1 AS y FROM z)"


def _turned(spark: SparkSession, root: str) -> DataFrame:
    """The map turned, moved and a little disturbed: a second run's map."""
    return flat_map(spark, root).select("id", (0.8 * F.col("x") - 0.6 * F.col("y") + 0.01 * (F.col("id") % 7) + 3).alias("x"), (0.6 * F.col("x") + 0.8 * F.col("y") - 1).alias("y"))


# Best similarity transform in closed form: with c = cross-covariances, scale * turn = (p, -q; q, p) where p, q are the
# sum and difference of the cross terms over the variance of b (no reflection in these maps).
_FIT = """s AS (SELECT avg(z.x) AS ax, avg(z.y) AS ay, avg(w.x) AS bx, avg(w.y) AS by_, covar_pop(z.x, w.x) AS xx, covar_pop(z.y, w.y) AS yy, covar_pop(z.x, w.y) AS xy, covar_pop(z.y, w.x) AS yx,
    var_pop(w.x) + var_pop(w.y) AS vb, var_pop(z.x) + var_pop(z.y) AS va FROM z JOIN w USING (id)), f AS (SELECT *, (xx + yy) / vb AS p, (yx - xy) / vb AS q FROM s)"""


@query(f"WITH {Z}, {_TURNED}, {_FIT} SELECT w.id, round(p * (w.x - bx) - q * (w.y - by_) + ax, 6) AS x, round(q * (w.x - bx) + p * (w.y - by_) + ay, 6) AS y FROM w, f")
def procrustes_align(spark: SparkSession, root: str) -> DataFrame:
    z, w = flat_map(spark, root), _turned(spark, root)
    _, ax, ay = metrics.procrustes(z, w)
    return w.select("id", F.round(ax, 6).alias("x"), F.round(ay, 6).alias("y"))


@query(f"WITH {Z}, {_TURNED}, {_FIT} SELECT w.id, round(sqrt(pow(p * (w.x - bx) - q * (w.y - by_) + ax - z.x, 2) + pow(q * (w.x - bx) + p * (w.y - by_) + ay - z.y, 2)), 6) AS drift FROM w JOIN z USING (id), f")
def per_point_drift(spark: SparkSession, root: str) -> DataFrame:
    z, w = flat_map(spark, root), _turned(spark, root)
    _, ax, ay = metrics.procrustes(z, w)
    moved = w.select("id", ax.alias("ax"), ay.alias("ay"))
    return moved.join(z, "id").select("id", F.round(F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")), 6).alias("drift"))


@query(
    f"""WITH {Z}, {_TURNED}, {_FIT}, wv AS (SELECT id, [x, y] AS v FROM w), {knn_sql('h', 'z')}, {knn_sql('l', 'wv')}, {_OVERLAP}, d AS (SELECT avg(sqrt(pow(p * (w.x - bx) - q * (w.y - by_) + ax - z.x, 2) + pow(q * (w.x - bx) + p * (w.y - by_) + ay - z.y, 2))) AS drift FROM w JOIN z USING (id), f)
    SELECT round(1 - (pow(xx + yy, 2) + pow(yx - xy, 2)) / (va * vb), 6) AS disparity, round((SELECT avg(both_ / either) FROM o), 6) AS overlap, round(drift, 6) AS mean_drift FROM f, d"""
)
def compare_maps(spark: SparkSession, root: str) -> DataFrame:
    """Disparity, neighbour overlap and mean drift of two maps."""
    z, w = flat_map(spark, root), _turned(spark, root)
    fit, ax, ay = metrics.procrustes(z, w)
    drift = w.select("id", ax.alias("ax"), ay.alias("ay")).join(z, "id").agg(F.avg(F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"))).alias("mean_drift"))
    wv = metrics.as_points(w)
    o = metrics.overlap(map_knn(spark, root), knn.exact_knn(asked(wv), wv, K)).agg(F.avg("jaccard").alias("overlap"))
    return drift.crossJoin(o).select(F.lit(round(fit["disparity"], 6)).alias("disparity"), r6("overlap"), r6("mean_drift"))


@query(f"WITH {Z}, {knn_sql('n', 'z', 15)} SELECT src, a.label, round(avg((a.label = b.label)::INTEGER), 6) AS share FROM n JOIN z a ON a.id = src JOIN z b ON b.id = dst GROUP BY src, a.label")
def neighbourhood_hit(spark: SparkSession, root: str) -> DataFrame:
    return metrics.label_agreement(map_knn(spark, root, 15), flat_map(spark, root).select("id", "label")).select("src", "label", r6("share"))


_SHARE = f"f AS (SELECT greatest({K}, ceil(count(*) * {K_FRAC})) AS k FROM e)"


@query(
    f"""WITH {E}, {Z}, {knn_sql('h', 'e', None)}, {knn_sql('l', 'z', None)}, {_SHARE}, p AS (SELECT avg((a.label = b.label)::INTEGER) AS hi FROM h JOIN z a ON a.id = src JOIN z b ON b.id = dst, f WHERE rank <= k), q AS (SELECT avg((a.label = b.label)::INTEGER) AS lo FROM l JOIN z a ON a.id = src JOIN z b ON b.id = dst, f WHERE rank <= k)
    SELECT round(hi, 6) AS space_purity, round(lo, 6) AS map_purity, round(lo / nullif(hi, 0), 6) AS purity FROM p, q"""
)
def region_purity(spark: SparkSession, root: str) -> DataFrame:
    """Label agreement of the nearest max(10, K_FRAC of the rows) in space and map, and their ratio."""
    return _region_purity(spark, root, points(spark, root).select("id", "label"))


@query()
def centroid_purity(spark: SparkSession, root: str) -> DataFrame:
    """The same for the cells of 256 and 1,024 centroids in place of labels, with both numerators: a ratio above 1 over-separates."""
    p = points(spark, root)
    parts = []
    for cells in (256, 1024):
        labels = stage(knn.centroid_labels(p, knn.lloyd(p, cells, 5)).select("id", F.col("cid").alias("label")), "cells")
        parts.append(_region_purity(spark, root, labels).select(F.lit(cells).alias("cells"), "*"))
    return parts[0].unionByName(parts[1])


def _region_purity(spark: SparkSession, root: str, labels: DataFrame) -> DataFrame:
    k = _frac(points(spark, root).count())
    hi = metrics.label_agreement(space_knn(spark, root, k), labels).agg(F.avg("share").alias("space_purity"))
    lo = metrics.label_agreement(map_knn(spark, root, k), labels).agg(F.avg("share").alias("map_purity"))
    return hi.crossJoin(lo).select(r6("space_purity"), r6("map_purity"), F.round(F.try_divide("map_purity", "space_purity"), 6).alias("purity"))


@query(
    f"""WITH {Z}, d AS (SELECT a.id, a.label AS mine, b.label, avg(list_distance(a.v, b.v)) AS d FROM z a JOIN z b ON a.id <> b.id AND a.id % {ASK} = 0 GROUP BY 1, 2, 3), s AS (SELECT id, min(CASE WHEN label = mine THEN d END) AS a, min(CASE WHEN label <> mine THEN d END) AS b FROM d GROUP BY id)
    SELECT id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s"""
)
def silhouette(spark: SparkSession, root: str) -> DataFrame:
    z = flat_map(spark, root)
    s = metrics.silhouette(metrics.as_points(z), z.select("id", "label"), asked(z))
    return s.select("id", r6("silhouette"))


@query(
    f"""WITH {Z}, {knn_sql('n', 'z', 1, anchors=False)}, b AS (SELECT quantile_cont(x, 0.005) AS x0, quantile_cont(x, 0.995) AS x1, quantile_cont(y, 0.005) AS y0, quantile_cont(y, 0.995) AS y1 FROM z),
    c AS (SELECT count(*) AS n FROM z, b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY least(floor((x - x0) / (x1 - x0) * 64), 63), least(floor((y - y0) / (y1 - y0) * 64), 63)), t AS (SELECT sum(n) AS t, sum(n * ln(n)) AS s, count(*) AS occupied FROM c)
    SELECT round((SELECT quantile_cont(dist, 0.5) FROM n) / sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 6) AS collapse, round((ln(t) - s / t) / ln(4096.0), 6) AS entropy, occupied FROM b, t"""
)
def collapse_index(spark: SparkSession, root: str) -> DataFrame:
    c = metrics.collapse(flat_map(spark, root), map_knn(spark, root, 1, anchors=False))
    return c.select(r6("collapse"), r6("entropy"), "occupied")


@query(
    f"""{_BOTH}, {_OVERLAP}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM z) SELECT least(floor((x - x0) / (x1 - x0) * 30), 29)::INTEGER AS bx, least(floor((y - y0) / (y1 - y0) * 30), 29)::INTEGER AS by_, count(*) AS n, round(avg(jaccard), 6) AS jaccard
    FROM z JOIN (SELECT src AS id, both_ / either AS jaccard FROM o) USING (id), b GROUP BY 1, 2"""
)
def spatial_bins(spark: SparkSession, root: str) -> DataFrame:
    """Means of per-point scores in a grid over the map."""
    o = metrics.overlap(space_knn(spark, root), map_knn(spark, root)).select(F.col("src").alias("id"), "jaccard")
    return metrics.spatial_bins(flat_map(spark, root), o).select("bx", F.col("by").alias("by_"), "n", r6("jaccard"))


@query(f"WITH {E}, {knn_sql('r', 'e', None)} SELECT src, dst, rank::INTEGER AS rank FROM r")
def rank_matrix(spark: SparkSession, root: str) -> DataFrame:
    """The rank of every point from every anchor."""
    p = points(spark, root)
    return metrics.neighbour_ranks(p, asked(p)).select("src", "dst", "rank")


_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"


@query(f"WITH {E}, {Z}, {_PAIRS_SQL}, c AS (SELECT {_COS} AS c FROM p JOIN e a ON a.id = i JOIN e b ON b.id = j) SELECT round(avg(c), 6) AS mean, round(avg(abs(c)), 6) AS mean_size, round(stddev_pop(c), 6) AS sd, round(quantile_cont(c, 0.05), 6) AS p5, round(quantile_cont(c, 0.95), 6) AS p95 FROM c")
def anisotropy(spark: SparkSession, root: str) -> DataFrame:
    """Cosines of row pairs: how far the space has a direction of its own."""
    c = _pair_vectors(spark, root).select(vec.cosine(F.col("a"), F.col("b")).alias("c"))
    return c.agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.avg(F.abs("c")), 6).alias("mean_size"), F.round(F.stddev_pop("c"), 6).alias("sd"), F.round(F.percentile("c", F.lit(0.05)), 6).alias("p5"), F.round(F.percentile("c", F.lit(0.95)), 6).alias("p95"))


def _pair_vectors(spark: SparkSession, root: str) -> DataFrame:
    p = points(spark, root).select("id", vec.doubles("v").alias("v"))
    a, b = p.select(F.col("id").alias("i"), F.col("v").alias("a")), p.select(F.col("id").alias("j"), F.col("v").alias("b"))
    return _pairs(spark, root).join(a, "i").join(b, "j")


@query(f"WITH {E}, {Z}, {_PAIRS_SQL} SELECT round(ln(avg(exp(-2 * pow(list_distance(list_transform(a.v, lambda x: x / sqrt(list_dot_product(a.v, a.v))), list_transform(b.v, lambda x: x / sqrt(list_dot_product(b.v, b.v)))), 2)))), 6) AS uniformity FROM p JOIN e a ON a.id = i JOIN e b ON b.id = j")
def uniformity(spark: SparkSession, root: str) -> DataFrame:
    d2 = vec.squared_distance(vec.unit(F.col("a")), vec.unit(F.col("b")))
    return _pair_vectors(spark, root).agg(F.round(F.log(F.avg(F.exp(-2 * d2))), 6).alias("uniformity"))


@query(
    f"""WITH {E}, {knn_sql('n', 'e', 2, anchors=False)}, m AS (SELECT src, ln(max(dist) / min(dist)) AS l FROM n GROUP BY src HAVING min(dist) > 0), r AS (SELECT l, row_number() OVER (ORDER BY l, src) AS i, count(*) OVER () AS n FROM m)
    SELECT round(sum(l * -ln(1 - i / (n + 1))) / sum(l * l), 6) AS dimension FROM r WHERE i <= floor(n * 0.9)"""
)
def twonn_dimension(spark: SparkSession, root: str) -> DataFrame:
    """Intrinsic dimension from the ratio of the two nearest distances."""
    return metrics.twonn(space_knn(spark, root, 2, anchors=False)).select(r6("dimension"))


@query()
def pca_spectrum(spark: SparkSession, root: str) -> DataFrame:
    s = metrics.spectrum(points(spark, root), 64)
    return spark.range(1).select(*[F.lit(round(v, 6)).alias(k) for k, v in s.items()])


@query()
def pca_floor(spark: SparkSession, root: str) -> DataFrame:
    """The map of the two main directions, at an RMS radius of 5: a floor for trained maps, and a target for their start."""
    return metrics.pca_map(points(spark, root), 64, 5.0).select("id", r6("x"), r6("y"))


@query(f"WITH {E}, {knn_sql('a', 'e', 10)}, t AS (SELECT id, v[1:16] AS v FROM e), {knn_sql('b', 't', 50, metric='cosine')}, o AS (SELECT a.src, count(b.dst) FILTER (b.rank <= 10) AS same, count(b.dst) AS within FROM a LEFT JOIN b USING (src, dst) GROUP BY a.src) SELECT round(avg(same / 10), 6) AS mean_overlap, round(quantile_cont(same / 10, 0.5), 6) AS median_overlap, round(avg(within / 10), 6) AS ten_in_fifty FROM o")
def matryoshka_overlap(spark: SparkSession, root: str) -> DataFrame:
    """How many neighbours remain when vectors are cut to 16 dimensions."""
    p = points(spark, root)
    cut = p.select("id", F.slice("v", 1, 16).alias("v"))
    near = knn.exact_knn(asked(cut), cut, 50, "cosine").select("src", "dst", F.col("rank").alias("r"))
    o = space_knn(spark, root).select("src", "dst").join(near, ["src", "dst"], "left").groupBy("src").agg(F.sum(F.coalesce((F.col("r") <= 10).cast("int"), F.lit(0))).alias("same"), F.count("r").alias("within"))
    return o.agg(F.round(F.avg(F.col("same") / 10), 6).alias("mean_overlap"), F.round(F.percentile(F.col("same") / 10, F.lit(0.5)), 6).alias("median_overlap"), F.round(F.avg(F.col("within") / 10), 6).alias("ten_in_fifty"))


@query(
    f"""WITH {E}, p AS (SELECT label AS a, (id % 10) AS b FROM e), n AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS t FROM n), ra AS (SELECT sum(n * (n - 1) / 2) AS ra FROM (SELECT sum(n) AS n FROM n GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS rb FROM (SELECT sum(n) AS n FROM n GROUP BY b))
    SELECT round((s - ra * rb / (t * (t - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2)), 6) AS ari FROM s, ra, rb"""
)
def centroid_agreement(spark: SparkSession, root: str) -> DataFrame:
    """Adjusted Rand index of two labellings."""
    p = points(spark, root).select(F.col("label").alias("a"), (F.col("id") % 10).alias("b"))
    return metrics.adjusted_rand(p, "a", "b").select(r6("ari"))


_FACTORS = "g AS (SELECT id, label, id % 2 AS a, (id // 2) % 2 AS b, list_sum(v) AS m FROM e)"


@query(f"WITH {E}, {_FACTORS}, c AS (SELECT avg(m) FILTER (a = 0 AND b = 0) AS m00, avg(m) FILTER (a = 0 AND b = 1) AS m01, avg(m) FILTER (a = 1 AND b = 0) AS m10, avg(m) FILTER (a = 1 AND b = 1) AS m11 FROM g) SELECT round((m10 + m11 - m00 - m01) / 2, 6) AS effect_a, round((m01 + m11 - m00 - m10) / 2, 6) AS effect_b, round(m11 - m10 - m01 + m00, 6) AS interaction FROM c")
def factorial_effects(spark: SparkSession, root: str) -> DataFrame:
    """Main effects and interaction of a 2 x 2 design; an empty cell is an error."""
    g = points(spark, root).select((F.col("id") % 2).alias("a"), (F.floor(F.col("id") / 2) % 2).alias("b"), vec.total(vec.doubles("v")).alias("m"))
    cell = lambda a, b: F.avg(F.when((F.col("a") == a) & (F.col("b") == b), F.col("m"))).alias(f"m{a}{b}")
    c = g.agg(cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))
    full = F.when(F.col("m00").isNull() | F.col("m01").isNull() | F.col("m10").isNull() | F.col("m11").isNull(), F.raise_error(F.lit("a cell of the design is empty")))
    m = {k: F.coalesce(full.cast("double"), F.col(k)) if k == "m00" else F.col(k) for k in ("m00", "m01", "m10", "m11")}
    return c.select(F.round((m["m10"] + m["m11"] - m["m00"] - m["m01"]) / 2, 6).alias("effect_a"), F.round((m["m01"] + m["m11"] - m["m00"] - m["m10"]) / 2, 6).alias("effect_b"), F.round(m["m11"] - m["m10"] - m["m01"] + m["m00"], 6).alias("interaction"))


@query(
    f"""WITH {E}, {Z}, {knn_sql('h', 'e')}, {knn_sql('l', 'z')}, o AS (SELECT h.src AS id, count(l.dst) / {K} AS recall FROM h LEFT JOIN l USING (src, dst) GROUP BY h.src), d AS (SELECT src AS id, avg(dist) AS radius FROM l GROUP BY src)
    SELECT coalesce(o.id, d.id) AS id, round(recall, 6) AS recall, round(radius, 6) AS radius FROM o FULL JOIN d USING (id)"""
)
def per_point_diagnostics(spark: SparkSession, root: str) -> DataFrame:
    """Outer join of per-point scores."""
    lo = map_knn(spark, root)
    o = knn.recall(lo, space_knn(spark, root), K).select(F.col("src").alias("id"), r6("recall"))
    d = metrics.mean_radius(lo).select(F.col("src").alias("id"), r6("radius"))
    return o.join(d, "id", "full_outer")


@query(
    f"""WITH {E}, {Z}, {knn_sql('h', 'e', 15)}, {knn_sql('l', 'z', None)}, {_SHARE}, n AS (SELECT h.src, count(l.dst) FILTER (h.rank <= 10 AND l.rank <= 10) / 10 AS recall, count(l.dst) FILTER (h.rank <= 10 AND l.rank <= k) / 10 AS ffr FROM h CROSS JOIN f LEFT JOIN l ON l.src = h.src AND l.dst = h.dst GROUP BY h.src),
    hr AS (SELECT src, ln(avg(dist) + 1e-12) AS a FROM h GROUP BY src), lr AS (SELECT src, ln(avg(dist) + 1e-12) AS b FROM l WHERE rank <= 15 GROUP BY src)
    SELECT (SELECT count(*) FROM n) AS anchors, (SELECT round(avg(recall), 6) FROM n) AS recall, (SELECT round(avg(ffr), 6) FROM n) AS ffr, (SELECT round(corr(a, b), 6) FROM hr JOIN lr USING (src)) AS density,
    (SELECT round(avg((x.label = y.label)::INTEGER), 6) FROM l JOIN z x ON x.id = src JOIN z y ON y.id = dst, f WHERE rank <= k) AS purity"""
)
def decision_panel(spark: SparkSession, root: str) -> DataFrame:
    """Recall at 10 and at a fixed fraction, density and purity, from one neighbour table of each side.

    Rows of space or map that aren't finite, or that are all the same, are an error before anything is scored.
    """
    k = _frac(points(spark, root).count())
    checks.require(_unscorable(spark, root), "rows that can't be scored")
    hi, lo = stage(space_knn(spark, root, 15), "hi"), stage(map_knn(spark, root, max(k, 15)), "lo")
    met = hi.select("src", "dst", F.col("rank").alias("h")).join(lo.select("src", "dst", F.col("rank").alias("l")), ["src", "dst"], "left")
    hit = lambda r: F.sum(((F.col("h") <= 10) & F.coalesce(F.col("l") <= r, F.lit(False))).cast("int")) / 10
    n = met.groupBy("src").agg(hit(10).alias("recall"), hit(k).alias("ffr"))
    top = n.agg(F.count("*").alias("anchors"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ffr"), 6).alias("ffr"))
    density = metrics.density_preservation(hi, lo.where("rank <= 15")).select(r6("density"))
    purity = metrics.label_agreement(lo.where(F.col("rank") <= k), flat_map(spark, root).select("id", "label")).agg(F.round(F.avg("share"), 6).alias("purity"))
    return top.crossJoin(density).crossJoin(purity)


def _unscorable(spark: SparkSession, root: str) -> DataFrame:
    """``id``: rows without a finite vector or place, and all rows of a map that has collapsed to a point."""
    z = flat_map(spark, root)
    bad = F.exists(vec.doubles("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    broken = points(spark, root).where(F.col("v").isNull() | bad).select("id").union(z.where("x IS NULL OR y IS NULL OR isnan(x) OR isnan(y)").select("id"))
    spread = z.agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    return broken.union(spread.where("n > 1 AND w = 0 AND h = 0").select(F.lit(-1).cast("bigint").alias("id")))


@query()
def space_passport(spark: SparkSession, root: str) -> DataFrame:
    """All geometry of one space in a row."""
    return anisotropy(spark, root).crossJoin(uniformity(spark, root)).crossJoin(twonn_dimension(spark, root)).crossJoin(pca_spectrum(spark, root))


@query(f"WITH {E}, {Z}, c AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM z WHERE id % {ASK} <> 0) SELECT id, round(sqrt((vy * pow(x - mx, 2) - 2 * vxy * (x - mx) * (y - my) + vx * pow(y - my, 2)) / (vx * vy - vxy * vxy)), 6) AS mahalanobis FROM z, c WHERE id % {ASK} = 0")
def mahalanobis(spark: SparkSession, root: str) -> DataFrame:
    """Distance of asked rows from the cloud of the others, in its own spread."""
    z = flat_map(spark, root)
    c = z.where(F.col("id") % ASK != 0).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    d2 = (F.col("vy") * dx * dx - 2 * F.col("vxy") * dx * dy + F.col("vx") * dy * dy) / (F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy"))
    return asked(z).crossJoin(F.broadcast(c)).select("id", F.round(F.sqrt(d2), 6).alias("mahalanobis"))


@query(f"WITH {Z}, r AS (SELECT id, x, row_number() OVER (ORDER BY x, id) AS i, count(*) OVER () AS n FROM z) SELECT id, round(i / (n + 1), 6) AS ecdf FROM r")
def empirical_cdf(spark: SparkSession, root: str) -> DataFrame:
    """rank / (n + 1), the rank by a prefix sum over ranges of the value."""
    z = stage(flat_map(spark, root).select("id", "x").repartitionByRange(32, "x", "id").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = z.groupBy("part").agg(F.count("*").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    i = F.row_number().over(Window.partitionBy("part").orderBy("x", "id")) + F.col("start")
    return z.join(start, "part").select("id", F.round(i / (F.col("total") + 1), 6).alias("ecdf"))


