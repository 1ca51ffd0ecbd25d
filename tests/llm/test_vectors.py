import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.llm import neighbours
from quillmap.llm.clusters import SimilarityClusters, similarity_clusters
from quillmap.llm.neighbours import nearest_vectors
from quillmap.llm.vectors import greedy_pivots, top_cosines, units

SCHEMA = "vec_id long, vector array<float>, id int, neighbor string, v int"


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [None if a is None else float(a) for a in v], 1, "clash", 2) for i, v in enumerate(x)], SCHEMA)


def mixture(n, width, groups, seed, spread=0.15, noise=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width)) + 1
    share = 1 / np.arange(1, groups + 1)
    at = rng.choice(groups, n, p=share / share.sum())
    x = centres[at] + rng.normal(size=(n, width)) * spread * np.sqrt(2)
    lost = rng.random(n) < noise
    x[lost] = rng.normal(size=(lost.sum(), width)) + 1
    return (x * rng.uniform(0.1, 10, (n, 1))).astype(np.float32)


def brute(x, ids, k, q=None, qid=None):
    w = x.astype(np.float64)
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = w if q is None else q.astype(np.float64) / np.linalg.norm(q.astype(np.float64), axis=1)[:, None]
    out = {}
    for i, row in enumerate(v):
        s = np.round(w @ row, 12)
        if q is None:
            s[i] = -9
        o = [j for j in np.lexsort((ids, -s)) if s[j] > -2][:k]
        out[int(ids[i] if qid is None else qid[i])] = [int(ids[j]) for j in o]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("side", "id", "rank").collect():
        out.setdefault((r["side"], r["id"]), []).append(r["neighbor"])
    return out


def test_block_search_with_ties():
    x = np.repeat(np.random.default_rng(0).normal(size=(20, 8)).astype(np.float32), 30, axis=0)
    ids = np.random.default_rng(1).permutation(600)
    r, c, _ = top_cosines(x, ids, x, ids, 5)
    want = brute(x, ids, 5)
    got = {}
    for a, b in zip(r, c):
        got.setdefault(int(ids[a]), set()).add(int(ids[b]))
    assert got == {k: set(v) for k, v in want.items()}


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 400), st.integers(2, 5), st.integers(0, 99))
def test_block_search(n, width, seed):
    x = np.random.default_rng(seed).integers(-2, 3, (n, width)).astype(np.float32)
    x[(x == 0).all(axis=1), 0] = 1
    ids = np.arange(n) * 3
    r, c, s = top_cosines(x, ids, x, ids, 4)
    got = {int(i): [] for i in ids}
    for a, b, t in sorted(zip(r.tolist(), c.tolist(), s.tolist()), key=lambda z: (z[0], -z[2], z[1])):
        got[int(ids[a])].append(int(ids[b]))
    assert got == brute(x, ids, 4)


def test_greedy_pivots_are_one_by_one():
    x = units(np.random.default_rng(2).normal(size=(300, 3)))
    want = []
    for i in range(300):
        if all(x[i] @ x[j] < 0.9 for j in want):
            want.append(i)
    assert greedy_pivots(x, 0.9, block=32).tolist() == want
    assert greedy_pivots(x, 0.9, most=5).tolist() == want[:5]
    rest = greedy_pivots(x[100:], 0.9, known=x[[i for i in want if i < 100]])
    assert (rest + 100).tolist() == [i for i in want if i >= 100]


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[k]) == len(v) for k, v in want.items())
    return sum(len(set(got[k]) & set(v)) for k, v in want.items()) / sum(map(len, want.values()))


SMALL = {"sample": 1000, "block": 100, "shelf": 300, "keep": 64}


def truth(x, q, k):
    return {("corpus", i): v for i, v in brute(x, np.arange(len(x)), k).items()} | {("query", i): v for i, v in brute(x, np.arange(len(x)), k, q, np.arange(len(q))).items()}


def test_recall_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "READERS", 100)
    x, q = mixture(3000, 24, 40, 3), mixture(150, 24, 40, 3)
    got = lists(nearest_vectors(table(spark, x), "vec_id", "vector", 24, 10, table(spark, q), "vec_id", "vector", **SMALL))
    want = truth(x, q, 10)
    assert recall(got, want) >= 0.9
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    tenth = {k: unit[k[1]] @ unit[v[-1]] for k, v in want.items() if k[0] == "corpus"}
    far = [k for k, c in tenth.items() if c < 0.8]
    assert len(far) > 100 and recall({k: got[k] for k in far}, {k: want[k] for k in far}) >= 0.9


def test_exact_setting(spark):
    x, q = mixture(1200, 12, 20, 4), mixture(50, 12, 20, 4)
    x[100:400] = x[100]  # a hot vector, and the file of a group that is split into parts
    got = lists(nearest_vectors(table(spark, x), "vec_id", "vector", 12, 7, table(spark, q), "vec_id", "vector", exact=True, **SMALL))
    assert got == truth(x, q, 7)


def test_footrule_ranks():
    rng = np.random.default_rng(7)
    asked, met = (np.argsort(rng.random((n, 90)), axis=1)[:, :56].astype(np.int32) for n in (9, 200))
    place = lambda row: {p: t // neighbours.STEP for t, p in enumerate(row)}
    end = 56 // neighbours.STEP
    want = np.zeros((9, 200), int)
    for i, a in enumerate(map(place, asked)):
        for j, b in enumerate(map(place, met)):
            want[i, j] = sum(abs(a.get(p, end) - b.get(p, end)) for p in a.keys() | b.keys())
    got = neighbours.footrule_first(asked, met, 20)
    for i in range(9):
        assert (got[i] == (want[i] <= np.sort(want[i])[19])).all()


def test_bounds_of_files():
    pivots = units(np.random.default_rng(8).normal(size=(12, 6)))
    count = np.full(12, 30)
    count[3] = 0
    each = np.arange(12)
    ix = neighbours.PermutationIndex(pivots, count, np.full(12, 0.9), np.full(12, 0.7), each, each // 3, np.ones(4, np.int64), np.ones(4, np.int64), 3.0, 10, 5, 0.8)
    rows = units(np.random.default_rng(9).normal(size=(50, 6)))
    likely = ix.likely(rows @ pivots.T)
    assert (likely[:, 3] == -2).all() and (ix.opening((rows @ pivots.T).max(axis=1)) >= likely.max(axis=1) - 1e-5).all()
    for n, blocks in ix.asks(rows, np.full(50, 0.8)):
        assert set(blocks) == {f for f in range(12) if likely[n, f] >= 0.8 - 1e-6}
    assert ix.by_shelf(np.array([0, 2, 4, 11])) == [(0, 5), (1, 2), (3, 4)]


def test_index_is_fitted_on_what_is_posted(spark, monkeypatch):
    x = np.concatenate([np.tile(mixture(1, 12, 1, 5), (300, 1)), mixture(200, 12, 10, 6)])
    fitted = []
    fit = neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a, **s: fitted.append(fit(*a, **s)) or fitted[-1])
    nearest_vectors(table(spark, x), "vec_id", "vector", 12, 5)
    assert fitted[0].count.sum() == 201


def test_copies_unusable_and_ties(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 4)).astype(np.float32)
    x = [*base, *[base[0]] * 30, base[1] * 2, None, [], [1, 2], [0, 0, 0, 0], [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [None, 1, 1, 1]]
    got = lists(nearest_vectors(table(spark, x), "vec_id", "vector", 4, 5, table(spark, [base[0], None, [0] * 4], 900), "vec_id", "vector"))
    usable = np.array([v for v in x[:37]], np.float32)
    want = {("corpus", k): v for k, v in brute(usable, np.arange(37), 5).items()}
    assert got == want | {("query", 900): [0, 6, 7, 8, 9]}


def test_small_and_empty(spark):
    one = table(spark, [[1, 0]])
    assert nearest_vectors(one, "vec_id", "vector", 2, 3).count() == 0
    assert nearest_vectors(one.where("false"), "vec_id", "vector", 2, 3, one, "vec_id", "vector").count() == 0
    two = nearest_vectors(table(spark, [[1, 0], [1, 0]]), "vec_id", "vector", 2, 3).collect()
    assert sorted((r["id"], r["neighbor"], r["similarity"]) for r in two) == [(0, 1, 1.0), (1, 0, 1.0)]


def test_hardly_any_usable_row(spark):
    x = [None] * 400 + [[1, 0], [1, 0.1], [0, 1]] + [[0, 0]] * 400
    got = lists(nearest_vectors(table(spark, x), "vec_id", "vector", 2, 1, sample=2))
    assert got == {("corpus", 400): [401], ("corpus", 401): [400], ("corpus", 402): [401]}
    found = similarity_clusters(table(spark, x), "vec_id", "vector", 2, 0.85, 1, batch=2).collect()
    assert sorted(tuple(r) for r in found) == [(400, 400, 2), (401, 400, 2), (402, 402, 1)]


def components(x, least):
    w = x.astype(np.float64)
    w /= np.linalg.norm(w, axis=1)[:, None]
    n, label = len(w), list(range(len(w)))
    s = w @ w.T >= least
    for i in range(n):
        stack, seen = [i], {i}
        while stack:
            for j in np.flatnonzero(s[stack.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    stack.append(int(j))
        label[i] = min(seen)
    return label


def chain(n, step, width=6):
    a = np.arange(n) * step
    x = np.zeros((n, width), np.float32)
    x[:, 0], x[:, 1] = np.cos(a), np.sin(a)
    return x


@pytest.mark.parametrize("batch", [16_384, 40])
@pytest.mark.parametrize("kind", ["mixture", "chain", "loose"])
def test_clusters_are_components(spark, batch, kind):
    x = {"mixture": mixture(500, 12, 15, 6), "chain": np.concatenate([chain(12, 0.5), mixture(80, 6, 4, 2)]), "loose": mixture(300, 4, 30, 8, 0.4)}[kind]
    x = x[np.random.default_rng(1).permutation(len(x))]
    label = components(x, 0.85)
    size = {c: label.count(c) for c in set(label)}
    got = {(r["i"], r["first"], r["size"]) for r in similarity_clusters(table(spark, x), "vec_id", "vector", x.shape[1], 0.85, 3, batch=batch).collect()}
    assert got == {(i, c, size[c]) for i, c in enumerate(label) if size[c] >= 3}


def test_links_between_members_only(spark):
    """Two tight groups whose pivots are apart, with one pair of members just similar enough."""
    rng = np.random.default_rng(9)
    a = np.array([1, 0, 0, 0, 0, 0.0]) + rng.normal(size=(30, 6)) * 0.02
    turn = np.arccos(0.85) + 0.25
    b = np.array([np.cos(turn), np.sin(turn), 0, 0, 0, 0]) + rng.normal(size=(30, 6)) * 0.02
    x = np.concatenate([a, b, [[np.cos(0.13), np.sin(0.13), 0, 0, 0, 0], [np.cos(turn - 0.13), np.sin(turn - 0.13), 0, 0, 0, 0]]]).astype(np.float32)
    label = components(x, 0.85)
    got = {(r["i"], r["first"]) for r in similarity_clusters(table(spark, x), "vec_id", "vector", 6, 0.85, 1).collect()}
    assert got == set(enumerate(label))


def test_cluster_edge_cases(spark):
    x = [[1, 0], [2, 0], [1, 0], None, [0, 0], [float("nan"), 1], [1], [-1, 0.1]]
    got = sorted(tuple(r) for r in similarity_clusters(table(spark, x), "vec_id", "vector", 2, 0.85, 1).collect())
    assert got == [(0, 0, 3), (1, 0, 3), (2, 0, 3), (7, 7, 1)]
    assert similarity_clusters(table(spark, x).where("false"), "vec_id", "vector", 2, 0.85).count() == 0


def test_description(spark):
    x = mixture(400, 8, 5, 11, 0.1, 0)
    c = SimilarityClusters(table(spark, x), "vec_id", "vector", 8, 0.85)
    u = units(x).astype(np.float64)
    label = np.array(components(x, 0.85))
    for r in c.described(5, 3).collect():
        mine = np.flatnonzero(label == r["first"])
        assert r["size"] == len(mine)
        score = u[mine] @ u[mine].sum(axis=0)
        assert r["medoid"] == r["typical"][0] and abs(score[list(mine).index(r["medoid"])] - score.max()) < 1e-4
