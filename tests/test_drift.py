import json
from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.functions.jsontext import _parse_deep, canonical, parse
from quillmap.operators import drift, trees
from quillmap.operators.trees import edit_script

START = datetime(2031, 1, 1)
SCHEMA = "line_id long, stream string, file_name string, written_at timestamp, body string, kind string, path int"


def lines(spark, files):
    """files: (stream, name, hour, [records or raw text])."""
    rows, n = [], 0
    for stream, name, hour, records in files:
        for r in records:
            rows.append((n, stream, name, START + timedelta(hours=hour), r if r is None or isinstance(r, str) else json.dumps(r), "clash", 1))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def report(spark, files):
    return sorted(tuple(r) for r in drift.changes(lines(spark, files)).collect())


def test_all_kinds_of_change(spark):
    first = [{"run_dir": "a", "x": 1, "gone": "s", "p": {"k": 2}, "same": None, "t": 1}, {"run_dir": "b", "x": 3, "gone": None, "p": {"k": 4}, "t": 2}]
    later = [{"run_dir": "a", "y": 1.0, "p": {"kk": 2}, "same": 5, "t": "1", "new": True}, {"run_dir": "b", "y": 3, "p": {"kk": 4}, "t": "2"}, {"run_dir": "c", "y": 9}, '{"run_dir": "d", "cut']
    want = [("f2", "added", "", "new"), ("f2", "removed", "gone", ""), ("f2", "renamed", "p.k", "p.kk"), ("f2", "renamed", "x", "y"), ("f2", "retyped", "t", "t")]
    # The later file arrives first; lines are repeated.
    assert report(spark, [("s", "f2", 2, later + later), ("s", "f1", 1, first)]) == want


def test_objects_are_not_renamed_and_no_shared_run_is_no_evidence(spark):
    a = [{"run_dir": "a", "o": {"v": 1}}]
    assert report(spark, [("s", "1", 1, a), ("s", "2", 2, [{"run_dir": "a", "q": {"v": 1}}])]) == [("2", "added", "", "q"), ("2", "removed", "o", ""), ("2", "renamed", "o.v", "q.v")]
    assert report(spark, [("s", "1", 1, a), ("s", "2", 2, [{"run_dir": "z", "q": {"v": 1}}])]) == [("2", "added", "", "q"), ("2", "added", "", "q.v"), ("2", "removed", "o", ""), ("2", "removed", "o.v", "")]


def test_empty_null_and_broken(spark):
    assert report(spark, []) == []
    assert report(spark, [("s", "1", 1, [None, "", "[1]", '{"a"']), ("s", "2", 2, [{"run_dir": "a"}])]) == []
    assert report(spark, [("s", "1", 1, [{"run_dir": None, "a": "x" * 200_000}]), ("s", "2", 2, [{"run_dir": None, "b": "x" * 200_000}])]) == [("2", "added", "", "b"), ("2", "removed", "a", "")]


def test_consistent_names_follow_renames(spark):
    files = [("s", str(i), i, [{"run_dir": "a", n: 7, "z": i}]) for i, n in enumerate(("x", "y", "w"))]
    table = lines(spark, files)
    members = drift.member_rows(table, ["line_id", *drift.FILE])
    named = drift.consistent(members, drift.edit_scripts(table)).where("value = '7'")
    assert sorted((r["file_name"], r["path"], r["name"]) for r in named.collect()) == [("0", "x", "w"), ("1", "y", "w"), ("2", "w", "w")]
    wide = drift.wide_table(drift.consistent(members, drift.edit_scripts(table)), ["file_name"], ["w", "z"])
    assert sorted(tuple(r) for r in wide.collect()) == [("0", "7", "0"), ("1", "7", "1"), ("2", "7", "2")]


PATHS = st.sampled_from(["a", "b", "c", "o.x", "o.y", "p.x", "p.z", "q.o.x"])


def tree(paths):
    """Kinds of leaves and of the objects above them."""
    out = {}
    for p in paths:
        out[p] = ["number"]
        for i, c in enumerate(p):
            if c == ".":
                out[p[:i]] = ["object"]
    return out


def cheapest(old, new, agree):
    """The least cost over all one-to-one mappings of changed nodes, tried one after another."""
    gone, came = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    is_object = lambda p, t: "object" in t[p]
    below = lambda p, q: q.startswith(p + ".")
    fits = lambda a, b: (a, b) in agree or (is_object(a, old) and is_object(b, new) and any(below(a, x) and below(b, y) for x, y in agree))
    ways, least = [{}], float("inf")
    for a in gone:
        ways = [w | ({a: b} if b else {}) for w in ways for b in [None, *[b for b in came if fits(a, b) and b not in w.values()]]]
    for w in ways:
        cost = len(gone) + len(came) - 2 * len(w)
        for a, b in w.items():
            up, name = a.rpartition(".")[::2]
            other, new_name = b.rpartition(".")[::2]
            cost += 0.75 if up != other and w.get(up) != other else 0.5 if name != new_name else 0
        least = min(least, cost)
    return least


@settings(max_examples=150, deadline=None)
@given(st.sets(PATHS, max_size=5), st.sets(PATHS, max_size=5), st.randoms(use_true_random=False))
def test_script_is_the_cheapest(old, new, random):
    old, new = tree(old), tree(new)
    gone, came = ([p for p in sorted(x.keys() - y.keys()) if "object" not in x[p]] for x, y in ((old, new), (new, old)))
    agree = [(a, b) for a in gone for b in came if random.random() < 0.5]
    steps = edit_script(old, new, agree)
    assert sum(s[3] for s in steps) == cheapest(old, new, agree)
    mapped = [(s[1], s[2]) for s in steps if s[0] in ("renamed", "moved", "carried")]
    assert len({a for a, _ in mapped}) == len({b for _, b in mapped}) == len(mapped)
    alike = {(s[1], s[2]) for s in steps if s[0] == "alike"}
    assert {(s[1], s[2]) for s in steps if s[4] and s[0] in ("renamed", "moved", "carried", "alike")} == set(agree) and not alike & set(mapped)
    assert {s[1] for s in steps if s[1] and s[0] != "alike"} == old.keys() - new.keys() and {s[2] for s in steps if s[2] and s[0] != "alike"} == new.keys() - old.keys()


def test_an_object_is_renamed_at_one_step():
    old, new = tree(["m.o.x", "m.o.y", "m.o.z"]), tree(["m.p.x", "m.p.y", "m.p.z"])
    steps = edit_script(old, new, [(f"m.o.{c}", f"m.p.{c}") for c in "xyz"])
    assert [s[:4] for s in steps] == [("renamed", "m.o", "m.p", 0.5), *[("carried", f"m.o.{c}", f"m.p.{c}", 0.0) for c in "xyz"]]


def test_many_ways_to_map_objects():
    old, new = tree([f"a{i}.v" for i in range(7)]), tree([f"b{i}.v" for i in range(7)])
    steps = edit_script(old, new, [(f"a{i}.v", f"b{j}.v") for i in range(7) for j in range(7)])
    assert sum(s[3] for s in steps) == 7 * 0.5


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment(n, m, random):
    gain = np.array([[random.choice([0, 1.25, 1.5, 2]) for _ in range(m)] for _ in range(n)])
    got = trees.assignment(gain)
    best = max(sum(gain[r, c] for r, c in zip(range(n), p)) for p in permutations(range(m), n)) if n <= m else max(sum(gain[r, c] for c, r in zip(range(m), p)) for p in permutations(range(n), m))
    assert sum(gain[r, c] for r, c in got) == best and len(got) == min(n, m)


def test_equal_values_under_several_names(spark):
    first, later = [{"run_dir": r, "a": n, "b": n, "c": True} for n, r in enumerate("pqr")], [{"run_dir": r, "d": n, "e": False, "f": n} for n, r in enumerate("pqr")]
    files = [("s", "1", 1, first), ("s", "2", 2, later)]
    assert report(spark, files) == [("2", "added", "", "e"), ("2", "removed", "c", ""), *[("2", "renamed", a, b) for a in "ab" for b in "df"]]
    steps = sorted((r["step"], r["old_path"], r["new_path"]) for r in drift.edit_scripts(lines(spark, files)).collect())
    assert steps == [("added", "", "e"), ("alike", "a", "f"), ("alike", "b", "d"), ("removed", "c", ""), ("renamed", "a", "d"), ("renamed", "b", "f")]


DEEP = 30_000


def test_deep_nesting(spark):
    deep = "[" * DEEP + '"x", {"k": 1.0}' + "]" * DEEP
    assert canonical(parse(deep)) == "[" * DEEP + '"x",{"k":1}' + "]" * DEEP
    files = [("s", "1", 1, ['{"run_dir": "a", "u": ' + deep + "}"]), ("s", "2", 2, ['{"run_dir": "a", "w": ' + deep + "}"])]
    assert report(spark, files) == [("2", "renamed", "u", "w")]


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20), st.integers(0, 60))
def test_deep_parser_is_the_parser(value, cut):
    text = json.dumps(value, indent=1)
    assert _parse_deep(text) == value
    broken = text[:cut] if cut < len(text) else text + "]"
    try:
        want = json.loads(broken)
    except ValueError:
        want = ValueError
    try:
        got = _parse_deep(broken)
    except ValueError:
        got = ValueError
    assert got == want


def test_long_chains_and_names_used_again(spark):
    names = ["a", "b", "c", "a", "d", "e", "f", "g", "b"]
    files = [("s", f"{i:02d}", i, [{"run_dir": "r", n: 7, "other": i}]) for i, n in enumerate(names)]
    table = lines(spark, files)
    members = drift.member_rows(table, ["line_id", *drift.FILE])
    named = drift.consistent(members, drift.edit_scripts(table)).where("value = '7' AND path != 'other'")
    assert sorted((r["file_name"], r["path"], r["name"]) for r in named.collect()) == [(f"{i:02d}", n, "b") for i, n in enumerate(names)]
