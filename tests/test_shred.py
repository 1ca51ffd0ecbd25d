import json

from quillmap.operators.shred import Shredded, adjacency, parse_record, shred, shred_columns
from quillmap.plans.evidence import EvidenceTables, children_found

REGISTRY = "registry_id long, events array<struct<event_id:string,source_signatures:array<struct<path:string,sha256:string>>>>"


def rebuilt(nodes):
    """A value from its adjacency rows: an exact round trip."""
    below = {}
    for n in sorted(nodes, key=lambda r: (r[1], r[3])):
        below.setdefault(n[1], []).append(n)

    def value(n):
        if n[4] == "object":
            return {c[2]: value(c) for c in below.get(n[0], [])}
        if n[4] == "array":
            return [value(c) for c in below.get(n[0], [])]
        return None if n[4] == "null" else n[5] if n[4] == "string" else json.loads(n[5])

    return value(below[-1][0])


def test_round_trip():
    v = {"a": [1, {"b": None, "c": [[], {}, "x"]}, True], "": 2.5, "d": {"e": {"f": "ü\u0000"}}}
    assert rebuilt(list(adjacency(v))) == v


def test_wrapped_and_broken_bodies():
    assert parse_record('{"payload": {"runs": {}}}') == {"runs": {}}
    assert parse_record(json.dumps(json.dumps({"runs": {"a": {}}}))) == {"runs": {"a": {}}}
    assert parse_record('{"runs": {}, "payload": {"runs": 1}}', content=("runs",)) == {"runs": {}, "payload": {"runs": 1}}
    for bad in (None, "", "  ", '{"a": 1', "[1]", "3", '"x"', "null", "[" * 100_000):
        assert parse_record(bad) is None


def found(spark, bodies, registry=()):
    docs = spark.createDataFrame([(i, b, "clash", 1) for i, b in bodies], "record_id long, body string, node string, doc int")
    reg = spark.createDataFrame(list(registry), REGISTRY)
    return {tuple(r) for r in children_found(docs, reg).collect()}


def test_children_of_all_forms(spark):
    panel = {"purity": {"k64": 0.5, "k256": None, "k1": []}}
    as_object = {"runs": {"a": {"run_dir": "r", "panel_full": panel}, "b": None, "c": 3}, "corpora": {"x": {"paired_deltas": {"p": {"m": {"mean": 1}, "n": None}}}}}
    as_array = {"runs": [{"label": "a", "panel_full": panel}, None, {"run_dir": "nameless"}], "corpora": [{"corpus": "x", "paired_deltas": [{"contrast": "p", "metric": "m"}, None]}]}
    want = {("run", "", "a"), ("panel", "a", "panel_full"), ("purity", "a", "k64"), ("purity", "a", "k1"), ("corpus", "", "x"), ("delta", "x", "p/m")}
    got = found(spark, [(1, json.dumps(as_object)), (1, json.dumps(as_object)), (2, json.dumps(as_array)), (3, json.dumps({"payload": as_array})), (4, json.dumps(as_object)[:-9]), (5, None), (6, "")])
    assert got == {("evidence_docs", i, *w) for i in (1, 2, 3) for w in want}


def test_registry_nulls_and_empty_tables(spark):
    rows = [
        (1, [("e", [("p", None), ("p", None), None, ("q", "s")]), None, ("f", None)]),
        (1, [("e", [("p", None)])]),
        (2, None),
        (3, []),
    ]
    got = found(spark, [], rows)
    s = "status_registry"
    assert got == {(s, 1, "event", "", "e"), (s, 1, "event", "", "f"), (s, 1, "signature", "e", "p"), (s, 1, "signature", "e", "q")}
    assert found(spark, []) == set()


def test_long_body_and_deep_nesting(spark):
    deep = json.dumps({"runs": {"a": {"x": "y" * 500_000}}})
    v = 1
    for _ in range(300):
        v = {"n": [v]}
    df = spark.createDataFrame([(1, deep), (2, json.dumps(v))], "k long, b string")
    counts = {r["k"]: r["count"] for r in shred(df, "k", "b").groupBy("k").count().collect()}
    assert counts == {1: 4, 2: 601}


def test_fields_pivot(spark):
    df = spark.createDataFrame([(1, '{"a": {"x": 1, "y": "s", "z": null}, "b": {"x": [1]}}')], "k long, b string")
    t = Shredded(shred(df, "k", "b"), "k")
    rows = {r["name"]: (r["x"], r["y"], r["z"]) for r in t.with_fields(t.children(t.root().selectExpr("*", "'object' AS kind"), "name"), "x", "y", "z").collect()}
    assert rows == {"a": ("1", "s", None), "b": (None, None, None)}


def test_nested_columns(spark):
    df = spark.createDataFrame([(7, [("e", None)], 1)], "k long, events array<struct<id:string,v:int>>, other int")
    rows = {(r["label"], r["kind"], r["scalar"]) for r in shred_columns(df, "k", "events").collect()}
    assert ("id", "string", "e") in rows and ("events", "array", None) in rows


def test_every_scalar_is_kept(spark):
    from quillmap.plans.evidence import values_found

    run = {"purity_k256": 0.5, "new": {"a.b": [1, None, {"c": True}]}, "no": None, "panel_full": {"n": 3, "guards": {"hit_guard": {"overselect": 8}}, "purity": {"k64": 0.25}}}
    body = {"seed": 7, "runs": {"a": run, "b": {}}, "corpora": [{"corpus": "x", "n_maps": 6, "arm_means": {"ffr": {"p": 0.5}}, "paired_deltas": [{"contrast": "p", "metric": "m", "mean": 1.5}]}]}
    docs = spark.createDataFrame([(1, json.dumps(body)), (1, json.dumps(body)), (2, None)], "record_id long, body string")
    got = {tuple(r)[1:] for r in values_found(docs).collect() if r["record_id"] == 1}
    assert got == {
        ("record", "", "", "seed", "number", "7"),
        ("run", "", "a", "purity_k256", "number", "0.5"),
        ("run", "", "a", "new.a\\.b.0", "number", "1"),
        ("run", "", "a", "new.a\\.b.2.c", "boolean", "true"),
        ("panel", "a", "panel_full", "n", "number", "3"),
        ("panel", "a", "panel_full", "guards.hit_guard.overselect", "number", "8"),
        ("panel", "a", "panel_full", "purity.k64", "number", "0.25"),
        ("corpus", "", "x", "corpus", "string", "x"),
        ("corpus", "", "x", "n_maps", "number", "6"),
        ("corpus", "", "x", "arm_means.ffr.p", "number", "0.5"),
        ("delta", "x", "p/m", "contrast", "string", "p"),
        ("delta", "x", "p/m", "metric", "string", "m"),
        ("delta", "x", "p/m", "mean", "number", "1.5"),
    }


def test_any_number_of_wrappings_and_levels(spark):
    wrapped = {"runs": {"a": {"run_dir": "d"}}}
    for n in range(24):
        wrapped = {"payload": wrapped} if n % 3 else json.dumps(wrapped)
    deep = '{"runs": {"b": {"run_dir": "e", "more": ' + "[" * 20_000 + "]" * 20_000 + "}}}"
    docs = spark.createDataFrame([(1, json.dumps(wrapped)), (2, deep), (3, deep[:-1])], "record_id long, body string")
    found = EvidenceTables(docs).runs.select("record_id", "run").collect()
    assert sorted(tuple(r) for r in found) == [(1, "a"), (2, "b")]
