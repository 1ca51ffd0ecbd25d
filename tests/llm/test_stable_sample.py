import random

from quillmap.llm.queries import p1_sample
from quillmap.llm.stable_sample import SampleState, audit_receipts, stable_sample

ROWS = "testbed_id int, row_id long, snapshot_no int, first_epoch string, rate string"
RECEIPTS = "receipt_id long, testbed_id int, snapshot_no int, seed long, anchor_seed int, sample_indices array<long>, recorded_at timestamp, records string"


def rows(spark, upto, n=600):
    return spark.createDataFrame([(t, i * 7 + t, 1 + i % 5, "clash", "clash") for t in (1, 2) for i in range(n) if 1 + i % 5 <= upto], ROWS)


def drawn(df):
    return {(r["testbed_id"], r["row_id"]) for r in df.collect()}


def test_selected_rows_stay_selected(spark):
    before = set()
    for upto in range(1, 6):
        now = drawn(stable_sample(rows(spark, upto), ["testbed_id"], "row_id", "snapshot_no", 42, 7, 40))
        assert before <= now
        before = now
    shuffled = rows(spark, 5).union(rows(spark, 5)).repartition(11)
    assert drawn(stable_sample(shuffled, ["testbed_id"], "row_id", "snapshot_no", 42, 7, 40)) == before
    assert drawn(stable_sample(rows(spark, 5), ["testbed_id"], "row_id", "snapshot_no", 43, 7, 40)) != before
    assert 40 < len([x for x in before if x[0] == 1]) < 160


def test_late_rows_change_no_rate(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    pick = lambda table, seed=42: drawn(stable_sample(table, ["testbed_id"], "row_id", "snapshot_no", seed, 7, 20, state))
    first = rows(spark, 2, 100)
    before = pick(first)
    assert 0 < len(before) < first.count()
    rates = {(r["testbed_id"], r["first_epoch"]): r["rate"] for r in SampleState(spark, state).read("rates", "testbed_id int, first_epoch int, rate double").collect()}
    late = spark.createDataFrame([(t, 10_000 + i, 1, "", "") for t in (1, 2) for i in range(3000)], ROWS)
    known_earlier = spark.createDataFrame([(t, i, 0, "", "") for t, i in before], ROWS)
    grown = first.union(late).union(known_earlier)
    after = pick(grown)
    assert before <= after and any(i >= 10_000 for _, i in after)
    assert pick(grown.repartition(7)) == after and pick(late) == after
    now = {(r["testbed_id"], r["first_epoch"]): r["rate"] for r in SampleState(spark, state).read("rates", "testbed_id int, first_epoch int, rate double").collect()}
    assert all(now[k] == v for k, v in rates.items())
    assert pick(grown, 43) != after and pick(grown) == after


def test_a_run_that_breaks_off_leaves_the_state(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    args = (["testbed_id"], "row_id", "snapshot_no", 42, 7, 20, state)
    before = drawn(stable_sample(rows(spark, 2, 100), *args))
    (tmp_path / "state" / "run-00000001-x" / "ledger").mkdir(parents=True)
    assert drawn(stable_sample(rows(spark, 2, 100), *args)) == before
    assert before <= drawn(stable_sample(rows(spark, 4, 200), *args))


def test_registered_query_loses_no_record(spark, tmp_path):
    schema = "delivery_id long, testbed_id int, row_id long, snapshot_no int"
    path = f"file://{tmp_path}/testbed_rows.parquet"
    table = spark.createDataFrame([(i, 1, 3 * i, 1 + i % 2) for i in range(1500)], schema)
    table.write.parquet(path)
    before = drawn(p1_sample(spark, f"file://{tmp_path}"))
    spark.createDataFrame([(5000 + i, 1, 9000 + i, 1) for i in range(1000)], schema).write.mode("append").parquet(path)
    after = drawn(p1_sample(spark, f"file://{tmp_path}"))
    assert 0 < len(before) < 1500 and before < after


def test_rows_without_ids_and_empty_tables(spark):
    bad = spark.createDataFrame([(None, 1, 1, "", ""), (1, None, 1, "", ""), (1, 5, None, "", ""), (1, 6, 2, "", ""), (1, 6, 1, "", "")], ROWS)
    got = stable_sample(bad, ["testbed_id"], "row_id", "snapshot_no", 1, None, 10).collect()
    assert [(r["row_id"], r["first_epoch"], r["rate"]) for r in got] == [(6, 1, 1.0)]
    assert stable_sample(bad.where("false"), ["testbed_id"], "row_id", "snapshot_no", 1, 1, 10).count() == 0


def brute(receipts):
    seen = {}
    for r in receipts:
        seen.setdefault(r[0], r)
    out = set()
    for a in seen.values():
        for b in seen.values():
            if a[0] < b[0] and None not in (*a[1:6], *b[1:6]) and (a[1], a[3], a[4]) == (b[1], b[3], b[4]):
                x, y = ({v for v in r[5] if v is not None} for r in (a, b))
                if a[2] == b[2]:
                    bad = x != y
                else:
                    bad = bool(x - y if a[2] < b[2] else y - x)
                if bad:
                    out.add((a[0], b[0]))
    return out


def test_audit_is_brute_force(spark):
    rng = random.Random(5)
    data = []
    for i in range(220):
        base = list(range(rng.randint(0, 6)))
        extra = [rng.choice([None, 3, 99])] if rng.random() < 0.3 else []
        data.append((i, rng.choice([1, 1, 2, None]), rng.choice([1, 2, 3, None]), rng.choice([5, 5, None]), rng.choice([7, 7, 7, None]), rng.choice([None, base + extra + base, base + extra, base + extra]), None, "clash"))
    df = spark.createDataFrame(data + data[:30], RECEIPTS)
    got = [tuple(r) for r in audit_receipts(df.repartition(5)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)
    assert audit_receipts(df.where("false")).count() == 0


def test_hot_group_is_sliced(spark, monkeypatch):
    monkeypatch.setattr("quillmap.llm.stable_sample.SLICE", 5)
    rng = random.Random(6)
    data = [(i, 1, rng.randint(1, 4), 5, 7, rng.sample(range(6), rng.randint(0, 6)), None, "") for i in range(60)]
    assert {tuple(r) for r in audit_receipts(spark.createDataFrame(data, RECEIPTS)).collect()} == brute(data)


def test_sound_receipts(spark):
    data = [(i, 1, 1 + i // 3, 5, 7, list(range(10 * (1 + i // 3))), None, "") for i in range(12)]
    assert audit_receipts(spark.createDataFrame(data, RECEIPTS)).count() == 0
