import pytest
from pyspark.sql import functions as F

from quillmap.plans import programs, registry, tables

ROOT = "/root/testdata/sf0.1"  # 2,000 rows


def rows(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, ROOT).collect()]


def test_panels_take_the_share_of_the_table(spark):
    assert rows(spark, "decision_panel")[0]["ffr"] == rows(spark, "fixed_fraction_recall")[0]["ffr"]
    outside = rows(spark, "out_of_domain_panel")
    assert len(outside) > 1 and len({round(r["ffr"] / r["retention"], 3) for r in outside if r["retention"]}) == 1


def test_teacher_is_checked_for_all_rows(spark, monkeypatch):
    assert len(rows(spark, "teacher_targets")) == 2000
    whole = programs.flat_map
    monkeypatch.setattr(programs, "flat_map", lambda *a: whole(*a).where(F.col("id") != 1500))
    with pytest.raises(ValueError, match="rows without a teacher"):
        rows(spark, "teacher_targets")


def test_grassmann_takes_tables_below_its_sample_whole(spark):
    score = rows(spark, "grassmann_score")[0]["score"]
    assert score == tables._grassmann(spark, ROOT, 2000).head()["score"]
    assert score != tables._grassmann(spark, ROOT, 500).head()["score"]
