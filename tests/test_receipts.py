import json

import pytest

from quillmap.operators import receipts
from quillmap.operators.artefacts import check_seal

OLD = {"model_id": "encoder/small", "model_revision": "0123456789abcdef0123456789abcdef01234567", "prompt_bytes_hex": "", "pooling": "mean", "normalization": "l2", "dimensions": 64, "dtype": "float32"}


def test_conventions():
    new = receipts.convention(OLD)
    assert new["prompt_policy"] == "raw_unprompted" and new["source_dtype"] == new["storage_dtype"] == "float32" and new["dtype_conversion"] == "identity_v1"
    assert receipts.convention(new) == new and receipts.convention(OLD | {"prompt_bytes_hex": "71"})["prompt_policy"] == "literal_prefix"
    wrong = {"model_id": "unknown", "model_revision": "0" * 40, "prompt_bytes_hex": "7Z", "pooling": "max", "normalization": "l1", "dimensions": True, "dtype": "int8"}
    for field, value in wrong.items():
        with pytest.raises(ValueError, match="convention"):
            receipts.convention(OLD | {field: value})
    for value in ({k: v for k, v in OLD.items() if k != "dtype"}, OLD | {"more": 1}, new | {"prompt_policy": "literal_prefix"}, new | {"source_dtype": "float16"}):
        with pytest.raises(ValueError, match="convention"):
            receipts.convention(value)


def test_types(spark):
    df = spark.range(3).selectExpr("id", "array(1.0f) AS v")
    check_seal(receipts.type_receipt(df, {"id": "bigint", "v": "array<float>"}))
    for declared in ({"id": "int"}, {"w": "int"}):
        with pytest.raises(ValueError, match="types"):
            receipts.type_receipt(df, declared)


def test_packs_are_checked_again(spark, tmp_path):
    paths = {n: f"file://{tmp_path}/{n}" for n in ("a", "b")}
    for n, path in enumerate(paths.values()):
        spark.range(5 + n).write.parquet(path)
    pack = receipts.assemble_pack(spark, paths)
    assert {k: df.count() for k, df in receipts.reopen_pack(spark, json.loads(json.dumps(pack))).items()} == {"a": 5, "b": 6}
    with pytest.raises(ValueError, match="seal"):
        receipts.reopen_pack(spark, pack | {"members": {}})
    spark.range(6).write.mode("overwrite").parquet(paths["b"])
    with pytest.raises(ValueError, match="b"):
        receipts.reopen_pack(spark, pack)


def test_manifests_and_results(spark, tmp_path):
    manifest = receipts.run_manifest(spark, {"k": 10}, {"t": spark.range(4)})
    check_seal(manifest)
    assert manifest["tables"]["t"]["rows"] == 4
    for name, text in (("x/r.json", '{"score": 1.5}'), ("y/r.json", '{"score": 2}'), ("z/r.json", "[1]"), ("w/r.json", '{"cut')):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = receipts.result_files(spark, f"file://{tmp_path}/*/r.json").selectExpr("file", "variant_get(result, '$.score', 'double') AS score").collect()
    assert sorted((r["file"].rsplit("/", 2)[1], r["score"]) for r in found) == [("x", 1.5), ("y", 2.0)]


def test_earlier_panels(spark):
    now, prior = (spark.createDataFrame(x, "k string, v double") for x in ([("a", 0.5), ("b", 0.25), ("c", None)], [("a", 0.25), ("c", 1.0), ("d", 1.0)]))
    got = sorted(map(tuple, receipts.against_prior(now, prior, "k", "v").collect()))
    assert got == [("a", 0.5, 0.25, 0.25), ("b", 0.25, None, None), ("c", None, 1.0, None)]
