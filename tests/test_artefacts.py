import pytest
from pyspark.sql import functions as F

from quillmap.operators import artefacts
from quillmap.sources import readers, sinks


def doubled(batch):
    return batch.assign(x=batch["x"] * 2)


def test_seals_and_configurations():
    r = artefacts.seal({"b": 1, "a": {"c": [1, 2]}})
    artefacts.check_seal(r)
    assert artefacts.seal(r) == r
    with pytest.raises(ValueError, match="seal"):
        artefacts.check_seal(r | {"b": 2})
    a, b = {"m": {"lr": 1, "k": 5}}, {"m": {"lr": 2, "k": 5, "z": None}}
    assert artefacts.config_difference(a, b) == {"m.lr": (1, 2), "m.z": (None, None)}
    artefacts.one_factor({"m": {"lr": 1}}, {"m": {"lr": 2}}, "m.lr")
    with pytest.raises(ValueError, match="differ"):
        artefacts.one_factor(a, b, "m.lr")
    assert artefacts.expand_sweep({"a": {"b": 0}}, {"a.b": [1, 2], "c": [3]}) == [{"a": {"b": 1}, "c": 3}, {"a": {"b": 2}, "c": 3}]


def test_keys_and_cache(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    assert artefacts.table_key(df, {}) == artefacts.table_key(df.repartition(5), {})
    assert artefacts.table_key(df, {}) != artefacts.table_key(df.where("id < 49"), {}) != artefacts.table_key(df, {"k": 1})
    built = []
    for _ in range(2):
        got = artefacts.cached(spark, str(tmp_path), "k", lambda: built.append(1) or df)
    assert got.count() == 50 and len(built) == 1


def test_identity_tree(spark):
    df = spark.range(1000)
    root = artefacts.identity_tree(df, "id", F.col("id").cast("string"), 16)
    assert root == artefacts.identity_tree(df.repartition(7), "id", F.col("id").cast("string"), 16)
    assert root != artefacts.identity_tree(df.where("id != 500"), "id", F.col("id").cast("string"), 16)
    assert artefacts.identity_tree(df.where("id < 0"), "id", F.col("id").cast("string"))


def test_merge_renames_clashes(spark):
    a, b = spark.createDataFrame([(1, 2, 3)], "id long, x int, x_2 int"), spark.createDataFrame([(1, 9)], "id long, x int")
    assert artefacts.merge_columns(a, b, "id").columns == ["id", "x", "x_2", "x_3"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 0.25, "a"), (2, 1.5, 0.75, None)], "id long, x double, y double, t string")
    sinks.write_coordinates(df, f"{tmp_path}/z")
    assert readers.canonical_coordinates(readers.read_table(spark, f"{tmp_path}/z")).orderBy("id").first()["x"] == 0.5
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_coordinates(df, f"{tmp_path}/z")
    meta = sinks.write_dataset(df, f"{tmp_path}/d", {"name": "n"})
    assert meta["columns"]["t"]["categories"] == ["a"] and meta["columns"]["x"]["extent"] == ["0.5", "1.5"]
    sinks.write_scores(df.agg(F.count("*").alias("n")), df, f"{tmp_path}/s")
    e = spark.createDataFrame([(2, 1), (0, 3), (0, 1)], "src long, dst long")
    sinks.write_edges(e, f"{tmp_path}/e", 2)
    assert spark.read.parquet(f"{tmp_path}/e").count() == 3


def test_user_transform_is_told_by_its_source(spark):
    df = spark.createDataFrame([(1,), (2,)], "x long")
    assert sorted(r["x"] for r in sinks.user_transform(df, doubled, "x long", sinks.source_identity(doubled)).collect()) == [2, 4]
    with pytest.raises(ValueError, match="stated"):
        sinks.user_transform(df, doubled, "x long", "0" * 64)


def test_coordinates_with_two_ids(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 3, 0.0, 0.0)], "row_id long, LS_INDEX long, X double, Y double")
    assert readers.canonical_coordinates(df.limit(1)).count() == 1
    with pytest.raises(Exception, match="disagree"):
        readers.canonical_coordinates(df).collect()
    with pytest.raises(ValueError, match="no coordinates"):
        readers.canonical_coordinates(spark.range(1))
    with pytest.raises(ValueError, match="HDF5"):
        readers.read_table(spark, "x.h5")


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    from quillmap.streaming.transform import stream_counts, stream_files, stream_transform

    spark.range(10).write.parquet(f"{tmp_path}/in")
    like = spark.read.parquet(f"{tmp_path}/in")
    for more in (0, 1):
        if more:
            spark.range(10, 15).write.mode("append").parquet(f"{tmp_path}/in")
        stream_transform(stream_files(spark, f"{tmp_path}/in", like, 1), lambda d: d.selectExpr("id * 2 AS y"), f"{tmp_path}/out", f"{tmp_path}/done")
    assert sorted(r["y"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2 * i for i in range(15)]
    spark.range(20).selectExpr("timestamp_seconds(id * 600) AS ts", "id % 2 AS k").write.parquet(f"{tmp_path}/ev")
    counted = stream_counts(stream_files(spark, f"{tmp_path}/ev", spark.read.parquet(f"{tmp_path}/ev")), "ts", "1 hour", "10 minutes", "k")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == 20
