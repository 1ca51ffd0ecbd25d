from collections import Counter

from quillmap.operators.joins import split_join


def test_split_join_is_a_join(spark):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 3), (3, 5), (None, 4)) for i in range(n)], "k int, a int")
    right = spark.createDataFrame([(k, i) for k, n in ((1, 30), (2, 2), (4, 5), (None, 4)) for i in range(n)], "k int, b int")
    want = Counter(map(tuple, left.join(right, ["k"]).collect()))
    for pairs in (1, 7, 100, None):
        assert Counter(map(tuple, split_join(left, right, ["k"], pairs).collect())) == want
    assert split_join(left.where("false"), right, ["k"], 1).count() == split_join(left, right.where("false"), ["k"], 1).count() == 0
    keys = left.select("k")
    assert Counter(map(tuple, split_join(keys, right, ["k"], 7).collect())) == Counter(map(tuple, keys.join(right, ["k"]).collect()))
