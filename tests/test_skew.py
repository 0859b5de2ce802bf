import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from idloom.operators import joins, skew


def test_eager_join_equals_join_then_group(spark):
    r = random.Random(1)
    left = [(r.choice([None, 1, 1, 1, 2, 3]), r.randrange(3), r.randrange(10)) for _ in range(300)]
    right = [(r.choice([None, 1, 2, 2, 4]), r.choice("ab"), r.randrange(10)) for _ in range(200)]
    a = spark.createDataFrame(left, "k int, g int, v int")
    b = spark.createDataFrame(right, "k int, g string, v int")
    got = skew.eager_join(a, b, "k", "k", {"lg": F.col("g")}, {"rg": F.col("g")}, {"lv": F.col("v")}, {"rv": F.col("v")})
    plain = a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k")).groupBy(F.col("a.g").alias("lg"), F.col("b.g").alias("rg")).agg(F.count("*").alias("pairs"), F.sum("a.v").alias("lv"), F.sum("b.v").alias("rv"))
    cols = ["lg", "rg", "pairs", "lv", "rv"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, plain.select(cols).collect()))


@pytest.mark.parametrize("by", [(True, False), (False, True), (True, True)])
def test_eager_join_with_many_states_of_a_hot_key(spark, by):
    a = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k int, g int")
    b = spark.createDataFrame([(1 if i % 2 else i, i % 1500) for i in range(3000)], "k int, g int")
    lb, rb = {"lg": F.col("g") % 1200} if by[0] else None, {"rg": F.col("g") % 1100} if by[1] else None
    got = skew.eager_join(a, b, "k", "k", lb, rb)
    keys = [c for c in ("lg", "rg") if c in got.columns]
    plain = a.select("k", (F.col("g") % 1200).alias("lg")).join(b.select("k", (F.col("g") % 1100).alias("rg")), "k").groupBy(*keys).agg(F.count("*").alias("pairs"))
    assert got.select(*keys, "pairs").exceptAll(plain).count() == 0 and got.count() == plain.count()


def test_heavy_keys(spark):
    rows = [(1, i) for i in range(50)] + [(i, 2) for i in range(3, 50)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "p long, c long")
    got = {(r.field, r.file_id, r.n_rows) for r in skew.heavy_keys(df, "p", "c", 0.3).collect()}
    assert got == {("p", 1, 50), ("c", 2, 48)}
    assert skew.heavy_keys(df.limit(0), "p", "c").collect() == []


def test_distinct_partners(spark):
    rows = [(1, 2), (1, 2), (1, None), (1, 3), (None, 5), (2, None)]
    got = {tuple(r) for r in skew.distinct_partners(spark.createDataFrame(rows, "a int, b int"), "a", "b").collect()}
    assert got == {(1, 4, 2), (2, 1, 0)}


def test_lookup_with_hot_key(spark):
    rows = [(1, i) for i in range(3000)] + [(k, k) for k in range(2, 500)] + [(None, 0)]
    big = spark.createDataFrame(rows, "k long, v long")
    one = spark.createDataFrame([(k, f"n{k}") for k in range(0, 400)], "k long, name string")
    for how in ("left", "inner"):
        got = Counter(tuple(r) for r in joins.lookup(big, one, ["k"], how).select("k", "v", "name").collect())
        want = Counter((k, v, f"n{k}" if k is not None and k < 400 else None) for k, v in rows if how == "left" or (k is not None and k < 400))
        assert got == want


def test_numbers_are_dense_and_ordered(spark):
    df = spark.createDataFrame([(i * 5 % 1001,) for i in range(1001)], "x long")
    got = {r.x: r.n for r in joins.numbered(df, [F.col("x")], "n", 5).collect()}
    assert got == {x: x + 5 for x in range(1001)}
    assert joins.numbered(df.limit(0), [F.col("x")], "n").collect() == []
