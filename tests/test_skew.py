import pandas as pd
from pyspark.sql import functions as F

from notegraph.operators.skew import hot_keys, salted_join, spread_rank, spread_row_number


def test_hot_keys_are_few_and_hot(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, "hot").when(F.col("id") < 410, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    assert hot_keys(df, "k", 0.1, 10) == ["hot"]
    assert hot_keys(df.limit(0), "k", 0.1, 10) == []


def test_salted_join_equals_plain_join(spark):
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("7", 2), ("nobody", 3)], "k string, v int")
    for how in ("inner", "left"):
        plain = sorted(map(str, left.join(right, "k", how).select("k", "id", "v").collect()))
        assert sorted(map(str, salted_join(left, right, "k", ["hot"], F.col("id"), how, 8).select("k", "id", "v").collect())) == plain


def test_spread_rank_with_ties_and_nulls(spark):
    rows = [("a", float(i % 7)) for i in range(100)] + [("b", 1.0)] * 5 + [("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = spread_rank(df, ["g"], "v", "r", buckets=4).toPandas()
    wanted = found.groupby("g")["v"].rank(method="min", ascending=False)
    assert pd.Series(found["r"], dtype="float").equals(wanted.astype("float"))


def test_row_numbers_are_dense_whatever_the_skew(spark):
    df = spark.range(500).select(F.when(F.col("id") < 300, "hot").otherwise("cold").alias("k"), "id")
    found = spread_row_number(df, "k", F.col("id"), "n", salts=16).toPandas()
    for _, part in found.groupby("k"):
        assert sorted(part["n"]) == list(range(1, len(part) + 1))
