from collections import Counter

from pyspark.sql import functions as F

from divrec.operators.skew import eager_join_aggregate, key_shares, key_states, row_distribution

ROWS = [("hot", 1, 2.0)] * 40 + [("a", 2, None), ("a", 2, float("nan")), (None, 3, 1.0), (None, None, 5.0), ("", 4, 0.0)]
SCHEMA = "k string, e int, v double"


def test_states_and_shares(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["key_column"], r["key_value"]): r for r in key_states(df, {"k": "k", "e": "e"}, ["v"]).collect()}
    assert got[("k", "hot")]["n"] == 40 and got[("k", "hot")]["sum_v"] == 80.0
    assert got[("k", "NA")]["n"] == 2 and got[("k", "NA")]["sum_v"] == 6.0
    assert got[("k", "a")]["n"] == 2 and got[("k", "a")]["n_v"] == 0 and got[("k", "a")]["sum_v"] is None
    assert got[("e", "NA")]["n"] == 1 and got[("k", "")]["n"] == 1
    shares = {(r["key_column"], r["key_value"]): (r["n_row"], r["n_all"]) for r in key_shares(df, {"k": "k", "e": "e"}).collect()}
    assert shares[("k", "hot")] == (40, 45) and shares[("e", "NA")] == (1, 45) and len(shares) == len(got)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert key_states(df, {"k": "k"}).count() == 0
    assert key_shares(df, {"k": "k"}).count() == 0
    assert eager_join_aggregate(df, df, ["k"]).where("n_rows > 0").count() == 0


def test_join_is_that_of_the_rows(spark):
    """Against the join itself, with NULL keys, hot keys and columns of the same name on both sides."""
    left = spark.createDataFrame(ROWS, SCHEMA).withColumn("g", F.col("e") % 2)
    right = spark.createDataFrame([("hot", 7, 1.0)] * 5 + [("a", 8, 2.0), (None, 9, 3.0), ("z", 1, 1.0)], SCHEMA)
    got = eager_join_aggregate(left, right, ["k"], left_sums=["v"], right_sums=["e"], products=[("e", "v")], left_groups=["g"])
    got = {r["g"]: (r["n_rows"], r["sum_v"], r["sum_e"], r["sum_e_v"]) for r in got.collect()}
    full = left.alias("l").join(right.alias("r"), F.col("l.k") == F.col("r.k")).withColumn("lv", F.when(~F.isnan("l.v"), F.col("l.v")))
    want = full.groupBy("l.g").agg(F.count("*").alias("n"), F.sum("lv").alias("a"), F.sum("r.e").cast("double").alias("b"), F.sum(F.col("l.e") * F.col("r.v")).alias("c"))
    assert got == {r["g"]: (r["n"], r["a"], r["b"], r["c"]) for r in want.collect()}
    safe = eager_join_aggregate(left, right, ["k"], null_safe=True).first()
    assert safe["n_rows"] == 40 * 5 + 2 + 2


def test_row_distribution(spark):
    import numpy as np

    keys = [f"k{i % 13}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    r = row_distribution(key_states(df, {"k": "k"})).first()
    sizes = list(Counter(keys).values())
    assert (r["nrow"], r["ndiv"]) == (200, 13)
    assert np.allclose(r["splitrowdistn"], np.quantile(sizes, np.arange(101) / 100))


def test_plan_shuffles_states_not_rows(spark):
    """The rows are combined before the exchange: partial aggregation lies below it."""
    df = spark.range(100_000).select((F.col("id") % 3).alias("k"))
    plan = key_states(df, {"k": "k"})._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.rindex("partial_count")
