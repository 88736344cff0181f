import random

import pytest
from pyspark.sql import functions as F

from divrec.operators.scan import ordered_scan, row_numbers


def brute(rows):
    out, seen = [], {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, str(r[0]), r[1])):
        st = seen.setdefault(g, [0, None, 0])
        before = st[1]
        st[0] += v or 0
        st[1] = before if v is None else v if before is None else max(before, v)
        st[2] += 1
        out.append((g, o, v, st[0], st[2], st[1], before))
    return sorted(map(repr, out))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_against_brute_force(spark, parts):
    """A group with most rows, a NULL group, missing values; any number of partitions."""
    rnd = random.Random(parts)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i, rnd.choice([None, *range(-5, 50)])) for i in range(700)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
        res = ordered_scan(df, ["g"], ["o"], sums={"s": "v"}, maxes={"m": "v"}, count="n")
        got = sorted(repr(tuple(r)) for r in res.select("g", "o", "v", "s", "n", "m", "m_before").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == brute(rows)


def test_hot_group_is_spread(spark):
    from divrec.operators import scan

    df = spark.range(40_000).select(F.lit("one").alias("g"), F.col("id").alias("o"))
    seen = ordered_scan(df, ["g"], ["o"], count="n").where("n = o + 1").count()
    assert seen == 40_000 and scan._NONE < 0


def test_names_with_dots_and_clashes_and_empty(spark):
    df = spark.createDataFrame([(1.5, 2, "x"), (1.5, 1, "y"), (float("nan"), 3, "z"), (float("nan"), 4, "z")], "`a.b` double, `_scan_pid` int, c0 string")
    got = row_numbers(df, ["a.b"], ["_scan_pid"], "rank")
    assert got.columns == ["a.b", "_scan_pid", "c0", "rank"]
    assert sorted((r["_scan_pid"], r["rank"]) for r in got.collect()) == [(1, 1), (2, 2), (3, 1), (4, 2)]
    assert row_numbers(df.limit(0), ["a.b"], ["_scan_pid"], "rank").count() == 0


def test_repeated_rows_and_ties_all_stay(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 1)] * 3, "g string, o int")
    got = row_numbers(df, ["g"], ["o"], "n").groupBy("g").agg(F.sort_array(F.collect_list("n")).alias("n")).collect()
    assert {r["g"]: r["n"] for r in got} == {"a": list(range(1, 51)), "b": [1, 2, 3]}


def test_unknown_column(spark):
    with pytest.raises(ValueError, match="no such column"):
        row_numbers(spark.range(3).toDF("a"), ["b"], ["a"], "n")
