import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from divrec.llm.frequent import frequency_table, frequent_items, merge_summary


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aaaabbcdefghij"), max_size=40), max_size=8), st.integers(1, 6))
def test_summary_bounds(parts, k):
    """Estimates bound the counts from above, less their error from below; frequent values are never lost."""
    summary, floor = {}, 0
    for p in parts:
        summary, floor = merge_summary(summary, floor, {i: (c, 0) for i, c in Counter(p).items()}, 0, k)
    true = Counter(x for p in parts for x in p)
    assert len(summary) <= k
    for item, (est, err) in summary.items():
        assert est - err <= true[item] <= est
    for item, c in true.items():
        if item not in summary:
            assert c <= floor <= sum(true.values()) / k
        if c > sum(true.values()) / k:
            assert item in summary


def test_skewed_values(spark):
    rnd = random.Random(4)
    vals = [rnd.choice(["hot"] * 30 + ["", "warm", "WARM", " warm", "wärm"] * 4 + [f"rare{rnd.randint(0, 5000)}"] * 20 + [None]) for _ in range(6000)]
    vals.sort(key=str)  # bursts
    got = {r["item"]: r for r in frequent_items(spark.createDataFrame([(v,) for v in vals], "y string").repartition(37), "y", k=64).collect()}
    true = Counter(v for v in vals if v is not None)
    n = sum(true.values())
    assert len(got) <= 64
    for v, c in true.items():
        if c > n / 64:
            assert got[v]["n"] == c
    assert all(r["n"] == true[v] and r["est"] - r["err"] <= r["n"] <= r["est"] and r["total"] == n for v, r in got.items())


def test_edges(spark):
    assert frequent_items(spark.createDataFrame([], "y string"), "y").count() == 0
    assert frequent_items(spark.createDataFrame([(None,)] * 5, "y string"), "y").count() == 0
    long = "x" * 200_000
    df = spark.createDataFrame([(long, 1), (long, 2), ("", 3)], "item string, n int")  # clashing names
    assert {len(r["item"]): r["n"] for r in frequent_items(df, "item").collect()} == {200_000: 2, 0: 1}
    nums = spark.range(10).select((F.col("id") % 2).alias("n"))
    assert {r["item"]: r["n"] for r in frequent_items(nums, "n").collect()} == {"0": 5, "1": 5}
    top = frequency_table(spark.createDataFrame([(c,) for c in "aabbc"], "y string"), "y", 2).collect()
    assert [(r["item"], r["n"], r["certain"]) for r in top] == [("a", 2, True), ("b", 2, True)]
    with pytest.raises(ValueError):
        frequent_items(df, "none")
