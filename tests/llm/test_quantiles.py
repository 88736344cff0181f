import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from divrec.llm.quantiles import first_deliveries, merge_states, quantile_states, quantiles

PROBS = [0.0, 0.05, 0.3, 0.5, 0.5, 0.7, 0.99, 1.0]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice(["hot"] * 6 + ["a", "b", None, ""]), rnd.choice([1.0, 1.0, 2.5, None, float("nan"), float("inf"), -0.0, rnd.gauss(0, 9)]), rnd.randint(0, 4), i % 5) for i in range(900)]
    data += data[:50]  # delivered twice
    return data, spark.createDataFrame(data, "id int, g string, v double, n int, day int")


def groups(data, col):
    out = {}
    for r in {r[0]: r for r in data}.values():
        v = r[col]
        if v is not None and not (isinstance(v, float) and math.isnan(v)):
            out.setdefault("NA" if r[1] is None else r[1], []).append(float(v))
    return out


@pytest.mark.parametrize("parts", [1, 4, 11])
def test_exact(spark, rows, parts):
    data, df = rows
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        once = first_deliveries(df, "id", ["g", "v", "n"], ["day"])
        probs = spark.createDataFrame([(1, PROBS), (2, [0.5])], "spec_id int, probs array<double>")
        got = quantiles(quantile_states(once, [(1, "v", "g"), (2, "n", None)]), probs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = {(1, g, p): float(np.sort(v)[max(0, math.ceil(p * len(v) - 1e-9) - 1)]) for g, v in groups(data, 2).items() for p in set(PROBS)}
    nums = sorted(x for v in groups(data, 3).values() for x in v)
    want[(2, "all", 0.5)] = nums[math.ceil(len(nums) / 2) - 1]
    assert {(r["spec_id"], r["grp"], r["prob"]): r["q"] for r in got} == want


def test_days_combine_to_all(spark, rows):
    _, df = rows
    once = first_deliveries(df, "id", ["g", "v"], ["day"])
    daily = quantile_states(once, [(1, "v", "g")], ["day"])
    whole = quantile_states(once, [(1, "v", "g")])
    key = lambda d: sorted(map(repr, map(tuple, d.select("spec_id", "grp", "value", "n").collect())))
    assert key(merge_states(daily)) == key(whole)
    halves = merge_states(daily.where("day < 2").unionByName(daily.where("day >= 2")))
    assert key(halves) == key(whole)


def test_interpolation(spark):
    df = spark.createDataFrame([(float(x), "g") for x in (1, 2, 4, 8, 8)] + [(3.0, "one")], "v double, g string")
    probs = spark.createDataFrame([(1, [0.1, 0.5, 0.9, 1.0])], "spec_id int, probs array<double>")
    got = {(r["grp"], r["prob"]): r["q"] for r in quantiles(quantile_states(df, [(1, "v", "g")]), probs, interpolate=True).collect()}
    for p in (0.1, 0.5, 0.9, 1.0):
        assert got[("g", p)] == pytest.approx(np.quantile([1, 2, 4, 8, 8], p)) and got[("one", p)] == 3.0


def test_edges(spark):
    probs = spark.createDataFrame([(1, [0.5, None, 2.0, -1.0])], "spec_id int, probs array<double>")
    empty = spark.createDataFrame([], "v double, g string")
    assert quantiles(quantile_states(empty, [(1, "v", "g")]), probs).count() == 0
    nothing = spark.createDataFrame([(None, "g"), (float("nan"), "g")], "v double, g string")
    assert quantiles(quantile_states(nothing, [(1, "v", "g")]), probs).count() == 0
    clash = spark.createDataFrame([(5.0, "g", 1, 2, "x")], "value double, grp string, n int, spec_id int, _s string")
    assert [(r["grp"], r["q"]) for r in quantiles(quantile_states(clash, [(1, "value", "grp")]), probs).collect()] == [("g", 5.0)]
    same = spark.range(5000).select(F.lit(7.0).alias("v"), F.lit("g").alias("g"))
    states = quantile_states(same, [(1, "v", "g")])
    assert states.count() == 1 and quantiles(states, probs).first()["q"] == 7.0
    with pytest.raises(ValueError):
        quantile_states(same, [(1, "w", "g")])


def test_first_delivery(spark):
    df = spark.createDataFrame([(1, 5.0, 2), (1, 4.0, 1), (None, 1.0, 1), (None, 1.0, 1)], "id int, v double, day int")
    assert sorted((r["day"], r["v"]) for r in first_deliveries(df, "id", ["v"], ["day"]).collect()) == [(1, 1.0), (1, 1.0), (1, 4.0)]


@pytest.mark.parametrize("interpolate", [False, True])
def test_exact_positions_of_huge_groups(spark, interpolate):
    """States count: n = 3e9 and p = 0.035 are a few rows here. Against whole-number arithmetic."""
    from fractions import Fraction

    n, text = 3_000_000_000, ["0.035", "0.001", "0.007", "0.1", "0.9", "0.999", "1.0", "0.0", "1e-9", "0.3333333333333333"]
    cuts = sorted({int(Fraction(t) * m) for t in text for m in (n, n - 1)} - {0, n})
    ends = [x for c in cuts for x in (c - 1, c, c + 1, c + 2) if 0 < x <= n]
    ends = sorted({*ends, n})
    rows = [(1, "g", float(e), e - b) for b, e in zip([0, *ends], ends)]
    got = quantiles(spark.createDataFrame(rows, "spec_id int, grp string, value double, n bigint"), spark.createDataFrame([(1, [float(t) for t in text])], "spec_id int, probs array<double>"), interpolate=interpolate)

    def value(k):  # of the k-th
        return next(float(e) for e in ends if k <= e)

    for r in got.collect():
        p = Fraction(repr(r["prob"]))
        if interpolate:
            at = p * (n - 1)
            lo = int(at) + 1
            want = value(lo) + float(at - int(at)) * (value(min(lo + 1, n)) - value(lo))
            assert r["q"] == pytest.approx(want, rel=1e-12)
        else:
            assert r["q"] == value(max(1, math.ceil(p * n)))
