import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from divrec.operators import agnostic as ag
from divrec.operators.division import KEY, ddf, divide, rr_div

NUM = st.floats(-1e3, 1e3, allow_nan=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(NUM, min_size=1, max_size=30), st.lists(NUM, min_size=1, max_size=30), st.lists(NUM, max_size=30))
def test_moments_merge(a, b, c):
    whole = ag.calculate_moments([*a, *b, *c], 4)
    parts = [ag.calculate_moments(x, 4) for x in (a, b, c)]
    left = ag.combine_moments(ag.combine_moments(parts[0], parts[1]), parts[2])
    right = ag.combine_moments(parts[0], ag.combine_moments(parts[1], parts[2]))
    for k in whole:
        scale = 1e-7 * (1 + sum(abs(x) ** (int(k[1:]) if k != "n" else 0) for x in (*a, *b, *c)))
        assert abs(left[k] - whole[k]) <= scale and abs(right[k] - whole[k]) <= scale


def test_moments_of_nothing():
    assert ag.calculate_moments([None, float("nan")]) is None
    assert ag.combine_multiple_moments(None, None) is None and ag.moments_to_statistics(None) is None
    one = ag.moments_to_statistics(ag.calculate_moments([2.0], 4))
    assert one["mean"] == 2.0 and math.isnan(one["var"]) and math.isnan(one["kurtosis"])
    m = ag.moments_to_statistics(ag.calculate_moments([1, 2, 3, 4, 10], 4))
    x = np.array([1, 2, 3, 4, 10.0])
    d = x - x.mean()
    assert m["var"] == pytest.approx(x.var(ddof=1)) and m["skewness"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5) and m["kurtosis"] == pytest.approx((d**4).mean() / (d**2).mean() ** 2)


@pytest.fixture(scope="module")
def xy(spark):
    r = np.random.default_rng(2)
    rows = [(float(a), float(b), "abc"[i % 3]) for i, (a, b) in enumerate(zip(r.normal(size=1000), r.normal(size=1000)))]
    return spark.createDataFrame([*rows, (None, 1.0, "a"), (float("nan"), 1.0, "b")], "x double, y double, g string")


def values(xy):
    return np.array([r["x"] for r in xy.select("x").collect() if r["x"] is not None and not math.isnan(r["x"])])


def test_quantile_error_and_invariance(xy):
    v = values(xy)
    step = (v.max() - v.min()) / 9999
    want = {p: np.quantile(v, p, method="inverted_cdf") for p in [i / 200 for i in range(201)]}
    seen = None
    for data in (xy, divide(xy, "g"), divide(xy, rr_div(100)), ddf(xy)):
        got = {r["fval"]: r["q"] for r in ag.dr_quantile(data, "x").collect()}
        seen = seen or got
        assert got == seen and all(abs(got[p] - want[p]) <= 0.5001 * step for p in want)


def test_quantile_tails_of_missing_groups(spark):
    rows = [(g, h, float(i)) for g, h, n in ((None, "a", 30), (None, None, 20), ("x", None, 25), ("x", "a", 10)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, h string, v double")
    got = {}
    for r in ag.dr_quantile(df, "v", ["g", "h"], tails=3).collect():
        got.setdefault((r["g"], r["h"]), []).append((r["fval"], r["q"]))
    assert set(got) == {(None, "a"), (None, None), ("x", None), ("x", "a")}
    for (g, h), n in (((None, "a"), 30), ((None, None), 20), (("x", None), 25), (("x", "a"), 10)):
        q = sorted(got[(g, h)])
        assert q[:3] == [(k / n, float(k)) for k in range(3)] and q[-3:] == [((n - 2 + k) / n, float(n - 3 + k)) for k in range(3)]
        assert len(q) == 6 + sum(2 / n < i / 200 < (n - 2) / n for i in range(201))


def test_quantile_tails_of_small_groups(spark):
    df = spark.createDataFrame([(float(i), "s") for i in range(3)] + [(float(i), "l") for i in range(50)] + [(7.0, "c")] * 4, "v double, g string")
    got = ag.dr_quantile(df, "v", "g", tails=5).collect()
    assert sorted(r["q"] for r in got if r["g"] == "s") == [0.0, 1.0, 2.0]
    large = sorted((r["fval"], r["q"]) for r in got if r["g"] == "l")
    assert [q for _, q in large[:5]] == [0, 1, 2, 3, 4] and [q for _, q in large[-5:]] == [45, 46, 47, 48, 49]
    assert ag.dr_quantile(spark.createDataFrame([(5.0,)] * 3, "v double"), "v", probs=[0.5]).first()["q"] == 5.0  # constant
    assert ag.dr_quantile(df.limit(0), "v", "g").count() == 0


def test_hexbin_mass(xy):
    for data in (xy, divide(xy, rr_div(100))):
        h = ag.dr_hexbin(data, "x", "y").collect()
        assert sum(r["count"] for r in h) == 1000
        assert sum(r["count"] * r["xcm"] for r in h) == pytest.approx(values(xy).sum())
    by = ag.dr_hexbin(xy, "x", "y", "g", x_range=(-4, 4), y_transform=lambda c: c * 2)
    assert by.select("g").distinct().count() == 3 and by.agg(F.sum("count")).first()[0] == 1000
    assert ag.dr_hexbin(xy.limit(0), "x", "y").count() == 0


def test_aggregate_final_sum_decides(spark):
    """Negative and cancelling sums: only the final one counts, whatever the division."""
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("b", -5.0), ("b", 8.0), ("c", -1.0), (None, 4.0), ("d", None)], "k string, v double")
    want = {"b": 3.0}
    for data in (df, divide(df, "k"), df.repartition(7)):
        assert {r["k"]: r["Freq"] for r in ag.dr_aggregate(data, "v ~ k").collect()} == want
    assert {r["k"]: r["Freq"] for r in ag.dr_aggregate(df, "~k").collect()} == {"a": 2, "b": 2, "c": 1, "d": 1}
    by = ag.dr_aggregate(df, "~ v", by="k")
    assert {r[KEY] for r in by.collect()} == {"k=a", "k=b", "k=c"}
    assert ag.dr_aggregate(df, "~ k", max_unique=2).count() == 2


def test_update_attributes(spark):
    import datetime as dt

    rows = [(1, "a", dt.date(2020, 1, 1), True)] * 3 + [(None, None, None, None), (5, "b", dt.date(2021, 1, 1), False)]
    div = ag.update_attributes(divide(spark.createDataFrame(rows, "n int, t string, d date, b boolean"), "t"))
    assert div.get_attribute("nRow") == 5 and div.get_attribute("nDiv") == 3 and len(div.get_attribute("splitRowDistn")) == 101
    s = div.summary()
    assert (s["n"]["nna"], s["n"]["mean"], s["n"]["max"]) == (1, 2.0, 5.0) and s["d"]["nna"] == 1 and "b" not in s
    assert div.has_attributes(["nRow", "none"]) == [True, False]
    with pytest.raises(KeyError):
        div.get_attribute("none")
    assert ag.update_attributes(div).attrs == div.attrs
    text = ag.format_summary(div)
    assert "n: 1 missing" in text and "mean: 2.0" in text and "no summary" in ag.format_summary(ddf(div.df))
    assert ag.split_size_distn(div).first()["ndiv"] == 3


def test_many_levels(spark):
    df = spark.createDataFrame([(f"v{i % 30}",) for i in range(100)] + [(None,)], "y string")
    all_of = ag.frequency_summary(df, "y")
    assert all_of.agg(F.sum("Freq")).first()[0] == 100 and all_of.where("not complete").count() == 0
    cut = ag.frequency_summary(df, "y", 10)
    assert cut.count() == 10 and cut.where("complete").count() == 0


@pytest.mark.parametrize("tails", [0, 3])
def test_infinite_values_are_no_ends_of_the_range(spark, tails):
    v = [float(i) for i in range(101)] + [float("inf"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = {r["fval"]: r["q"] for r in ag.dr_quantile(df, "v", probs=[0.25, 0.5, 0.75], n_bins=101, tails=tails).collect()}
    assert (got[0.25], got[0.5], got[0.75]) == (24.0, 50.0, 76.0)  # the 26th, 52nd and 78th of 103
    if tails:
        assert sorted(q for f, q in got.items() if f not in (0.25, 0.5, 0.75)) == [float("-inf"), 0.0, 1.0, 99.0, 100.0, float("inf")]


def test_tails_of_repeated_values(spark):
    import collections

    rows = [("a", 1.0)] * 50 + [("a", 2.0)] * 3 + [("a", 9.0)] * 40 + [("b", 5.0)] * 4
    got = ag.dr_quantile(spark.createDataFrame(rows, "g string, v double"), "v", "g", probs=[0.5], tails=7).collect()
    assert collections.Counter((r["g"], r["q"]) for r in got) == {("a", 1.0): 8, ("a", 9.0): 7, ("b", 5.0): 4}
    assert len({(r["g"], r["fval"]) for r in got}) == len(got)


def test_all_attributes(spark):
    from divrec.operators.division import divide

    rows = [(i, f"t{i % 3}" if i % 5 else None, "xyz"[i % 3], None) for i in range(30)]
    div = ag.update_attributes(divide(spark.createDataFrame(rows, "n int, t string, g string, e string"), "g"))
    a = div.attrs
    assert (a["nRow"], a["nDiv"], a["keys"]) == (30, 3, ["g=x", "g=y", "g=z"]) and len(a["splitSizeDistn"]) == 101 and a["totObjectSize"] > 30 * 10
    assert a["summary"]["t"] == {"variable": "t", "nna": 6, "freqTable": [("t0", 8), ("t1", 8), ("t2", 8)], "complete": True}
    assert a["summary"]["e"] == {"variable": "e", "nna": 30, "freqTable": [], "complete": False} and list(a["summary"]) == ["n", "t", "e"]
    two = ag.frequency_tables(spark.createDataFrame([(f"v{i % 7}", f"w{i}") for i in range(20)], "a string, b string"), ["a", "b"], 4).collect()
    assert sorted((r["variable"], r["value"], r["Freq"], r["complete"]) for r in two) == [("a", "v0", 3, False), ("a", "v1", 3, False), ("a", "v5", 3, False), ("a", "v6", 2, False)] + [("b", f"w{i}", 1, False) for i in (0, 1, 8, 9)]
