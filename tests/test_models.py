import numpy as np
import pandas as pd
import pytest

from divrec.operators.combine import comb_mean, recombine
from divrec.operators.division import divide, rr_div
from divrec.operators.models import blb, dr_blb, dr_glm, dr_lm, irls

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def frame():
    x, z = RNG.normal(size=400), RNG.normal(size=400) + 1000
    return pd.DataFrame({"x": x, "z": z, "y": 2 + 3 * x - 0.5 * z + RNG.normal(size=400), "g": ["a", "b"] * 200})


def test_lm_is_least_squares(spark, frame):
    got = dr_lm(divide(spark.createDataFrame(frame), "g"), "y", ["x", "z"]).rows().collect()
    for g, f in frame.groupby("g"):
        want = np.linalg.lstsq(np.column_stack([np.ones(len(f)), f["x"], f["z"]]), f["y"], rcond=None)[0]
        mine = {r["term"]: r["coef"] for r in got if r["g"] == g}
        assert [mine[t] for t in ("(Intercept)", "x", "z")] == pytest.approx(want, rel=1e-6)
    assert {r["n"] for r in got} == {200}


def test_lm_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", None, 9.0), ("a", 5.0, float("nan")), ("b", None, 1.0), ("c", 1.0, 4.0)], "g string, x double, y double")
    got = {(r["g"], r["term"]): (r["coef"], r["n"]) for r in dr_lm(divide(df, "g"), "y", ["x"]).rows().collect()}
    assert got[("a", "x")] == (pytest.approx(2.0), 4) and got[("b", "x")] == (None, 1) and got[("c", "(Intercept)")] == (4.0, 1)


@pytest.mark.parametrize("family", ["gaussian", "binomial", "poisson", "gamma"])
def test_irls_score_is_zero(family):
    """At the maximum likelihood estimate with a canonical link X'(y - mu) = 0."""
    x = np.column_stack([np.ones(500), RNG.uniform(0.2, 1, 500)])
    eta = x @ np.array([0.5, 0.7])
    y = {"gaussian": lambda: eta + RNG.normal(size=500), "binomial": lambda: (RNG.random(500) < 1 / (1 + np.exp(-eta))).astype(float), "poisson": lambda: RNG.poisson(np.exp(eta)).astype(float), "gamma": lambda: RNG.gamma(2, 1 / eta / 2)}[family]()
    b = irls(x, y, family)
    mu = {"gaussian": lambda e: e, "binomial": lambda e: 1 / (1 + np.exp(-e)), "poisson": np.exp, "gamma": lambda e: 1 / e}[family](x @ b)
    assert np.abs(x.T @ (y - mu)).max() < 1e-5 * len(y)


def test_glm_and_unknown_family(spark, frame):
    div = divide(spark.createDataFrame(frame.assign(p=(frame["y"] > frame["y"].mean()).astype(int))), "g")
    assert dr_glm(div, "p", ["x"], "binomial").rows().count() == 4
    with pytest.raises(ValueError, match="family"):
        dr_glm(div, "p", ["x"], "tweedie")


def test_blb(spark, frame):
    div = divide(spark.createDataFrame(frame), rr_div(100, seed=1))
    run = lambda d: recombine(dr_blb(d, lambda f, w: [np.average(f["x"], weights=w)], lambda v: [v.mean(), v.std()], r=30, n=400), comb_mean()).orderBy("pos").collect()
    mean, sd = (r["mean"] for r in run(div))
    assert abs(mean - frame["x"].mean()) < 0.05 and 0.5 < sd / (frame["x"].std() / 20) < 2
    again = divide(spark.createDataFrame(frame).repartition(9), rr_div(100, seed=1))
    assert [r["mean"] for r in run(again)] == pytest.approx([mean, sd])
    assert len(blb(frame, lambda f, w: 1.0, np.mean, 3, 10)) == 1


def _designed(f, base):
    levels = [v for v in sorted(f["c"].unique()) if v != base]
    return ["(Intercept)", "x", *(f"c{v}" for v in levels)], np.column_stack([np.ones(len(f)), f["x"], *[(f["c"] == v).to_numpy(float) for v in levels]])


def test_factors_weights_offset(spark, frame):
    f = frame.assign(c=["red", "blue", "green", "blue"] * 100, w=np.arange(400) % 5, o=RNG.normal(size=400))
    f.loc[f["g"] == "a", "c"] = f.loc[f["g"] == "a", "c"].replace("blue", "red")  # a subset without a level
    df = spark.createDataFrame(f)
    got = dr_lm(divide(df, "g"), "y", ["x", "c"], weights="w", offset="o").rows().collect()
    for g, part in f.groupby("g"):
        terms, x = _designed(part, min(part["c"]))
        w = np.sqrt(part["w"].to_numpy(float))
        want = np.linalg.lstsq(x * w[:, None], (part["y"] - part["o"]) * w, rcond=None)[0]
        mine = {r["term"]: r["coef"] for r in got if r["g"] == g}
        assert set(mine) == set(terms) and [mine[t] for t in terms] == pytest.approx(want, rel=1e-6)
    glm = dr_glm(divide(df, "g"), "y", ["x", "c"], weights="w", offset="o").rows().collect()
    assert {(r["g"], r["term"]): r["coef"] for r in glm} == {(r["g"], r["term"]): pytest.approx(r["coef"], rel=1e-6) for r in got}
    flags = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, False), ("a", 3.0, None), ("b", 5.0, True)], "g string, y double, f boolean")
    assert {(r["g"], r["term"]): r["coef"] for r in dr_lm(divide(flags, "g"), "y", ["f"]).rows().collect()} == {("a", "(Intercept)"): 3.0, ("a", "fTRUE"): -2.0, ("b", "(Intercept)"): 5.0}
    with pytest.raises(ValueError, match="is no number"):
        dr_lm(divide(df, "g"), "c", ["x"])


@pytest.mark.parametrize(("family", "link"), [("binomial", "probit"), ("binomial", "cloglog"), ("poisson", "sqrt"), ("poisson", "identity"), ("gamma", "log")])
def test_links(family, link):
    """At the maximum of the likelihood X'((y - mu) slope / variance) = 0."""
    from divrec.operators.models import FAMILIES, LINKS

    x = np.column_stack([np.ones(800), RNG.uniform(0.2, 1, 800)])
    mu = LINKS[link][0](x @ np.array([0.5, 0.7]))
    y = {"binomial": lambda: (RNG.random(800) < mu).astype(float), "poisson": lambda: RNG.poisson(mu).astype(float), "gamma": lambda: RNG.gamma(2, mu / 2)}[family]()
    eta = x @ irls(x, y, family, link=link)
    m = LINKS[link][0](eta)
    assert x.T @ ((y - m) * LINKS[link][1](eta) / FAMILIES[family][1](m)) == pytest.approx([0, 0], abs=1e-5)


@pytest.mark.parametrize(("family", "link"), [("binomial", None), ("binomial", "cloglog"), ("poisson", None), ("poisson", "sqrt"), ("gamma", None), ("gamma", "log"), ("gaussian", "log")])
def test_spread_fit_is_the_fit_in_one_task(spark, family, link):
    rng = np.random.default_rng(12)
    n = 600
    f = pd.DataFrame({"x": rng.uniform(0.2, 1, n), "c": rng.choice(["p", "q", "r"], n), "g": rng.choice(["a", "b", "c"], n), "w": rng.integers(1, 4, n).astype(float), "o": rng.normal(scale=0.1, size=n)})
    f.loc[f["g"] == "b", "c"] = f.loc[f["g"] == "b", "c"].replace("p", "q")  # a subset without a level
    eta = 0.4 + 0.5 * f["x"] + 0.2 * (f["c"] == "r")
    mu = {"binomial": 1 / (1 + np.exp(-eta)), "poisson": np.exp(eta), "gamma": np.exp(eta), "gaussian": np.exp(eta)}[family]
    f["y"] = {"binomial": lambda: (rng.random(n) < mu).astype(float), "poisson": lambda: rng.poisson(mu).astype(float), "gamma": lambda: rng.gamma(4, mu / 4), "gaussian": lambda: mu + rng.normal(scale=0.1, size=n)}[family]()
    f.loc[3, "x"], f.loc[f["g"] == "c", "y"] = np.nan, np.nan  # a subset without complete rows
    div = divide(spark.createDataFrame(f), "g")
    args = {"family": family, "link": link, "weights": "w", "offset": "o" if family != "gamma" or link else None}
    key = lambda d: {(r["g"], r["term"]): (r["coef"], r["n"]) for r in d.rows().collect()}
    one, many = key(dr_glm(div, "y", ["x", "c"], **args)), key(dr_glm(div, "y", ["x", "c"], **args, spread=True))
    assert {k for k in many if k[0] != "c"} == {k for k in one if k[0] != "c"}
    assert all(many[k] == (pytest.approx(one[k][0], rel=1e-6, abs=1e-7), one[k][1]) for k in many if k[0] != "c")
    assert many[("c", "(Intercept)")][0] is None and many[("c", "x")][1] == (f["g"] == "c").sum()
    with pytest.raises(ValueError, match="probit"):
        dr_glm(div, "y", ["x"], "binomial", link="probit", spread=True)
