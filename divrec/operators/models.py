"""Methods that are applied to each subset: linear and generalised linear models, bag of little bootstraps."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divrec.operators.division import KEY, Division
from divrec.runtime import broadcast_if_small, clean, grouped_pandas, require_columns, stage

COEF = "term string, coef double, n bigint"


#: Levels of a text predictor: they become columns of the models, so there must be few.
MAX_LEVELS = 200


def _levels(rows: DataFrame, xs: Sequence[str]) -> dict[str, list]:
    """The levels of the text and boolean predictors, in order."""
    out = {}
    for c in xs:
        kind = rows.schema[c].dataType
        if isinstance(kind, T.BooleanType):
            out[c] = [False, True]
        elif isinstance(kind, T.StringType):
            found = [r[0] for r in rows.where(F.col(f"`{c}`").isNotNull()).select(F.col(f"`{c}`")).distinct().limit(MAX_LEVELS + 1).collect()]
            if len(found) > MAX_LEVELS:
                raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
            out[c] = sorted(found)
    return out


def _level_name(c: str, level: Any) -> str:
    return f"{c}{str(level).upper() if isinstance(level, bool) else level}"


def _design(rows: DataFrame, y: str, xs: Sequence[str], factors: dict[str, list], weights: str | None, offset: str | None) -> tuple[list[tuple[str, Column]], list[tuple[int, int]], Column]:
    """The columns of a model with their names, (first, last) columns of each factor, and whether a row is complete."""
    design, blocks = [], []
    whole = clean(rows, y).isNotNull()
    for c in (weights, offset):
        whole = whole & clean(rows, c).isNotNull() if c else whole
    for c in xs:
        if c in factors:
            blocks.append((len(design), len(design) + len(factors[c])))
            design += [(_level_name(c, v), (F.col(f"`{c}`") == F.lit(v)).cast("double")) for v in factors[c]]
            whole = whole & F.col(f"`{c}`").isNotNull()
        else:
            design.append((c, clean(rows, c)))
            whole = whole & clean(rows, c).isNotNull()
    return design, blocks, whole


def dr_lm(div: Division, y: str, xs: Sequence[str], weights: str | None = None, offset: str | None = None) -> Division:
    """Least squares per subset: rows ``term, coef, n`` (``n`` counts all rows, those left out for missing values too).

    A text or boolean predictor is a factor: each of its levels in a subset,
    but the first of them in order, has an indicator and a term named variable
    and level. ``weights``: a column of nonnegative weights; ``offset``: a
    column taken with coefficient 1. Means and covariances are one aggregation
    in the JVM; only the small systems are solved in Python, many at a time.
    Without a unique solution the one of least norm is taken; a subset without
    complete rows has NULLs.
    """
    rows = div.rows()
    used = [y, *xs, *[c for c in (weights, offset) if c]]
    require_columns(rows, used)
    factors = _levels(rows, xs)
    if y in _levels(rows, [y]):
        raise ValueError(f"{y} is no number")
    design, blocks, whole = _design(rows, y, xs, factors, weights, offset)
    names, p = [t for t, _ in design], len(design)
    target = clean(rows, y) - clean(rows, offset) if offset else clean(rows, y)
    values = [target, *[v for _, v in design]]
    part = rows.select(KEY, *div.split_cols, whole.alias("_w"), *[F.when(whole, v).alias(f"_v{i}") for i, v in enumerate(values)], *([F.when(whole, clean(rows, weights)).alias("_wt")] if weights else []))
    used_rows = F.sum((F.col("_w") & (F.col("_wt") > 0) if weights else F.col("_w")).cast("bigint")).alias("_u")
    if weights:  # sums about the means of all rows, which keeps them small
        about = part.agg(*[F.avg(f"_v{i}") for i in range(p + 1)]).first()
        v = [F.col(f"_v{i}") - F.lit(about[i] or 0.0) for i in range(p + 1)]
        mean = lambda c: F.sum(F.col("_wt") * c) / F.sum("_wt")
        means = F.array(*[mean(c) + F.lit(about[i] or 0.0) for i, c in enumerate(v)])
        covs = F.array(*[mean(a * b) - mean(a) * mean(b) for a in v for b in v])
    else:
        means = F.array(*[F.avg(f"_v{i}") for i in range(p + 1)])
        covs = F.array(*[F.covar_pop(f"_v{i}", f"_v{j}") for i in range(p + 1) for j in range(p + 1)])
    sums = part.groupBy(KEY, *div.split_cols).agg(F.count(F.lit(1)).alias("n"), used_rows, means.alias("_m"), covs.alias("_c"))

    def solve(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for n_used, m, c in parts:
            out = []
            for u, mean, cov in zip(n_used, m, c):
                if not u:
                    plain = [i for i in range(p) if not any(a <= i < b for a, b in blocks)]
                    out.append([{"term": t, "coef": None} for t in ["(Intercept)", *(names[i] for i in plain)]])
                    continue
                mean, cov = np.asarray(mean, float), np.asarray(cov, float).reshape(p + 1, p + 1)
                keep = list(range(p))
                for a, b in blocks:  # of the levels that occur, the first is the base
                    there = [i for i in range(a, b) if mean[1 + i] > 0]
                    keep = [i for i in keep if not a <= i < b or i in there[1:]]
                at = [1 + i for i in keep]
                beta = np.linalg.lstsq(cov[np.ix_(at, at)], cov[at, 0], rcond=1e-12)[0] if at else np.zeros(0)
                out.append([{"term": t, "coef": float(b)} for t, b in zip(["(Intercept)", *(names[i] for i in keep)], [mean[0] - beta @ mean[at], *beta])])
            yield pd.Series(out)

    solve.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    kind = T._parse_datatype_string("array<struct<term:string,coef:double>>")
    res = sums.withColumn("_b", F.pandas_udf(solve, kind)("_u", "_m", "_c")).select(KEY, *div.split_cols, "n", F.explode("_b").alias("_t"))
    return Division(res.select(KEY, *div.split_cols, "_t.term", "_t.coef", "n"), div.split_cols, div.spec)


def _normal(z: np.ndarray) -> np.ndarray:
    from math import erf

    return np.array([0.5 * (1 + erf(x / 2**0.5)) for x in np.ravel(z)]).reshape(np.shape(z))


def _expit(e: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(e, -700, 700)))


def _logit(m: np.ndarray) -> np.ndarray:
    return np.log(m / (1 - m))


#: mean of the linear predictor, its slope, and the predictor of a mean, by link
LINKS = {
    "identity": (lambda e: e, lambda e: np.ones_like(e), lambda m: m),
    "logit": (_expit, lambda e: _expit(e) * _expit(-e), _logit),
    "probit": (_normal, lambda e: np.exp(-(e**2) / 2) / np.sqrt(2 * np.pi), lambda m: 1.7 * _logit(m) / 2.9),
    "cloglog": (lambda e: -np.expm1(-np.exp(np.clip(e, -700, 700))), lambda e: np.exp(np.clip(e, -700, 700) - np.exp(np.clip(e, -700, 700))), lambda m: np.log(-np.log1p(-m))),
    "log": (np.exp, np.exp, np.log),
    "inverse": (lambda e: 1 / e, lambda e: -1 / e**2, lambda m: 1 / m),
    "sqrt": (lambda e: e**2, lambda e: 2 * e, np.sqrt),
}
#: canonical link, variance of a mean, and a first mean of the observations, by family
FAMILIES = {
    "gaussian": ("identity", lambda m: np.ones_like(m), lambda y: y),
    "binomial": ("logit", lambda m: m * (1 - m), lambda y: (y + 0.5) / 2),
    "poisson": ("log", lambda m: m, lambda y: y + 0.1),
    "gamma": ("inverse", lambda m: m**2, lambda y: np.maximum(y, 1e-8)),
}


def irls(
    x: np.ndarray, y: np.ndarray, family: str = "gaussian", rounds: int = 50, tol: float = 1e-10, link: str | None = None, weights: np.ndarray | None = None, offset: np.ndarray | None = None
) -> np.ndarray:
    """Coefficients of a generalised linear model, by reweighted least squares; without ``link`` the family's canonical one."""
    canonical, variance, first = FAMILIES[family]
    inverse, slope, forward = LINKS[link or canonical]
    prior = np.ones(len(y)) if weights is None else weights
    known = np.zeros(len(y)) if offset is None else offset
    eta, beta = forward(first(y)).astype(float), None
    for _ in range(rounds):
        mu, d = inverse(eta), slope(eta)
        w = np.sqrt(prior * np.maximum(d**2 / np.maximum(variance(mu), 1e-12), 1e-12))
        z = eta - known + (y - mu) / np.where(np.abs(d) < 1e-12, 1e-12, d)
        new = np.linalg.lstsq(x * w[:, None], z * w, rcond=None)[0]
        done = beta is not None and np.max(np.abs(new - beta)) < tol * (1 + np.max(np.abs(new)))
        beta, eta = new, x @ new + known
        if done:
            break
    return beta


def dr_glm(div: Division, y: str, xs: Sequence[str], family: str = "gaussian", link: str | None = None, weights: str | None = None, offset: str | None = None, spread: bool = False) -> Division:
    """Generalised linear model per subset (gaussian, binomial, poisson, gamma; any of LINKS): rows ``term, coef, n``.

    Text and boolean predictors are factors as in ``dr_lm``. Rows with missing
    values are left out of the fit and counted in n. A subset is fitted in one
    task; divide at random first where subsets are large, or set ``spread``:
    then a round of reweighting is one aggregation over all rows in the JVM,
    for all subsets together, and none need fit a task (not for probit). The
    gaussian model with the identity link is ``dr_lm``.
    """
    if family not in FAMILIES:
        raise ValueError(f"no such family: {family}; there are {', '.join(FAMILIES)}")
    if link is not None and link not in LINKS:
        raise ValueError(f"no such link: {link}; there are {', '.join(LINKS)}")
    rows = div.rows()
    more = [c for c in (weights, offset) if c]
    require_columns(rows, [y, *xs, *more])
    if (family, link or "identity") == ("gaussian", "identity"):
        return dr_lm(div, y, xs, weights, offset)
    factors = _levels(rows, xs)
    if spread:
        return _spread_glm(div, rows, y, xs, factors, family, link or FAMILIES[family][0], weights, offset)
    narrow = rows.select(KEY, *div.split_cols, *[(F.col(f"`{c}`") if c in factors else clean(rows, c)).alias(f"_v{i}") for i, c in enumerate([y, *xs, *more])])
    split = list(div.split_cols)
    schema = T.StructType([narrow.schema[c] for c in (KEY, *split)] + T._parse_datatype_string(COEF).fields)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        full = pdf[[f"_v{i}" for i in range(1 + len(xs) + len(more))]].dropna()
        terms, cols = ["(Intercept)"], [np.ones(len(full))]
        for i, c in enumerate(xs, 1):
            if c in factors:
                there = [v for v in factors[c] if (full[f"_v{i}"] == v).any()]
                terms += [_level_name(c, v) for v in there[1:]]
                cols += [(full[f"_v{i}"] == v).to_numpy(float) for v in there[1:]]
            else:
                terms.append(c)
                cols.append(full[f"_v{i}"].to_numpy(float))
        extra = {n: full[f"_v{1 + len(xs) + more.index(c)}"].to_numpy(float) for n, c in (("weights", weights), ("offset", offset)) if c}
        beta = irls(np.column_stack(cols), full["_v0"].to_numpy(float), family, link=link, **extra) if len(full) else [None] * len(terms)
        out = pd.DataFrame({"term": terms, "coef": beta, "n": len(pdf)})
        for i, c in enumerate([KEY, *split]):
            out.insert(i, c, [pdf[c].iloc[0]] * len(out))
        return out

    return Division(grouped_pandas(narrow, KEY, fit, schema), div.split_cols, div.spec)


#: LINKS and FAMILIES for columns.
_LINK_COLUMNS = {
    "identity": (lambda e: e, lambda e: F.lit(1.0), lambda m: m),
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda e: 1 / (1 + F.exp(-e)) / (1 + F.exp(e)), lambda m: F.log(m / (1 - m))),
    "cloglog": (lambda e: -F.expm1(-F.exp(e)), lambda e: F.exp(e - F.exp(e)), lambda m: F.log(-F.log1p(-m))),
    "log": (F.exp, F.exp, F.log),
    "inverse": (lambda e: 1 / e, lambda e: -1 / (e * e), lambda m: 1 / m),
    "sqrt": (lambda e: e * e, lambda e: 2 * e, F.sqrt),
}
_FAMILY_COLUMNS = {
    "gaussian": (lambda m: F.lit(1.0), lambda y: y),
    "binomial": (lambda m: m * (1 - m), lambda y: (y + 0.5) / 2),
    "poisson": (lambda m: m, lambda y: y + 0.1),
    "gamma": (lambda m: m * m, lambda y: F.greatest(y, F.lit(1e-8))),
}


def _spread_glm(
    div: Division, rows: DataFrame, y: str, xs: Sequence[str], factors: dict[str, list], family: str, link: str, weights: str | None, offset: str | None, rounds: int = 50, tol: float = 1e-10
) -> Division:
    """``dr_glm`` without a subset in one task: sums of weighted products per round, small systems solved many at a time."""
    if link not in _LINK_COLUMNS:
        raise ValueError(f"the {link} link is not for spread fits")
    design, blocks, whole = _design(rows, y, xs, factors, weights, offset)
    names, p = ["(Intercept)", *(t for t, _ in design)], len(design) + 1
    one = lambda c, other: clean(rows, c) if c else F.lit(other)
    part = rows.select(KEY, *div.split_cols, whole.alias("_w"), clean(rows, y).alias("_y"), F.lit(1.0).alias("_x0"), *[v.alias(f"_x{i}") for i, (_, v) in enumerate(design, 1)], one(weights, 1.0).alias("_wt"), one(offset, 0.0).alias("_off"))
    part = stage(part, "design")
    heads = part.groupBy(KEY, *div.split_cols).agg(F.count(F.lit(1)).alias("n"))
    used = part.where("_w").drop(*div.split_cols)
    inverse, slope, forward = _LINK_COLUMNS[link]
    variance, first = _FAMILY_COLUMNS[family]
    x = [F.col(f"_x{i}") for i in range(p)]

    def solve(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for products, right, sums in parts:
            out = []
            for a, b, there in zip(products, right, sums):
                a, b, there = np.asarray(a, float).reshape(p, p), np.asarray(b, float), np.asarray(there, float)
                keep = list(range(p))
                for s, e in blocks:  # of the levels that occur, the first is the base
                    held = [i for i in range(s + 1, e + 1) if there[i] > 0]
                    keep = [i for i in keep if not s < i <= e or i in held[1:]]
                scale = np.sqrt(np.maximum(np.diag(a)[keep], 1e-300))  # columns of like size, for a sound solution
                beta = np.linalg.lstsq(a[np.ix_(keep, keep)] / scale[:, None] / scale, b[keep] / scale, rcond=1e-13)[0] / scale
                full: list[float | None] = [None] * p
                for i, v in zip(keep, beta):
                    full[i] = float(v)
                out.append(full)
            yield pd.Series(out)

    solve.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    beta = None
    for _ in range(rounds):
        if beta is None:
            now, eta = used, forward(first(F.col("_y")))
        else:
            side = broadcast_if_small(beta.select(F.col(KEY).alias("_bk"), F.col("beta").alias("_b")))
            now = used.join(side, F.col(KEY).eqNullSafe(F.col("_bk")))
            eta = F.col("_off")
            for i, c in enumerate(x):
                eta = eta + F.coalesce(F.get("_b", F.lit(i)), F.lit(0.0)) * c
        now = now.withColumn("_e", eta).withColumn("_mu", inverse(F.col("_e"))).withColumn("_d", slope(F.col("_e")))
        d = F.when(F.abs("_d") < 1e-12, 1e-12).otherwise(F.col("_d"))
        now = now.withColumn("_ww", F.col("_wt") * F.greatest(F.col("_d") * F.col("_d") / F.greatest(variance(F.col("_mu")), F.lit(1e-12)), F.lit(1e-12)))
        now = now.withColumn("_z", F.col("_e") - F.col("_off") + (F.col("_y") - F.col("_mu")) / d)
        sums = now.groupBy(KEY).agg(
            F.array(*[F.sum(F.col("_ww") * a * b) for a in x for b in x]).alias("_p"), F.array(*[F.sum(F.col("_ww") * a * F.col("_z")) for a in x]).alias("_r"), F.array(*[F.sum(a) for a in x]).alias("_s")
        )
        new = stage(sums.select(KEY, F.pandas_udf(solve, T.ArrayType(T.DoubleType()))("_p", "_r", "_s").alias("beta")), "beta")  # one row a subset
        if beta is not None:
            both = new.join(beta.select(F.col(KEY).alias("_bk"), F.col("beta").alias("_b")), F.col(KEY).eqNullSafe(F.col("_bk")))
            size = lambda v: F.coalesce(v, F.lit(0.0))
            step = F.array_max(F.zip_with("beta", "_b", lambda u, v: F.abs(size(u) - size(v))))
            open_ = both.where(step >= tol * (1 + F.array_max(F.transform("beta", lambda v: F.abs(size(v)))))).limit(1).count()
            beta = new
            if not open_:
                break
        beta = new
    found = beta.select(F.col(KEY).alias("_bk"), F.filter(F.arrays_zip(F.array(*[F.lit(t) for t in names]).alias("term"), F.col("beta").alias("coef")), lambda t: t["coef"].isNotNull()).alias("_t"))
    none = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(None).cast("double").alias("coef")) for i, t in enumerate(names) if not any(s < i <= e for s, e in blocks)])  # of a subset without complete rows
    res = heads.join(found, F.col(KEY).eqNullSafe(F.col("_bk")), "left").withColumn("_t", F.explode(F.coalesce("_t", none)))
    return Division(res.select(KEY, *div.split_cols, "_t.term", "_t.coef", "n"), div.split_cols, div.spec)


def blb(pdf: pd.DataFrame, statistic: Callable, metric: Callable, r: int, n: int, seed: int = 0) -> np.ndarray:
    """Bag of little bootstraps on one subset of b rows.

    ``r`` resamples of ``n`` rows are drawn as multinomial weights over the b
    rows, divided by their largest; ``statistic(frame, weights)`` gives numbers
    for each, and ``metric`` is taken over the resamples of every statistic.
    """
    b = len(pdf)
    draws = np.random.default_rng(seed).multinomial(n, np.full(b, 1 / b), size=r)
    stats = np.array([np.atleast_1d(statistic(pdf, w / w.max())) for w in draws], float)
    return np.concatenate([np.atleast_1d(metric(stats[:, i])) for i in range(stats.shape[1])])


def dr_blb(div: Division, statistic: Callable, metric: Callable, r: int, n: int, seed: int = 0) -> Division:
    """``blb`` on every subset (of a random division, as a rule): one array ``value`` per key, for ``comb_mean``.

    The random numbers depend on the key and seed alone.
    """
    from divrec.operators.division import _freeze

    rows = div.rows()
    stat, met, hidden = _freeze(statistic), _freeze(metric), [KEY, *div.split_cols]
    kind = rows.schema[KEY].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[KEY].iloc[0]
        own = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:15], 16)
        # rows in a fixed order, so that the draw is the same under any partitioning
        frame = pdf.drop(columns=hidden)
        frame = frame.sort_values(list(frame.columns)).reset_index(drop=True)
        return pd.DataFrame({KEY: [key], "value": [blb(frame, stat, met, r, n, own).tolist()]})

    return Division(grouped_pandas(rows, KEY, run, f"`{KEY}` {kind}, value array<double>"), spec=div.spec, is_ddo=True)
