"""Results that don't depend on how the rows are divided."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divrec.functions.keys import value_text
from divrec.operators.division import KEY, Division
from divrec.operators.skew import row_distribution
from divrec.runtime import broadcast_if_small, clean, require_columns

MAX_LEVELS = 10_000


def _table(data: Division | DataFrame) -> DataFrame:
    return data.flatten() if isinstance(data, Division) else data


# -- cross-tabulation --------------------------------------------------------------------------------------------------
def dr_aggregate(data: Division | DataFrame, formula: str, by: Sequence[str] | str | None = None, max_unique: int | None = None) -> DataFrame:
    """Cross-tabulation: ``~ a + b`` counts, ``y ~ a + b`` sums y, in column ``Freq``.

    Rows with a missing value in a used variable are left out, and so are cells
    of which the final Freq is not above 0. Grouping columns are text.
    ``by`` adds variables; with it the result has a column ``_key`` as well, one
    key per combination. ``max_unique``: keep the cells of the highest and the
    lowest half of so many (ties by cell), exactly.
    """
    df = _table(data)
    left, _, right = formula.partition("~")
    y, cells = left.strip(), [v.strip() for v in right.split("+") if v.strip()]
    groups = [by] if isinstance(by, str) else list(by or [])
    used = [*groups, *cells]
    require_columns(df, [*used, *([y] if y else [])])
    rows = df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() & (~F.isnan(F.col(f"`{c}`").cast("double")) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else F.lit(True)) for c in used], F.lit(True)))
    text = [value_text(df, c).alias(c) for c in used]
    freq = F.sum(clean(df, y)).alias("Freq") if y else F.count(F.lit(1)).cast("double").alias("Freq")
    res = rows.groupBy(*text).agg(freq).where("Freq > 0")
    if max_unique is not None:
        res = top_and_bottom(res, "Freq", used, max_unique)
    if groups:
        res = res.withColumn(KEY, F.concat_ws("|", *[F.concat(F.lit(f"{g}="), F.col(f"`{g}`")) for g in groups]))
    return res


def top_and_bottom(df: DataFrame, freq: str, ties: Sequence[str], keep: int) -> DataFrame:
    """The ``keep`` / 2 most and least frequent rows (all, if there are no more than ``keep``): two bounded top-k passes."""
    half = max(1, keep // 2)
    order = [F.col(f"`{c}`") for c in ties]
    if df.limit(keep + 1).count() <= keep:
        return df
    return df.orderBy(F.col(freq).desc(), *order).limit(half).union(df.orderBy(F.col(freq).asc(), *[c.desc() for c in order]).limit(half))


# -- binned quantiles --------------------------------------------------------------------------------------------------
def dr_quantile(
    data: Division | DataFrame,
    var: str,
    by: Sequence[str] | str | None = None,
    probs: Sequence[float] | None = None,
    *,
    transform: Callable[[Column], Column] | None = None,
    var_range: tuple[float, float] | None = None,
    n_bins: int = 10_000,
    tails: int = 0,
) -> DataFrame:
    """Quantiles from counts in ``n_bins`` equal bins: ``fval, q`` and the ``by`` columns.

    The range is that of the (transformed) variable, or ``var_range``, which is
    on the transformed scale. q is the middle of the first bin at which the
    cumulative share reaches fval: at most half a bin from the exact value of
    values within the range. ``tails``: the so many smallest and largest values
    of each group (fewer in smaller groups) take the place of the ends, at
    fval (k - 1) / n and (n - tails + k) / n. NULL and NaN are no values;
    infinite values count in the first and last bin.
    """
    df = _table(data)
    groups = [by] if isinstance(by, str) else list(by or [])
    require_columns(df, [var, *groups])
    ps = [i / 200.0 for i in range(201)] if probs is None else list(probs)
    v = clean(df, var)
    v = transform(v) if transform else v
    rows = df.select(*groups, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if var_range is None:  # infinite values are no ends of the range; they count in the end bins
        finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
        lo, hi = rows.agg(F.min(finite), F.max(finite)).first()
        within = F.lit(True)
    else:
        lo, hi = sorted(map(float, var_range))
        within = F.col("_v").between(lo, hi)
    if lo is None:
        return rows.select(F.lit(0.0).alias("fval"), F.col("_v").alias("q"), *groups).limit(0)
    delta = (hi - lo) / (n_bins - 1)
    clamped = F.greatest(F.least(F.col("_v"), F.lit(hi)), F.lit(lo))
    bin_of = F.ceil((clamped - F.lit(lo - delta / 2)) / F.lit(delta)).cast("int") if delta > 0 else F.lit(1)
    every = rows.groupBy(*groups, bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias("_all"), F.count_if(within).alias("_f"))
    # At most n_bins rows a group from here on.
    from pyspark.sql import Window

    up, whole = Window.partitionBy(*groups).orderBy("_bin"), Window.partitionBy(*groups)
    counts = every.where("_f > 0")
    share = F.sum("_f").over(up) / F.sum("_f").over(whole).cast("double")
    cum = counts.withColumn("_c", share).withColumn("_p", F.coalesce(F.lag("_c").over(up), F.lit(-1.0)))
    hit = F.filter(F.array(*[F.lit(float(p)) for p in ps]), lambda p: (p <= F.col("_c")) & (p > F.col("_p")))
    res = cum.withColumn("fval", F.explode(hit)).select("fval", (F.lit(lo) + (F.col("_bin") - 1) * F.lit(delta)).alias("q"), *groups)
    if tails <= 0:
        return res
    ends = every.withColumn("_n", F.sum("_all").over(whole)).withColumn("_up", F.sum("_all").over(up))
    t = F.least(F.lit(tails), F.col("_n"))
    bounds = ends.groupBy(*groups).agg(
        F.max("_n").alias("_n"), F.min(F.when(F.col("_up") >= t, F.col("_bin"))).alias("_lo"), F.max(F.when(F.col("_n") - F.col("_up") + F.col("_all") >= t, F.col("_bin"))).alias("_hi")
    )
    return _with_tails(rows.withColumn("_bin", bin_of), res, bounds, groups, tails)


def _with_tails(rows: DataFrame, res: DataFrame, bounds: DataFrame, groups: list[str], tails: int) -> DataFrame:
    """``res`` with each group's smallest and largest values for its ends.

    ``bounds`` says in which bins of a group they lie, so that only values of
    those bins, combined to (value, count), are ranked.
    """
    from divrec.operators.scan import ordered_scan

    names = [f"_g{i}" for i in range(len(groups))]

    def join(a: DataFrame, side: DataFrame) -> DataFrame:  # a missing value is a group like any other
        if not groups:  # one row
            only = side.first().asDict()
            return a.withColumns({c: F.lit(v) for c, v in only.items()})
        side = broadcast_if_small(side.withColumnsRenamed(dict(zip(groups, names))))
        return a.join(side, reduce(lambda x, y: x & y, [F.col(f"`{g}`").eqNullSafe(F.col(n)) for g, n in zip(groups, names)])).drop(*names)

    near = join(rows, bounds)
    states = near.where((F.col("_bin") <= F.col("_lo")) | (F.col("_bin") >= F.col("_hi"))).groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_f"))
    ranked = ordered_scan(states, groups, ["_v"], sums={"_cum": "_f"})
    sizes = bounds.select(*groups, "_n")
    held = ranked.groupBy(*groups).agg(F.sum("_f").alias("_held")) if groups else ranked.agg(F.sum("_f").alias("_held"))
    ranked = join(join(ranked, sizes), held)
    t = F.least(F.lit(tails), F.col("_n"))
    # values lie in the two ends, so the rank from the top is that among the values held, too
    first, last = F.col("_cum") - F.col("_f") + 1, F.col("_cum")
    low = F.when(first <= t, F.sequence(first, F.least(last, t)))
    gap = F.col("_n") - F.col("_held")
    above = F.greatest(first + gap, F.col("_n") - t + 1, t + 1)
    high = F.when(above <= last + gap, F.sequence(above, last + gap))
    bottom = ranked.select(F.explode(low).alias("_k"), "_n", F.col("_v").alias("q"), *groups).select(((F.col("_k") - 1) / F.col("_n")).alias("fval"), "q", *groups)
    top = ranked.select(F.explode(high).alias("_k"), "_n", F.col("_v").alias("q"), *groups).select((F.col("_k") / F.col("_n")).alias("fval"), "q", *groups)
    inner = join(res, sizes).where((F.col("fval") > (t - 1) / F.col("_n")) & (F.col("fval") < (F.col("_n") - t + 1) / F.col("_n"))).select("fval", "q", *groups)
    return bottom.unionByName(inner).unionByName(top)


# -- hexagon bins ------------------------------------------------------------------------------------------------------
def dr_hexbin(
    data: Division | DataFrame,
    x: str,
    y: str,
    by: Sequence[str] | str | None = None,
    *,
    x_transform: Callable[[Column], Column] | None = None,
    y_transform: Callable[[Column], Column] | None = None,
    x_range: tuple[float, float] | None = None,
    y_range: tuple[float, float] | None = None,
    xbins: int = 30,
    shape: float = 1.0,
) -> DataFrame:
    """Hexagonal bins: per cell ``lattice, i, j, count, xcm, ycm`` (centre of mass) and the ``by`` columns.

    Two offset rectangular lattices; a point belongs to the nearer centre under
    dx^2 + 3 dy^2, a tie to the first. Ranges are on the raw scale; each that
    is missing is found. Rows with a missing coordinate are left out.
    """
    df = _table(data)
    groups = [by] if isinstance(by, str) else list(by or [])
    require_columns(df, [x, y, *groups])
    cx, cy = clean(df, x), clean(df, y)
    rows = df.select(*groups, (x_transform(cx) if x_transform else cx).alias("_x"), (y_transform(cy) if y_transform else cy).alias("_y")).where("_x is not null and _y is not null")
    ends = rows.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first() if x_range is None or y_range is None else None

    def scale(given: tuple | None, fn: Callable | None, at: int) -> tuple[float, float]:
        if given is None:
            return ends[at], ends[at + 1]
        if fn is None:
            return given
        row = df.sparkSession.range(1).select(fn(F.lit(float(given[0]))).alias("a"), fn(F.lit(float(given[1]))).alias("b")).first()
        return row["a"], row["b"]

    (x0, x1), (y0, y1) = scale(x_range, x_transform, 0), scale(y_range, y_transform, 2)
    if x0 is None or y0 is None:
        x0 = x1 = y0 = y1 = 0.0
    sx = F.lit(float(xbins)) * (F.col("_x") - x0) / (x1 - x0) if x1 > x0 else F.lit(0.0)
    sy = F.lit(float(xbins * shape)) * (F.col("_y") - y0) / ((y1 - y0) * math.sqrt(3.0)) if y1 > y0 else F.lit(0.0)
    s = rows.withColumn("_sx", sx).withColumn("_sy", sy)
    j1, i1, j2, i2 = F.floor(F.col("_sx") + 0.5), F.floor(F.col("_sy") + 0.5), F.floor("_sx"), F.floor("_sy")
    square = lambda c: c * c
    d1 = square(F.col("_sx") - j1) + 3.0 * square(F.col("_sy") - i1)
    d2 = square(F.col("_sx") - j2 - 0.5) + 3.0 * square(F.col("_sy") - i2 - 0.5)
    first = d1 <= d2
    cells = s.select(*groups, "_x", "_y", F.when(first, 0).otherwise(1).alias("lattice"), F.when(first, i1).otherwise(i2).alias("i"), F.when(first, j1).otherwise(j2).alias("j"))
    return cells.groupBy(*groups, "lattice", "i", "j").agg(F.count(F.lit(1)).alias("count"), F.avg("_x").alias("xcm"), F.avg("_y").alias("ycm"))


# Moments of parts are combined by the pairwise updates of arbitrary order of Bennett et al., "Numerically stable,
# single-pass, parallel statistics algorithms" (IEEE CLUSTER 2009).
# -- moments -----------------------------------------------------------------------------------------------------------
def moments_of(column: Column, order: int = 4) -> Column:
    """A mergeable record ``n, M1 (mean), M2.. (sums of powers about the mean)`` as one aggregate."""
    n, m = F.count(column).cast("double"), F.avg(column)
    parts = [n.alias("n"), m.alias("M1")]
    if order >= 2:
        parts.append((F.var_pop(column) * n).alias("M2"))
    if order >= 3:
        parts.append((F.skewness(column) * F.pow(F.var_pop(column), 1.5) * n).alias("M3"))
    if order >= 4:
        parts.append(((F.kurtosis(column) + 3.0) * F.pow(F.var_pop(column), 2.0) * n).alias("M4"))
    return F.struct(*parts)


def calculate_moments(values: Sequence[float | None], order: int = 2) -> dict | None:
    """Moments of local values; missing ones are left out, and without any the record is None."""
    v = [float(x) for x in values if x is not None and not math.isnan(x)]
    if not v:
        return None
    mean = math.fsum(v) / len(v)
    return {"n": float(len(v)), "M1": mean, **{f"M{k}": math.fsum((x - mean) ** k for x in v) for k in range(2, order + 1)}}


def combine_moments(a: Mapping | None, b: Mapping | None) -> dict | None:
    """Moments of two parts as those of both, of any order (pairwise update formulas for central moments)."""
    if a is None or not a["n"]:
        return dict(b) if b is not None else None
    if b is None or not b["n"]:
        return dict(a)
    na, nb = a["n"], b["n"]
    n, d = na + nb, b["M1"] - a["M1"]
    out = {"n": n, "M1": a["M1"] + d * nb / n}
    p = 2
    while f"M{p}" in a and f"M{p}" in b:
        mid = sum(math.comb(p, k) * ((-nb / n * d) ** k * a[f"M{p - k}"] + (na / n * d) ** k * b[f"M{p - k}"]) for k in range(1, p - 1))
        out[f"M{p}"] = a[f"M{p}"] + b[f"M{p}"] + mid + (na * nb / n * d) ** p * (1 / nb ** (p - 1) - (-1 / na) ** (p - 1))
        p += 1
    return out


def combine_multiple_moments(*parts: Mapping | None) -> dict | None:
    return reduce(combine_moments, [p for p in parts if p is not None], None)


def moments_to_statistics(m: Mapping | None) -> dict | None:
    """mean, var, skewness and kurtosis (not excess) of a record; NaN where they are not defined."""
    if m is None:
        return None
    n, nan = m["n"], float("nan")
    out = {"mean": m["M1"]}
    if "M2" in m:
        out["var"] = m["M2"] / (n - 1) if n > 1 else nan
    flat = not m.get("M2")
    if "M3" in m:
        out["skewness"] = nan if flat else (m["M3"] / n) / (m["M2"] / n) ** 1.5
    if "M4" in m:
        out["kurtosis"] = nan if flat else n * m["M4"] / m["M2"] ** 2
    return out


# -- column summaries and attributes -------------------------------------------------------------------------------
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def kinds(df: DataFrame) -> dict[str, str]:
    """numeric, categ or datetime per column; others have no summary."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC):
            out[f.name] = "numeric"
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = "categ"
        elif isinstance(f.dataType, TIMES):
            out[f.name] = "datetime"
    return out


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: ``nna, n, mean, var, skewness, kurtosis`` (not excess), ``min, max``; all in one pass."""
    return df.agg(F.array(*_numeric_parts(df, columns)).alias("_a")).select(F.inline("_a"))


def _numeric_parts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    aggs = []
    for c in columns:
        v = clean(df, c)
        aggs.append(
            F.struct(
                F.lit(c).alias("variable"), (F.count(F.lit(1)) - F.count(v)).alias("nna"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"),
                F.skewness(v).alias("skewness"), (F.kurtosis(v) + 3.0).alias("kurtosis"), F.min(v).alias("min"), F.max(v).alias("max"),
            )
        )
    return aggs


def frequency_summary(df: DataFrame, column: str, max_levels: int = MAX_LEVELS) -> DataFrame:
    """``value, Freq, complete``: counts of a text column; of more than ``max_levels`` levels the most and least frequent halves."""
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("Freq"))
    kept = top_and_bottom(counts, "Freq", ["value"], max_levels)
    return kept.withColumn("complete", F.lit(kept is counts))


def datetime_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: ``nna, min, max`` (as timestamps without zone)."""
    return df.agg(F.array(*_time_parts(columns)).alias("_a")).select(F.inline("_a"))


def _time_parts(columns: Sequence[str]) -> list[Column]:
    return [
        F.struct(F.lit(c).alias("variable"), (F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))).alias("nna"), F.min(F.col(f"`{c}`")).cast("timestamp_ntz").alias("min"), F.max(F.col(f"`{c}`")).cast("timestamp_ntz").alias("max"))
        for c in columns
    ]


def split_row_distn(div: Division) -> DataFrame:
    """nRow, nDiv and the 101 percentiles of rows per subset."""
    counts = div.rows().groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("key_column", F.lit("key"))
    return row_distribution(counts).select("nrow", "ndiv", "splitrowdistn")


def split_size_distn(div: Division) -> DataFrame:
    """The same of (approximate, uncompressed) bytes per subset: text length of the rows' JSON."""
    rows = div.rows()
    size = F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))).alias("n")
    return row_distribution(rows.groupBy(KEY).agg(size).withColumn("key_column", F.lit("key"))).select(F.col("nrow").alias("totObjectSize"), "ndiv", F.col("splitrowdistn").alias("splitsizedistn"))


def frequency_tables(df: DataFrame, columns: Sequence[str], max_levels: int = MAX_LEVELS) -> DataFrame:
    """``variable, value, Freq, complete`` of several text columns in one pass; missing values are a row with value NULL.

    Of a column with more than ``max_levels`` levels the most and the least
    frequent halves; levels are ranked by a distributed sort, and a column may
    have as many as rows.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("_e"))
    from divrec.runtime import stage

    counts = stage(long.groupBy("_e.variable", "_e.value").agg(F.count(F.lit(1)).alias("Freq")), "levels")
    from divrec.operators.scan import row_numbers

    present = counts.where("value is not null").withColumn("_neg", -F.col("Freq"))
    totals = present.groupBy("variable").agg(F.count(F.lit(1)).alias("_levels"))  # one row a column
    ranked = row_numbers(present, ["variable"], ["_neg", "value"], "_rank").join(F.broadcast(totals), "variable")
    half = max(1, max_levels // 2)
    kept = ranked.where((F.col("_levels") <= max_levels) | (F.col("_rank") <= half) | (F.col("_rank") > F.col("_levels") - half))
    missing = counts.where("value is null").withColumn("complete", F.lit(True))
    return kept.select("variable", "value", "Freq", (F.col("_levels") <= max_levels).alias("complete")).unionByName(missing)


def update_attributes(div: Division) -> Division:
    """The division with the attributes it doesn't know yet.

    nRow, nDiv, splitRowDistn, totObjectSize and splitSizeDistn (uncompressed
    bytes, as JSON text) and keys (None if there are more than MAX_LEVELS; see
    ``get_keys``) come from one aggregation by key; vars and summary from one
    over all numeric and time columns and one over all text columns, however
    many there are.
    """
    have, new = set(div.attrs), {}
    if div.transforms:
        raise ValueError("persist a transformed division before asking for its attributes")
    if not {"nRow", "nDiv", "splitRowDistn", "totObjectSize", "splitSizeDistn", "keys"} <= have:
        from divrec.runtime import stage

        size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in div.df.columns]))).cast("bigint"))
        per = stage(div.df.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows"), size.alias("bytes")), "keys")
        both = per.select(KEY, F.explode(F.array(F.struct(F.lit("rows").alias("key_column"), F.col("rows").alias("n")), F.struct(F.lit("bytes").alias("key_column"), F.col("bytes").alias("n")))).alias("_e"))
        got = {r["key_column"]: r for r in row_distribution(both.select("_e.key_column", "_e.n")).collect()}
        r, b = got.get("rows"), got.get("bytes")
        new.update(nRow=r["nrow"] if r else 0, nDiv=r["ndiv"] if r else 0, splitRowDistn=list(r["splitrowdistn"]) if r else [])
        new.update(totObjectSize=b["nrow"] if b else 0, splitSizeDistn=list(b["splitrowdistn"]) if b else [])
        new["keys"] = [x[0] for x in per.select(KEY).orderBy(KEY).collect()] if new["nDiv"] <= MAX_LEVELS else None
    if "summary" not in have:
        df = div.df.select(*[F.col(f"`{c}`") for c in div.value_cols])
        by = kinds(df)
        summary: dict[str, Any] = {}
        num, tim, cat = ([c for c, k in by.items() if k == kind] for kind in ("numeric", "datetime", "categ"))
        if num or tim:
            parts = [F.array(*_numeric_parts(df, num)).alias("num")] * bool(num) + [F.array(*_time_parts(tim)).alias("tim")] * bool(tim)
            row = df.agg(*parts).first()
            for r in [*(row["num"] if num else []), *(row["tim"] if tim else [])]:
                summary[r["variable"]] = r.asDict()
        if cat:
            levels: dict[str, list] = {c: [] for c in cat}
            nna, complete = dict.fromkeys(cat, 0), dict.fromkeys(cat, False)
            for r in frequency_tables(df, cat).collect():  # at most MAX_LEVELS and one a column
                if r["value"] is None:
                    nna[r["variable"]] = r["Freq"]
                else:
                    levels[r["variable"]].append((r["value"], r["Freq"]))
                    complete[r["variable"]] = r["complete"]
            for c in cat:
                summary[c] = {"variable": c, "nna": nna[c], "freqTable": sorted(levels[c], key=lambda x: (-x[1], x[0])), "complete": complete[c]}
        new.update(summary={c: summary[c] for c in by}, vars={f.name: f.dataType.simpleString() for f in df.schema.fields})
    return replace(div, attrs={**div.attrs, **new}) if new else div


def format_summary(div: Division, levels: int = 4) -> str:
    """The summary attribute as text, one block per column: missing values, then range and moments, or the most frequent levels."""
    summary = div.attrs.get("summary")
    if not summary:
        return "no summary is known; see update_attributes"
    lines = []
    for name, s in summary.items():
        lines.append(f"{name}: {s['nna']} missing")
        if "freqTable" in s:
            lines += [f"  {v}: {n}" for v, n in s["freqTable"][:levels]]
            if len(s["freqTable"]) > levels or not s["complete"]:
                lines.append(f"  ... {len(s['freqTable'])} levels{'' if s['complete'] else ' of more'}")
        else:
            lines += [f"  {k}: {s[k]}" for k in ("min", "max", "mean", "var", "skewness", "kurtosis") if k in s]
    return "\n".join(lines)
