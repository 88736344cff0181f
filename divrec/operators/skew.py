"""Per-key results when a few keys hold most of the records.

``eager_join_aggregate`` computes aggregates of a join without building the
join: both inputs are pre-aggregated by join key (map-side, so a key held by a
third of all rows sends one small state per task), the compact states are
joined, and the join's counts and sums follow from the states by algebra. The
work per task depends on the number of distinct keys, not on the rows per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from divrec.runtime import clean, require_columns


def key_text(column: Column) -> Column:
    """A key as text; a missing key is the key ``NA``."""
    return F.coalesce(column.cast("string"), F.lit("NA"))


def key_states(df: DataFrame, keys: Mapping[str, str], sums: Sequence[str] = ()) -> DataFrame:
    """Compact states per key, for several key columns in one pass over ``df``.

    ``keys`` maps a label to the column holding the key. Result: ``key_column``
    (label), ``key_value`` (text, missing = ``NA``), ``n`` (rows, every stored
    row counts), and per column c of ``sums``: ``n_c`` (values that are neither
    NULL nor NaN), ``sum_c``, ``min_c``, ``max_c`` (NULL if there is no value).
    Repeated rows count as often as they are stored; an empty table gives no rows.
    """
    require_columns(df, [*keys.values(), *sums])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("key_column"), key_text(F.col(f"`{c}`")).alias("key_value")) for k, c in keys.items()]))
    values = [clean(df, c).alias(f"_v_{c}") for c in sums]
    # Partial aggregation runs below the exchange, so only (distinct keys x tasks) states are shuffled.
    rows = df.select(pairs.alias("_k"), *values)
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in sums:
        v = F.col(f"`_v_{c}`")
        aggs += [F.count(v).alias(f"n_{c}"), F.sum(v).alias(f"sum_{c}"), F.min(v).alias(f"min_{c}"), F.max(v).alias(f"max_{c}")]
    return rows.groupBy("_k.key_column", "_k.key_value").agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    products: Sequence[tuple[str, str]] = (),
    left_groups: Sequence[str] = (),
    right_groups: Sequence[str] = (),
    left_weight: str | None = None,
    right_weight: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Aggregates of ``left JOIN right USING (on)`` grouped by ``left_groups`` and ``right_groups``.

    Result: the group columns, ``n_rows`` (rows of the join), ``left_rows`` and
    ``right_rows`` (rows of either side that take part, counted once for each
    group of the other side), per c of ``left_sums`` ``sum_c`` = sum over the
    joined rows, likewise for ``right_sums``, and per (a, b) of ``products``
    ``sum_a_b`` = sum of left.a * right.b. NULL and NaN are no values; a sum
    without values is NULL. A NULL key joins nothing, unless ``null_safe``.
    Columns with the same name on both sides, or named like a result column,
    do no harm: the states carry their own names. Empty inputs give no rows.

    ``left_weight`` and ``right_weight`` name a column that says how many rows
    each row stands for (states of an earlier pre-aggregation); sums then must
    not be asked of that side's weighted rows other than as already summed.

    Algebra: for a key with states (nL, sL, cL) and (nR, sR, cR) the join holds
    nL * nR rows, the sum of a left column over them is sL * nR, and the sum of
    products is sL * sR. States of the same key but other groups add up.
    """
    require_columns(left, [*on, *left_sums, *left_groups, *(a for a, _ in products)])
    require_columns(right, [*on, *right_sums, *right_groups, *(b for _, b in products)])

    def states(df: DataFrame, side: str, groups: Sequence[str], sums: Sequence[str], weight: str | None) -> DataFrame:
        cols = [F.col(f"`{c}`").alias(f"_{side}k{i}") for i, c in enumerate(on)]
        grp = [F.col(f"`{c}`").alias(f"_{side}g{i}") for i, c in enumerate(groups)]
        val = [clean(df, c).alias(f"_{side}v_{c}") for c in sums]
        times = F.col(f"`{weight}`") if weight else F.lit(1)
        rows = df.select(*cols, *grp, *val, times.cast("bigint").alias("_w"))
        if not null_safe:
            for i in range(len(on)):
                rows = rows.where(F.col(f"_{side}k{i}").isNotNull())
        aggs = [F.sum("_w").alias(f"_{side}n")]
        for c in sums:
            aggs.append(F.sum(F.col(f"`_{side}v_{c}`")).alias(f"_{side}s_{c}"))
        return rows.groupBy(*[f"_{side}k{i}" for i in range(len(on))], *[f"_{side}g{i}" for i in range(len(groups))]).agg(*aggs)

    lcols = list(dict.fromkeys([*left_sums, *(a for a, _ in products)]))
    rcols = list(dict.fromkeys([*right_sums, *(b for _, b in products)]))
    ls, rs = states(left, "l", left_groups, lcols, left_weight), states(right, "r", right_groups, rcols, right_weight)
    same = [F.col(f"_lk{i}").eqNullSafe(F.col(f"_rk{i}")) if null_safe else F.col(f"_lk{i}") == F.col(f"_rk{i}") for i in range(len(on))]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    joined = ls.join(rs, cond)
    ln, rn = F.col("_ln"), F.col("_rn")
    aggs = [F.sum(ln * rn).alias("n_rows"), F.sum(ln).alias("left_rows"), F.sum(rn).alias("right_rows")]
    aggs += [F.sum(F.col(f"`_ls_{c}`") * rn).alias(f"sum_{c}") for c in left_sums]
    aggs += [F.sum(F.col(f"`_rs_{c}`") * ln).alias(f"sum_{c}") for c in right_sums]
    aggs += [F.sum(F.col(f"`_ls_{a}`") * F.col(f"`_rs_{b}`")).alias(f"sum_{a}_{b}") for a, b in products]
    groups = [F.col(f"_lg{i}").alias(c) for i, c in enumerate(left_groups)] + [F.col(f"_rg{i}").alias(c) for i, c in enumerate(right_groups)]
    return joined.groupBy(*groups).agg(*aggs)


def key_shares(df: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Rows per key and the share of all stored rows, through the eager join of keys with their key column.

    The join of the rows of a key with all rows of its key column has n * N rows
    per key and is never built: the left states are the counts per key, the
    right states the counts per key column. Result: ``key_column``,
    ``key_value``, ``n_row``, ``n_all``, ``share``.
    """
    states = key_states(df, keys)
    joined = eager_join_aggregate(
        states, states, ["key_column"], left_groups=["key_column", "key_value"], left_weight="n", right_weight="n"
    )
    return joined.select(
        "key_column", "key_value", F.col("left_rows").alias("n_row"), F.col("right_rows").alias("n_all"), (F.col("left_rows") / F.col("right_rows")).alias("share")
    )


def row_distribution(states: DataFrame, n: str = "n") -> DataFrame:
    """nRow, nDiv and splitRowDistn (101 percentiles, linear interpolation) per key column.

    The percentiles come from the histogram of key sizes (how many keys hold n
    rows), so not even one entry per key reaches a single task.
    """
    sizes = states.groupBy("key_column", F.col(n).alias("_n")).agg(F.count(F.lit(1)).alias("_keys"))
    probs = F.array(*[F.lit(i / 100.0) for i in range(101)])
    return sizes.groupBy("key_column").agg(
        F.sum(F.col("_n") * F.col("_keys")).alias("nrow"),
        F.sum("_keys").alias("ndiv"),
        F.percentile(F.col("_n"), probs, F.col("_keys")).alias("splitrowdistn"),
    )
