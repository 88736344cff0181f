"""Percentiles of very large numeric columns by a full distributed sort.

Values are first combined to states (group, value, count): repeated values,
however hot, are one row per task before the shuffle, and states of separate
partitions or days add up to the state of all. The states are sorted across
the cluster; counts per partition give every group's offset in each partition,
so the rows holding the wanted positions are found exactly, and neighbouring
order statistics are interpolated where asked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divrec.operators.scan import ordered_scan
from divrec.runtime import broadcast_if_small, clean, require_columns


def first_deliveries(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``key``: its first delivery by ``order``, with ``columns`` and the ``order`` columns.

    Rows without a key are all kept. Combined map-side, so a key repeated a
    billion times is no hot task.
    """
    require_columns(df, [key, *columns, *order])
    cols = list(dict.fromkeys([*order, *columns]))
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*cols)).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in cols])
    return keyed.unionByName(df.where(F.col(key).isNull()).select(*cols))


def quantile_states(df: DataFrame, specs: Sequence[tuple[int, str, str | None]], keep: Sequence[str] = ()) -> DataFrame:
    """States of several quantile calls in one pass: ``spec_id, grp, *keep, value, n``.

    ``specs`` holds (spec_id, variable, by); without ``by`` all rows are the
    group ``all``. A missing group is the group ``NA``. NULL
    and NaN are no values; infinities are. ``keep`` columns (a day, say) split
    the states so that parts can be stored and combined later.
    """
    require_columns(df, [*(v for _, v, _ in specs), *(b for _, _, b in specs if b), *keep])
    each = [
        F.struct(
            F.lit(i).cast("int").alias("spec_id"),
            (F.coalesce(F.col(f"`{b}`").cast("string"), F.lit("NA")) if b else F.lit("all")).alias("grp"),
            (clean(df, v) + F.lit(0.0)).alias("value"),
        )
        for i, v, b in specs
    ]
    rows = df.select(F.explode(F.array(*each)).alias("_s"), *[F.col(f"`{k}`") for k in keep])
    rows = rows.select("_s.spec_id", "_s.grp", "_s.value", *keep).where(F.col("value").isNotNull())
    return rows.groupBy("spec_id", "grp", *keep, "value").agg(F.count(F.lit(1)).alias("n"))


def merge_states(states: DataFrame) -> DataFrame:
    """States of separate parts combined to those of all parts."""
    return states.groupBy("spec_id", "grp", "value").agg(F.sum("n").alias("n"))


def quantiles(states: DataFrame, probs: DataFrame, interpolate: bool = False) -> DataFrame:
    """Percentiles of merged states; ``probs`` has ``spec_id`` and ``probs`` (array, any order, repeats allowed).

    Result: ``spec_id, grp, prob`` (distinct), ``n`` (values of the group) and
    ``q``. Without ``interpolate`` q is the smallest value v such that at least
    the fraction prob of the group's values are <= v (error 0); with it, the
    neighbouring order statistics at position (n - 1) * prob are interpolated.
    Positions are exact decimal arithmetic on the probs as they are written
    (0.035 is 35/1000, to 17 decimals), so no rounding of p * n picks a
    neighbour, however large the group. Probs that are NULL or outside 0..1 are
    left out. A group without values has no row; an empty table gives none.
    """
    wanted = probs.select("spec_id", F.array_distinct(F.filter("probs", lambda p: p.isNotNull() & (p >= 0) & (p <= 1))).alias("_probs"))
    placed = ordered_scan(states.select("spec_id", "grp", "value", "n"), ["spec_id", "grp"], ["value"], sums={"_cum": "n"})
    totals = placed.groupBy("spec_id", "grp").agg(F.max("_cum").alias("_n")).join(broadcast_if_small(wanted), "spec_id")

    # Target positions from 1. decimal(18,17) times decimal(19,0) is exact in 38 digits.
    def target(p, n):
        whole, exact = n.cast("decimal(19,0)"), p.cast("string").cast("decimal(18,17)")
        if interpolate:
            at = exact * (n - 1).cast("decimal(19,0)")
            lo = F.floor(at).cast("bigint") + 1
            return F.struct(p.alias("prob"), lo.alias("lo"), F.least(lo + 1, n).alias("hi"), (at - F.floor(at)).cast("double").alias("share"))
        lo = F.greatest(F.ceil(exact * whole).cast("bigint"), F.lit(1).cast("bigint"))
        return F.struct(p.alias("prob"), lo.alias("lo"), lo.alias("hi"), F.lit(0.0).alias("share"))

    targets = totals.withColumn("_t", F.transform("_probs", lambda p: target(p, F.col("_n")))).drop("_probs")
    start, end = F.col("_cum") - F.col("n"), F.col("_cum")
    here = lambda k: (k > start) & (k <= end)
    # One row per group on the small side, and only states that hold a wanted position go on.
    hits = placed.join(broadcast_if_small(targets), ["spec_id", "grp"]).withColumn("_hit", F.filter("_t", lambda t: here(t["lo"]) | here(t["hi"])))
    hits = hits.where(F.size("_hit") > 0).select("spec_id", "grp", F.col("_n"), "value", F.col("_cum"), F.col("n"), F.explode("_hit").alias("_h"))
    at = lambda side: F.max(F.when(here(F.col("_h")[side]), F.col("value")))
    found = hits.groupBy("spec_id", "grp", F.col("_h")["prob"].alias("prob"), F.col("_n").alias("n")).agg(
        at("lo").alias("_lo"), at("hi").alias("_hi"), F.max(F.col("_h")["share"]).alias("_share")
    )
    between = F.when((F.col("_share") == 0) | (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise(F.col("_lo") + F.col("_share") * (F.col("_hi") - F.col("_lo")))
    return found.select("spec_id", "grp", "prob", "n", between.alias("q"))
