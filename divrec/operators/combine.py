"""Recombination: putting the subsets' results together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divrec.operators.division import KEY, VALUE, Division, Pair, add_transform


@dataclass(frozen=True)
class Combine:
    """How results are put together; ``run`` takes the division with all functions deferred."""

    name: str
    run: Callable[[Division], Any]


def comb_collect(max_rows: int = 5_000_000) -> Combine:
    """Local list of pairs."""

    def run(div: Division) -> list[Pair]:
        rows = div.to_pandas(max_rows=max_rows, split_vars=False)
        cols = [c for c in rows.columns if c != KEY]
        if cols == [VALUE]:
            return [Pair(k, v) for k, v in zip(rows[KEY], rows[VALUE])]
        return [Pair(k, g.drop(columns=KEY).reset_index(drop=True)) for k, g in rows.groupby(KEY, sort=True, dropna=False)]

    return Combine("collect", run)


def comb_ddo() -> Combine:
    """The results stay a distributed collection."""
    return Combine("ddo", lambda div: div)


def comb_ddf() -> Combine:
    """Frames that share a key are bound together: they already share it as rows of one division, under the new keys."""
    return Combine("ddf", lambda div: Division(div.rows(), div.split_cols, div.spec, div.bsv_df, div.bsv_desc))


def comb_rbind() -> Combine:
    """All rows as one table, split variables first; other values become the column ``value``; empty results vanish."""
    return Combine("rbind", lambda div: div.rows().select(*[F.col(f"`{c}`") for c in (*div.split_cols, *div.value_cols)]))


def comb_mean() -> Combine:
    """Element-wise, unweighted mean over the subsets of their numeric vectors (column ``value``, or one row of numbers)."""

    def run(div: Division) -> DataFrame:
        rows = div.rows()
        kind = rows.schema[VALUE].dataType.simpleString() if VALUE in rows.columns else ""
        if kind.startswith("array"):
            each = rows.select(F.posexplode(VALUE).alias("pos", "v"))
        else:
            cols = div.value_cols
            each = rows.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("double") for c in cols])).alias("pos", "v"))
        return each.groupBy("pos").agg(F.avg("v").alias("mean"))

    return Combine("mean", run)


def comb_mean_coef() -> Combine:
    """Coefficients by name, weighted by the rows of their subset: sum(coef * n) / sum(n).

    Takes rows ``term, coef, n``; a subset that lacks a term counts for none of it.
    """

    def run(div: Division) -> DataFrame:
        rows = div.rows().where(F.col("coef").isNotNull())
        return rows.groupBy("term").agg((F.sum(F.col("coef") * F.col("n")) / F.sum("n")).alias("coef"))

    return Combine("mean_coef", run)


def recombine(div: Division, combine: Combine | Callable[[], Combine] | None = None, apply: Callable | None = None, output: str | None = None, overwrite: bool | str = False, **kw: Any) -> Any:
    """Put the results together; ``apply`` is a method deferred first.

    Without a combine, results are collected, or written where ``output`` is
    given. ``output`` writes a table result to that folder.
    """
    if apply is not None:
        div = add_transform(div, apply, **kw)
    if combine is None:
        combine = comb_ddo() if output else comb_collect()
    spec = combine() if not isinstance(combine, Combine) else combine
    if output is not None and spec.name == "collect":
        raise ValueError("collected results are local; use comb_ddo, comb_ddf or comb_rbind with an output")
    res = spec.run(div)
    if output is None:
        return res
    from dataclasses import replace

    from divrec.sources.connections import DiskConnection

    if isinstance(res, Division):
        return replace(res, df=DiskConnection(output).write(res.rows(), overwrite), transforms=(), schema=None)
    return DiskConnection(output).write(res, overwrite)
