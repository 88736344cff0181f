"""Most frequent items among billions of rows, in bounded memory.

Pass 1: every partition keeps a space-saving summary of at most ``k`` counters;
summaries are merged in a tree, and every count carries its error bound. A
value held by more than rows / k rows is certain to be in the merged summary.
Pass 2 counts the surviving candidates exactly, over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from divrec.runtime import require_columns, stage

SUMMARY = "part int, floor bigint, item string, est bigint, err bigint, rows bigint"
#: Counters in a summary: the guaranteed threshold is rows / COUNTERS.
COUNTERS = 2048
FANIN = 16


def merge_summary(a: dict, a_floor: int, b: dict, b_floor: int, k: int) -> tuple[dict, int]:
    """Two space-saving summaries as one of at most ``k`` counters.

    A summary maps item -> (estimate, error), with count <= estimate and
    estimate - error <= count, and ``floor`` bounds the count of any item that
    it does not hold. An item missing on one side may have had up to that
    side's floor. Of equal estimates the smaller item is kept.
    """
    out = {}
    for item, (est, err) in a.items():
        other = b.get(item)
        out[item] = (est + other[0], err + other[1]) if other else (est + b_floor, err + b_floor)
    for item, (est, err) in b.items():
        if item not in a:
            out[item] = (est + a_floor, err + a_floor)
    floor = a_floor + b_floor
    if len(out) > k:
        ranked = sorted(out.items(), key=lambda x: (-x[1][0], x[0]))
        floor = max(floor, ranked[k][1][0])
        out = dict(ranked[:k])
    return out, floor


def _emit(part: int, summary: dict, floor: int, rows: int) -> pa.RecordBatch:
    """A summary as rows; each carries the number of ``rows`` that it sums up."""
    items = sorted(summary.items())
    n = len(items)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * n, pa.int32()),
            pa.array([floor] * n, pa.int64()),
            pa.array([i for i, _ in items], pa.string()),
            pa.array([v[0] for _, v in items], pa.int64()),
            pa.array([v[1] for _, v in items], pa.int64()),
            pa.array([rows] * n, pa.int64()),
        ],
        names=["part", "floor", "item", "est", "err", "rows"],
    )


def _summarise(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        summary, floor, rows = {}, 0, 0
        for batch in batches:
            rows += batch.num_rows
            counts = pc.value_counts(batch.column(0))
            exact = {i: (c, 0) for i, c in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist())}
            # the batch is an exact summary with floor 0; merged, then cut to k counters
            summary, floor = merge_summary(summary, floor, exact, 0, k)
        if summary:
            yield _emit(TaskContext.get().partitionId(), summary, floor, rows)

    return run


def _merge(k: int):
    def run(tbl: pa.Table) -> pa.Table:
        by: dict[int, tuple[dict, int]] = {}
        rows = {}
        for r in zip(*(tbl.column(c).to_pylist() for c in ("part", "floor", "item", "est", "err", "rows"))):
            by.setdefault(r[0], ({}, r[1]))[0][r[2]] = (r[3], r[4])
            rows[r[0]] = r[5]
        summary, floor = {}, 0
        for part in sorted(by):
            summary, floor = merge_summary(summary, floor, *by[part], k)
        return pa.Table.from_batches([_emit(min(by) // FANIN, summary, floor, sum(rows.values()))])

    return run


def frequent_items(df: DataFrame, column: str, k: int = COUNTERS) -> DataFrame:
    """The candidates for the most frequent values of ``column``, with approximate and exact counts.

    Result: ``item`` (text; exact comparison, the empty string is a value),
    ``est`` (estimate, count <= est), ``err`` (est - err <= count), ``n`` (exact
    count), ``total`` (rows whose value is not NULL). Every value held by more
    than total / k rows is there; at most ``k`` rows. NULLs don't count. An
    empty table gives no rows. Memory per task is bounded by ``k`` counters and
    one batch, whatever the number of distinct values.
    """
    require_columns(df, [column])
    values = df.select(F.col(f"`{column}`").cast("string").alias("item")).where(F.col("item").isNotNull())
    level = stage(values.mapInArrow(_summarise(k), SUMMARY), "summaries")  # at most k rows a partition
    parts = 1 + (level.agg(F.max("part")).first()[0] or 0)
    while parts > 1:
        level = level.groupBy(F.floor(F.col("part") / FANIN).cast("int")).applyInArrow(_merge(k), SUMMARY)
        parts = -(-parts // FANIN)
    candidates = stage(level.select("item", "est", "err", "rows"), "frequent")
    # At most k candidates: bounded by the parameter, so the broadcast is too.
    total = candidates.agg(F.max("rows")).first()[0] or 0
    exact = values.join(F.broadcast(candidates.select("item")), "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return candidates.join(F.broadcast(exact), "item").select("item", "est", "err", "n", F.lit(total).cast("bigint").alias("total"))


def frequency_table(df: DataFrame, column: str, top: int, k: int = COUNTERS) -> DataFrame:
    """The ``top`` most frequent values (ties by value), exact counts, rank from 1: the report of a summary.

    Ranks are certain as long as the last reported count exceeds total / k,
    which ``certain`` says.
    """
    found = frequent_items(df, column, k)
    best = found.orderBy(F.desc("n"), "item").limit(top)
    return best.select("item", "n", "total", (F.col("n") * k > F.col("total")).alias("certain"))
