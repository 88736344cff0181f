"""Ordered scans over groups of any size, without giving a whole group to one task.

A window function puts all rows of a group into one task. Here the rows are
sorted across the cluster (range partitioning on group and order), each sorted
partition is scanned once, and only one carry per partition, so at most as many
values as there are partitions, travels between partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divrec.runtime import require_columns, stage

_NONE = int(np.iinfo(np.int64).min)  # no value yet
PID, ORD, GRP = "_scan_pid", "_scan_ord", "_scan_grp"


def _changed(col: pa.Array) -> np.ndarray:
    """For each row but the first, whether it differs from the row before; NULL equals NULL, NaN equals NaN."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    diff = pc.fill_null(pc.not_equal(a, b), False)
    diff = pc.or_(diff, pc.xor(a.is_null(), b.is_null()))
    if pa.types.is_floating(col.type):
        both = pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)
        diff = pc.and_not(diff, both)
    return diff.to_numpy(zero_copy_only=False).astype(bool)


def _scanner(groups: list[str], sums: dict[str, str], maxes: dict[str, str]):
    """A function for mapInArrow: running sums and maxima within the groups of one sorted partition."""

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        before, carry, ordinal, grp = None, {}, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, dtype=bool)
            for g in groups:
                col = batch.column(batch.schema.get_field_index(g))
                if before is not None:
                    head = pa.concat_arrays([before[g], col.slice(0, 1)])
                    starts[0] |= _changed(head)[0]
                if n > 1:
                    starts[1:] |= _changed(col)
            if starts[0]:
                carry = {}
            # begin: where each run of one group starts in this batch; first: those that start a new group
            seg = np.cumsum(starts)
            first = np.flatnonzero(starts)
            begin = np.concatenate(([0], first)) if not starts[0] else first
            which = seg if not starts[0] else seg - 1
            out = {}
            for name, src in sums.items():
                v = batch.column(batch.schema.get_field_index(src))
                v = pc.fill_null(v.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                total = np.cumsum(v)
                base = np.where(begin > 0, total[begin - 1], 0)
                base[0] -= carry.get(name, 0) if begin[0] == 0 else 0
                out[name] = total - base[which]
                carry[name] = int(out[name][-1])
            for name, src in maxes.items():
                v = batch.column(batch.schema.get_field_index(src))
                v = pc.fill_null(v.cast(pa.int64()), _NONE).to_numpy(zero_copy_only=False).copy()
                if begin[0] == 0 and name in carry:
                    v[0] = max(v[0], carry[name])
                # one running maximum over all segments: each segment works on its own slice
                res = np.empty_like(v)
                ends = np.concatenate((begin[1:], [n]))
                for s, e in zip(begin, ends):
                    np.maximum.accumulate(v[s:e], out=res[s:e])
                earlier = np.concatenate(([carry[name] if begin[0] == 0 and name in carry else _NONE], res[:-1]))
                earlier[first] = _NONE
                out[name], out[f"{name}_before"] = res, earlier
                carry[name] = int(res[-1])
            before = {g: batch.column(batch.schema.get_field_index(g)).slice(n - 1, 1) for g in groups}
            columns = list(batch.columns) + [
                pa.array(np.full(n, pid, dtype=np.int32)),
                pa.array(np.arange(ordinal, ordinal + n, dtype=np.int64)),
                pa.array((grp + seg).astype(np.int64)),
            ]
            names = list(batch.schema.names) + [PID, ORD, GRP]
            for name in (*sums, *maxes, *(f"{m}_before" for m in maxes)):
                columns.append(pa.array(out[name]))
                names.append(name)
            ordinal += n
            grp += int(seg[-1])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def ordered_scan(
    df: DataFrame,
    groups: list[str],
    order: list[str],
    *,
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    count: str | None = None,
) -> DataFrame:
    """Running aggregates per group in the given order, each row included.

    ``sums`` and ``maxes`` map result columns to integer source columns (NULL
    counts as 0, or is passed over); of a maximum m there is also ``m_before``,
    over the earlier rows alone; ``count`` names a running row number from
    1. A running maximum before any value is NULL. ``order`` should be (nearly)
    unique within the group, so that even a group holding a third of all rows
    is spread over many partitions. NULL is a group of its own. An empty input
    gives an empty result. Rows with equal order values are kept, in no fixed
    order among themselves.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    require_columns(df, [*groups, *order, *sums.values(), *maxes.values()])
    spark = df.sparkSession
    # Inside, columns go by place: their own names may hold dots or be those used here.
    given = list(df.columns)
    cols = [f"c{i}" for i in range(len(given))]
    inner = dict(zip(given, cols))
    df = df.toDF(*cols)
    groups, order = [inner[g] for g in groups], [inner[o] for o in order]
    sums, maxes = {n: inner[c] for n, c in sums.items()}, {n: inner[c] for n, c in maxes.items()}
    if count:
        df = df.withColumn("_scan_one", F.lit(1).cast("bigint"))
        sums[count] = "_scan_one"
    keys = [F.col(f"`{c}`") for c in dict.fromkeys([*groups, *order])]
    # The number of ranges is left to the engine, which merges neighbouring small ones.
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType(
        [*df.schema.fields, T.StructField(PID, T.IntegerType()), T.StructField(ORD, T.LongType()), T.StructField(GRP, T.LongType())]
        + [T.StructField(n, T.LongType()) for n in (*sums, *maxes, *(f"{m}_before" for m in maxes))]
    )
    local = stage(ranged.mapInArrow(_scanner(groups, sums, maxes), schema), "scan")

    running = [*sums, *maxes]
    at = F.struct(*[F.col(f"`{g}`") for g in groups]) if groups else F.struct(F.lit(1))
    last = F.struct(*[F.col(f"`{r}`") for r in running])
    # One row per partition: its first and last group, and the running values at the end of each of the two.
    edges = sorted(
        local.groupBy(PID)
        .agg(
            F.max(GRP).alias("top"),
            F.min_by(at, ORD).alias("first"),
            F.max_by(at, ORD).alias("last"),
            F.max_by(last, ORD).alias("tail"),
        )
        .collect(),
        key=lambda r: r[PID],
    )
    carries, prev = [], None
    for r in edges:
        inside: dict = {}
        if prev is not None and repr(prev[0]) == repr(r["first"]):
            inside = prev[1]
            carries.append((r[PID], *[inside[n] for n in running]))
        end = {n: r["tail"][n] for n in running}
        if r["top"] == 0 and inside:  # the whole partition is one group that goes on from before
            for n in sums:
                end[n] += inside[n]
            for n in maxes:
                end[n] = max(end[n], inside[n])
        prev = (r["last"], end)
    if carries:
        fields = [T.StructField("_carry_pid", T.IntegerType())] + [T.StructField(f"_carry_{n}", T.LongType()) for n in running]
        carry = F.broadcast(spark.createDataFrame(carries, T.StructType(fields)))  # at most one row a partition
        local = local.join(carry, (F.col(PID) == F.col("_carry_pid")) & (F.col(GRP) == 0), "left")
        for n in sums:
            local = local.withColumn(n, F.col(f"`{n}`") + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)))
        for n in maxes:
            for m in (n, f"{n}_before"):
                local = local.withColumn(m, F.greatest(F.col(f"`{m}`"), F.col(f"_carry_{n}")))
    fix = [F.when(F.col(f"`{m}`") > F.lit(_NONE), F.col(f"`{m}`")).alias(m) for n in maxes for m in (n, f"{n}_before")]
    return local.select(*[F.col(c).alias(g) for g, c in inner.items()], *[F.col(f"`{n}`") for n in sums], *fix)


def row_numbers(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the row number (from 1) within each group, by a distributed sort."""
    return ordered_scan(df, groups, order, count=name)
