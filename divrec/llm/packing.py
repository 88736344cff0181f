"""Filling containers of fixed capacity with items of varying length.

Shortest-pack-first over the length histogram: only how many items have which
length is looked at, longest first; the pack with most room takes the next
item, whole groups of equal packs at a time. The result is a table of packing
patterns with counts; items find their container by their rank among the items
of equal length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from divrec.operators.scan import ordered_scan
from divrec.runtime import broadcast_if_small, partitions, require_columns, stage

#: Binary digits that ``rounded_length`` keeps.
DIGITS = 12
#: Bars of a histogram in one task. A job with more lengths is packed as several, each with its share of the lengths, so
#: lengths stay exact; with so many bars in each, that leaves hardly more room unused.
MAX_BARS = 100_000
#: Ranks that one row of a pattern stands for at most, and ranks that are looked up together.
RUN, BUCKET = 1 << 20, 64


def rounded_length(size: Column, digits: int = DIGITS) -> Column:
    """A length rounded up to ``digits`` leading binary digits: exact below 2**digits, at most 2**(1 - digits) too long above.

    A histogram of such lengths has at most about 2**(digits - 1) * (64 - digits) bars.
    """
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - F.lit(digits), F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("bigint")
    return (F.ceil(size.cast("decimal(20,0)") / step) * step).cast("bigint")


def _pack(histogram: dict[int, int], capacity: int) -> Iterator[tuple[int, tuple | None]]:
    """Packs of equal content as ``(packs, chain)``; a chain is (length, items of it in each pack, chain before it) or None."""
    heap: list[tuple] = []  # (-room, turn, packs, chain): the shortest pack first, of equal ones the latest
    turn = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            best = -heap[0][0] if heap else -1
            turn -= 1
            if best < length:  # no pack has room: each new one takes as many as fit, and the rest is shared out among them in turn
                fit = capacity // length
                packs = max(1, left // fit)
                each = min(fit, left)
                left -= packs * each
                if capacity - each * length:
                    heapq.heappush(heap, (each * length - capacity, turn, packs, (length, each, None)))
                else:
                    yield packs, (length, each, None)
                continue
            _, _, packs, chain = heap[0]
            if left < packs:  # some of the equal packs take one each
                heapq.heapreplace(heap, (-best, turn, packs - left, chain))
                packs, each, left = left, 1, 0
                swap = False
            else:  # items a pack can take until it is no longer the shortest
                second = -min(heap[1][0], heap[2][0]) if len(heap) > 2 else -heap[1][0] if len(heap) > 1 else 0
                each = max(1, min(best // length, left // packs, -(-(best - second) // length)))
                left -= packs * each
                swap = True
            chain = (length, chain[1] + each, chain[2]) if chain[0] == length else (length, each, chain)
            room = best - each * length
            if not room:
                if swap:
                    heapq.heappop(heap)
                yield packs, chain
            elif swap:
                heapq.heapreplace(heap, (-room, turn, packs, chain))
            else:
                heapq.heappush(heap, (-room, turn, packs, chain))
    for _, _, packs, chain in heap:
        yield packs, chain


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns ``(packs, ((length, items), ...))`` for a histogram length -> items.

    Lengths must lie in 1..capacity. Longest first; always the shortest pack
    (most room) takes the item, and a new pack begins if it doesn't fit there.
    Packs of equal content move together: as many items at a time as keep a
    pack the shortest one, so the work depends on the histogram and the
    patterns, not on the number of items.
    """
    out = []
    for packs, chain in _pack(histogram, capacity):
        pattern = []
        while chain:
            pattern.append(chain[:2])
            chain = chain[2]
        out.append((packs, tuple(reversed(pattern))))
    return out


_SLOTS = ("length", "first", "take", "pack", "each", "packs")


def _pack_group(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """One job (or one shard of it): its histogram to runs of ranks of a length and the packs that hold them, as ``_SLOTS``.

    Rank r (from 0) of a run lies in pack ``pack + (r - first) // each``. One
    row more, without length, has the number of ``packs``.
    """
    used = dict.fromkeys(histogram, 0)
    rows: list[tuple[int, ...]] = []
    add, pack = rows.append, 0
    for packs, chain in _pack(histogram, capacity):
        while chain:
            length, each, chain = chain
            first, take = used[length], packs * each
            used[length] = first + take
            if take <= RUN:
                add((length, first, take, pack, each, 0))
            else:  # in pieces of whole packs
                step = max(1, RUN // each)
                for p in range(0, packs, step):
                    n = min(step, packs - p)
                    add((length, first + p * each, n * each, pack + p, each, 0))
        pack += packs
    add((-1, 0, 0, 0, 1, pack))
    return rows


def _pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bars sorted by job and shard (``job, shard, length, items, capacity``) to slots; one histogram is held at a time."""
    now, histogram, capacity, kind = None, {}, 0, None
    jobs: list = []
    rows: list[tuple[int, ...]] = []

    def flush() -> pa.RecordBatch:
        cols = np.array(rows, dtype=np.int64).reshape(len(rows), len(_SLOTS) + 1)
        out = pa.RecordBatch.from_arrays([pa.array(jobs, kind), *[pa.array(cols[:, i]) for i in range(len(_SLOTS) + 1)]], names=["job", "shard", *_SLOTS])
        jobs.clear()
        rows.clear()
        return out

    def close() -> None:
        packed = _pack_group(histogram, capacity)
        jobs.extend([now[0]] * len(packed))
        rows.extend((now[1], *r) for r in packed)

    for batch in batches:
        kind = batch.schema.field(0).type
        for job, shard, length, items, cap in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (job, shard):
                if now is not None:
                    close()
                    if len(rows) >= 100_000:
                        yield flush()
                now, histogram, capacity = (job, shard), {}, cap
            histogram[length] = items
    if now is not None:
        close()
        yield flush()


def pack_items(
    items: DataFrame, jobs: DataFrame, *, job: str = "job_id", item: str = "fp", size: str = "size", capacity: str = "capacity", digits: int | None = None, max_bars: int = MAX_BARS
) -> DataFrame:
    """Put every item into a container of its job.

    ``items``: one row per piece to place, job, item (unique within the job)
    and size; ``jobs``: job and capacity. Result: ``job_id, fp, piece`` (0, or
    0.. of a split item), ``n_pieces, piece_size, pack`` (from 0 per job; NULL
    if it can't be placed), ``capacity``. An item larger than the capacity is
    split into full containers and a rest that is packed like an item; no other
    is split. Zero sizes need no room and lie in pack 0. NULL or negative
    sizes, and items of a job without positive capacity, have pack NULL and
    n_pieces 0. Rows of one item that are repeated must have been resolved
    (``latest_attempts``). Ties of length go by item name. An empty table gives
    no rows. Lengths are exact; ``digits`` rounds them up to so many binary
    digits, for smaller histograms. No job, length or item is a hot task: ranks
    come from a distributed sort, and a task sees at most ``max_bars`` bars of a
    job's histogram.
    """
    require_columns(items, [job, item, size])
    require_columns(jobs, [job, capacity])
    caps = jobs.where(F.col(capacity) > 0).groupBy(F.col(job).alias("_cj")).agg(F.max(F.col(capacity).cast("bigint")).alias("capacity"))
    rows = items.select(F.col(job).alias("job_id"), F.col(item).alias("fp"), F.col(size).cast("bigint").alias("size"))
    rows = rows.join(caps, F.col("job_id") == F.col("_cj"), "left").drop("_cj")
    usable = F.coalesce(F.col("size").isNotNull() & (F.col("size") >= 0) & F.col("capacity").isNotNull(), F.lit(False))
    full = F.when(usable & (F.col("size") > F.col("capacity")), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("bigint")
    rest = F.when(F.col("_full") > 0, F.col("size") - F.col("_full") * F.col("capacity")).otherwise(F.col("size"))
    pieces = F.col("_full") + (F.col("rest") > 0).cast("bigint") + ((F.col("_full") == 0) & (F.col("rest") == 0)).cast("bigint")
    length = F.least(rounded_length(F.col("rest"), digits), F.col("capacity")) if digits else F.col("rest")
    rows = stage(
        rows.withColumn("usable", usable)
        .withColumn("_full", full)
        .withColumn("rest", rest)
        .withColumn("n_pieces", F.when(F.col("usable"), pieces).otherwise(0).cast("bigint"))
        .withColumn("length", F.when(F.col("usable") & (F.col("rest") > 0), length)),
        "sizes",
    )

    small = rows.where(F.col("length").isNotNull())
    ranked = ordered_scan(small.select("job_id", "fp", "_full", "n_pieces", "rest", "capacity", "length"), ["job_id", "length"], ["fp"], count="_rank")
    histogram = small.groupBy(F.col("job_id").alias("job"), "length").agg(F.count(F.lit(1)).alias("items"), F.max("capacity").alias("capacity"))
    shards = histogram.groupBy(F.col("job").alias("_hj")).agg(F.ceil(F.count(F.lit(1)) / F.lit(max_bars)).alias("_shards"))
    bars = histogram.join(broadcast_if_small(shards), F.col("job").eqNullSafe(F.col("_hj"))).select("job", F.pmod(F.xxhash64("length"), F.col("_shards")).alias("shard"), "length", "items", "capacity")
    kind = rows.schema["job_id"].dataType.simpleString()
    # an explicit number of partitions, which small bytes don't merge: packing costs time, not bytes
    sorted_bars = bars.repartition(partitions(rows.sparkSession), "job", "shard").sortWithinPartitions("job", "shard")
    slots = stage(sorted_bars.mapInArrow(_pack_groups, f"job {kind}, shard bigint, " + ", ".join(f"{c} bigint" for c in _SLOTS)), "slots")
    # Where the packs of each shard begin: a running sum over one row a shard, where a job has several.
    heads = slots.where("length < 0").select("job", "shard", "packs")
    if slots.where("shard > 0").limit(1).count():
        upto = ordered_scan(heads, ["job"], ["shard"], sums={"_upto": "packs"})
    else:
        upto = heads.withColumn("_upto", F.col("packs"))
    base = upto.select(F.col("job").alias("_bj"), F.col("shard").alias("_bs"), (F.col("_upto") - F.col("packs")).alias("_base"), "_upto")
    slots = slots.where("length >= 0").join(broadcast_if_small(base.drop("_upto")), (F.col("job") == F.col("_bj")) & (F.col("shard") == F.col("_bs")))
    # Patterns meet items by rank: both sides are cut into buckets of ranks, so no length is a hot key, and a bucket holds few rows of either.
    slots = slots.select("job", F.col("length").alias("_sl"), "first", "take", "each", (F.col("pack") + F.col("_base")).alias("pack"), F.explode(F.sequence(F.floor(F.col("first") / BUCKET), F.floor((F.col("first") + F.col("take") - 1) / BUCKET))).alias("_sb"))
    at = F.col("_rank") - 1
    joined = ranked.join(slots, (F.col("job_id") == F.col("job")) & (F.col("length") == F.col("_sl")) & (F.floor(at / BUCKET) == F.col("_sb")) & (at >= F.col("first")) & (at < F.col("first") + F.col("take")))
    held = joined.select("job_id", "fp", F.col("_full").alias("piece"), "n_pieces", F.col("rest").alias("piece_size"), (F.col("pack") + F.floor((at - F.col("first")) / F.col("each"))).cast("bigint").alias("pack"), "capacity")

    # Full containers of split items come after the packed ones: numbered by a distributed running sum.
    split = ordered_scan(rows.where(F.col("_full") > 0).select("job_id", "fp", "_full", "capacity", "n_pieces"), ["job_id"], ["fp"], sums={"_upto": "_full"})
    packed = base.groupBy("_bj").agg(F.max("_upto").alias("_packs"))
    split = split.join(broadcast_if_small(packed), F.col("job_id") == F.col("_bj"), "left").withColumn("_base", F.coalesce("_packs", F.lit(0)) + F.col("_upto") - F.col("_full"))
    whole = split.select("job_id", "fp", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_full") - 1)).alias("piece"), "n_pieces", F.col("capacity").alias("piece_size"), "_base", "capacity")
    whole = whole.select("job_id", "fp", "piece", "n_pieces", "piece_size", (F.col("_base") + F.col("piece")).cast("bigint").alias("pack"), "capacity")
    # What needs no room, or has no place.
    others = rows.where(F.col("length").isNull() & (F.col("_full") == 0))
    others = others.select("job_id", "fp", F.col("_full").alias("piece"), "n_pieces", F.col("rest").alias("piece_size"), F.when(F.col("usable"), F.lit(0)).cast("bigint").alias("pack"), "capacity")
    return held.unionByName(others).unionByName(whole)


def latest_attempts(files: DataFrame) -> DataFrame:
    """One row per (job_id, fp) with its ``size`` in bytes by the highest ``attempt``.

    ``sz_unit`` ``KiB`` counts 1024 bytes; another or missing unit is bytes. Of
    several rows of the highest attempt the latest ``written_at`` holds, of
    those the largest size. A size that attempt does not know is NULL.
    """
    require_columns(files, ["job_id", "fp", "sz", "sz_unit", "attempt", "written_at"])
    size = F.col("sz").cast("bigint") * F.when(F.col("sz_unit") == "KiB", 1024).otherwise(1)
    return files.groupBy("job_id", "fp").agg(F.max_by(F.struct(size.alias("s")), F.struct("attempt", "written_at", size))["s"].alias("size"))


def pack_report(packed: DataFrame) -> DataFrame:
    """Per job: items, containers, bytes, capacity and the share of room that is used."""
    per = packed.where(F.col("pack").isNotNull()).groupBy("job_id", "pack").agg(F.sum("piece_size").alias("b"), F.max("capacity").alias("capacity"), F.count(F.lit(1)).alias("p"))
    return per.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("packs"), F.sum("p").alias("pieces"), F.sum("b").alias("bytes"), F.max("b").alias("largest"), F.max("capacity").alias("capacity"),
        (F.sum("b") / F.sum("capacity")).alias("used"),
    )
