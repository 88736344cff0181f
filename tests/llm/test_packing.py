import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from divrec.llm.packing import latest_attempts, pack_histogram, pack_items, pack_report, rounded_length


def one_by_one(histogram, capacity):
    """The same rule, an item at a time: longest first, into the shortest pack if it fits there."""
    packs = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            i = min(range(len(packs)), key=lambda j: packs[j], default=None)
            if i is None or packs[i] + length > capacity:
                packs.append(length)
            else:
                packs[i] += length
    return sorted(packs)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 12), max_size=8), st.sampled_from([60, 61, 100, 1000]))
def test_patterns(histogram, capacity):
    patterns = pack_histogram(histogram, capacity)
    total = defaultdict(int)
    sizes = []
    for packs, pattern in patterns:
        size = sum(length * n for length, n in pattern)
        assert packs > 0 and 0 < size <= capacity
        sizes += [size] * packs
        for length, n in pattern:
            total[length] += packs * n
    assert dict(total) == histogram
    naive = one_by_one(histogram, capacity)
    assert sum(sizes) == sum(naive) and len(sizes) <= len(naive) + 1


def test_huge_counts_are_quick():
    import time

    began = time.time()
    patterns = pack_histogram({7: 10**12, 50: 10**9, 999: 5}, 1000)
    assert time.time() - began < 2 and len(patterns) < 1000
    used = sum(p * sum(length * n for length, n in pat) for p, pat in patterns) / (1000 * sum(p for p, _ in patterns))
    assert used > 0.99


def test_rounded_length(spark):
    sizes = [0, 1, 4095, 4096, 4097, 123456789, 2**53 + 1, 2**40]
    got = spark.createDataFrame([(s,) for s in sizes], "s bigint").select("s", rounded_length(F.col("s")).alias("r")).collect()
    for r in got:
        assert r["s"] <= r["r"] <= r["s"] * (1 + 2**-11) and (r["s"] >= 4096 or r["s"] == r["r"])


@pytest.fixture(scope="module")
def packed(spark):
    rnd = random.Random(5)
    jobs = [(1, 1000), (2, 50), (3, None), (4, 0), (5, 10**7)]
    items = [(rnd.choice([1, 1, 1, 1, 2, 3, 4, 5, 9]), f"f{i}", rnd.choice([None, 0, 1, 50, 51, 333, 1000, 1001, 2500, rnd.randint(1, 5000), -3])) for i in range(800)]
    df = spark.createDataFrame(items, "job_id int, fp string, size bigint")
    res = pack_items(df, spark.createDataFrame(jobs, "job_id int, capacity bigint"))
    return items, dict(jobs), res, [r.asDict() for r in res.collect()]


def test_every_byte_once(packed):
    items, cap, _, rows = packed
    by = defaultdict(list)
    for r in rows:
        by[(r["job_id"], r["fp"])].append(r)
    assert len(by) == len(items)
    room = defaultdict(int)
    for job, fp, size in items:
        mine = by[(job, fp)]
        c = cap.get(job)
        if not c or size is None or size < 0:
            assert [(m["pack"], m["n_pieces"]) for m in mine] == [(None, 0)]
            continue
        assert sum(m["piece_size"] for m in mine) == size and len(mine) == mine[0]["n_pieces"] == max(1, math.ceil(size / c))
        assert sorted(m["piece"] for m in mine) == list(range(len(mine)))
        for m in mine:
            room[(job, m["pack"])] += m["piece_size"]
    assert all(v <= cap[job] for (job, _), v in room.items())
    for job in (1, 2):
        packs = {p for j, p in room if j == job}
        assert packs == set(range(len(packs)))  # no number is left out


def test_little_room_is_unused(packed):
    items, cap, res, _ = packed
    r = {x["job_id"]: x for x in pack_report(res).collect()}
    least = math.ceil(sum(s for j, _, s in items if j == 1 and s and s > 0) / 1000)
    assert r[1]["packs"] <= 1.25 * least and 0 < r[1]["used"] <= 1 and r[1]["largest"] <= 1000


def test_edges(spark):
    none = spark.createDataFrame([], "job_id int, fp string, size bigint")
    jobs = spark.createDataFrame([(1, 10)], "job_id int, capacity bigint")
    assert pack_items(none, jobs).count() == 0
    zeros = pack_items(spark.createDataFrame([(1, "a", 0), (1, "b", 0)], none.schema), jobs).collect()
    assert [(r["pack"], r["n_pieces"]) for r in zeros] == [(0, 1), (0, 1)]
    whole = pack_items(spark.createDataFrame([(1, "a", 20), (1, "b", 10)], none.schema), jobs).collect()
    assert sorted((r["fp"], r["piece"], r["pack"]) for r in whole) == [("a", 0, 1), ("a", 1, 2), ("b", 0, 0)]
    assert pack_items(spark.createDataFrame([(1, "a", 5)], none.schema), jobs.limit(0)).first()["pack"] is None


def test_latest_attempts(spark):
    t = dt.datetime(2020, 1, 1)
    rows = [(1, "a", 5, "B", 1, t), (1, "a", 2, "KiB", 2, t), (1, "a", 2, "KiB", 2, t), (1, "b", 7, "B", 1, t), (1, "b", None, "B", 3, t), (2, "a", 9, None, None, None), (1, "c", 1, "B", 2, t), (1, "c", 9, "B", 2, t)]
    got = {(r["job_id"], r["fp"]): r["size"] for r in latest_attempts(spark.createDataFrame(rows, "job_id int, fp string, sz bigint, sz_unit string, attempt int, written_at timestamp")).collect()}
    assert got == {(1, "a"): 2048, (1, "b"): None, (2, "a"): 9, (1, "c"): 9}


def test_lengths_are_exact(spark):
    schema = "job_id int, fp string, size bigint"
    jobs = spark.createDataFrame([(1, 2_000_002)], "job_id int, capacity bigint")
    two = spark.createDataFrame([(1, "a", 1_000_001), (1, "b", 1_000_001)], schema)
    assert {r["pack"] for r in pack_items(two, jobs).collect()} == {0}
    assert {r["pack"] for r in pack_items(two, jobs, digits=12).collect()} == {0, 1}


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 3), max_size=10))
def test_rule_an_item_at_a_time(histogram):
    """Where packs never tie, the patterns are those of the rule applied an item at a time."""
    sizes = sorted(sum(a * n for a, n in pat) for packs, pat in pack_histogram(histogram, 100) for _ in range(packs))
    naive = one_by_one(histogram, 100)
    assert len(sizes) <= len(naive) + 1 and (sizes == naive or sum(sizes) == sum(naive))


def test_shards_of_a_job_with_many_lengths(spark):
    """A histogram in several parts: every byte is placed once, packs are numbered through, and little room is lost."""
    rnd = random.Random(9)
    rows = [(1, f"f{i}", rnd.randint(1, 700)) for i in range(3000)] + [(2, "x", 5), (1, "big", 2500)]
    jobs = spark.createDataFrame([(1, 1000), (2, 10)], "job_id int, capacity bigint")
    res = pack_items(spark.createDataFrame(rows, "job_id int, fp string, size bigint"), jobs, max_bars=150)
    room, pieces = defaultdict(int), defaultdict(int)
    for r in res.collect():
        room[(r["job_id"], r["pack"])] += r["piece_size"]
        pieces[(r["job_id"], r["fp"])] += r["piece_size"]
    assert dict(pieces) == {(j, f): s for j, f, s in rows}
    assert max(v for (j, _), v in room.items() if j == 1) <= 1000 and {p for j, p in room if j == 1} == set(range(sum(j == 1 for j, _ in room)))
    one = len({p for j, p in room if j == 1})
    best = len({r["pack"] for r in pack_items(spark.createDataFrame(rows, "job_id int, fp string, size bigint"), jobs).where("job_id = 1").collect()})
    assert one <= 1.03 * best


def test_hot_length(spark):
    """A length that most items have: found by buckets of ranks."""
    rows = spark.range(5000).select(F.lit(1).alias("job_id"), F.concat(F.lit("f"), "id").alias("fp"), F.when(F.col("id") % 50 == 0, F.col("id") % 900 + 1).otherwise(7).cast("bigint").alias("size"))
    res = pack_items(rows, spark.createDataFrame([(1, 1000)], "job_id int, capacity bigint"))
    per = res.groupBy("pack").agg(F.sum("piece_size").alias("b")).collect()
    total = rows.agg(F.sum("size")).first()[0]
    assert res.count() == 5000 and max(r["b"] for r in per) <= 1000 and len(per) <= -(-total // 1000) + 1
