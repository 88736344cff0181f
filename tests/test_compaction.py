import datetime as dt

import pytest
from pyspark.sql import functions as F

from divrec.operators.compaction import compact_dataset, fingerprint, live_data_files, own_pairs, pack_files, plain_location, plan_compaction
from divrec.runtime import list_files

LIST = "listing_id bigint, conn_loc string, file_name string, size_bytes bigint, n_pairs int, first_pair bigint, removed boolean, listed_at timestamp"
T0 = dt.datetime(2020, 1, 1)


def listing(i, loc, name, size, n, first, removed=False, at=0):
    return (i, loc, name, size, n, first, removed, T0 + dt.timedelta(hours=at))


@pytest.mark.parametrize(
    ("text", "want"),
    [("/a/b/c", "/a/b/c"), ("hdfs://n:8020/a/b/c/", "/a/b/c"), ("file:///a//b/./c", "/a/b/c"), ("//a/b/././c//", "/a/b/c"), ("file:/a/b/c/.", "/a/b/c"), ("/", "/"), (None, None), ("/a/.b/c", "/a/.b/c")],
)
def test_plain_location(spark, text, want):
    df = spark.createDataFrame([(text,)], "loc string")
    assert df.select(plain_location(F.col("loc"))).first()[0] == want


def test_latest_listing_holds(spark):
    rows = [
        listing(1, "/a/b", "f1", 10, 5, 1), listing(2, "file:///a/b/", "f1", 20, 5, 1, at=2), listing(3, "/a//b", "f1", 30, 5, 1, at=1),
        listing(4, "/a/b", "f2", 10, 5, 6), listing(5, "/a/b", "f2", 10, 5, 6, removed=True, at=3),
        listing(6, "/a/b", "_meta/x", 10, 0, 1), listing(7, "/a/b", "d/.crc", 10, 0, 1), listing(8, None, "f9", 1, 1, 1), listing(9, "/a/b", None, 1, 1, 1),
        listing(10, "/a/b", "f3", None, 5, 11, removed=None), listing(11, "/a/b", "f4", 7, 1, 20, at=4), listing(12, "/a/b", "f4", 8, 1, 20, at=4), listing(12, "/a/b", "f4", 8, 1, 20, at=4),
    ]
    got = {r["file_name"]: r["size_bytes"] for r in live_data_files(spark.createDataFrame(rows, LIST)).collect()}
    assert got == {"f1": 20, "f3": None, "f4": 8}


def test_every_pair_once(spark):
    import random

    rnd = random.Random(3)
    rows = [listing(i, f"/l/{i % 3}", f"f{i}", rnd.choice([None, 0, 500, 5000]), rnd.choice([None, 0, 3, 10, 40]), rnd.choice([None, *range(1, 200)])) for i in range(300)]
    files = live_data_files(spark.createDataFrame(rows, LIST))
    owned = own_pairs(files).collect()
    held, read = {}, {}
    for r in owned:
        n = r["n_pairs"] or 0
        if r["first_pair"] is not None and n > 0:
            held.setdefault(r["loc"], set()).update(range(r["first_pair"], r["first_pair"] + n))
        for p in range(r["own_first"], r["own_first"] + r["own_pairs"]) if r["own_pairs"] else ():
            assert p not in read.setdefault(r["loc"], set())
            assert r["first_pair"] <= p < r["first_pair"] + n
            read[r["loc"]].add(p)
    assert held == read
    packed = pack_files(own_pairs(files), target_bytes=8000, open_cost=100).collect()
    assert len(packed) == sum(r["own_pairs"] > 0 for r in owned)
    size = {}
    for r in packed:
        size[(r["loc"], r["out_file"])] = size.get((r["loc"], r["out_file"]), 0) + (r["own_bytes"] or 0)
    assert max(size.values()) <= 8000 + 5000


def test_plan_edges(spark):
    conns = spark.createDataFrame([(1, "/a/b", 99), (2, "/none", 1), (3, None, 1)], "conn_id bigint, loc string, nfile bigint")
    rows = [listing(i, "/a/b", f"f{i}", None if i == 0 else 100, 2, 1 + 2 * i) for i in range(5)]
    got = {r["conn_id"]: r for r in plan_compaction(conns, spark.createDataFrame(rows, LIST).withColumn("loc", F.lit("clash"))).collect()}
    assert (got[1]["nfile"], got[1]["n_known"], got[1]["mean_size"], got[1]["n_pairs"], got[1]["copied_pairs"], got[1]["out_nfile"]) == (5, 4, 100.0, 10, 10, 1)
    assert (got[2]["nfile"], got[2]["mean_size"], got[2]["out_nfile"]) == (0, None, 0) and got[3]["nfile"] == 0
    empty = plan_compaction(conns, spark.createDataFrame([], LIST))
    assert empty.where("nfile = 0").count() == 3


def test_compact_dataset(spark, tmp_path):
    df = spark.range(5000).select("id", F.when(F.col("id") % 7 > 0, F.md5(F.col("id").cast("string"))).alias("t"), F.create_map(F.lit("a"), "id").alias("m"))
    df.repartition(40).write.parquet(f"{tmp_path}/src")
    done = compact_dataset(spark, f"{tmp_path}/src", f"{tmp_path}/dst", target_bytes=200_000)
    assert done["nfile"] == 40 and done["out_nfile"] <= 4 and done["rows"] == 5000
    assert fingerprint(spark.read.parquet(f"{tmp_path}/dst")) == fingerprint(df)
    assert len(list_files(spark, f"{tmp_path}/dst")) == done["out_nfile"]
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    with pytest.raises(FileExistsError):
        compact_dataset(spark, f"{tmp_path}/src", f"{tmp_path}/dst")
    df.limit(0).write.parquet(f"{tmp_path}/empty")
    assert compact_dataset(spark, f"{tmp_path}/empty", f"{tmp_path}/empty2")["rows"] == 0
    assert spark.read.parquet(f"{tmp_path}/empty2").columns == ["id", "t", "m"]


def test_repeated_rows_stay(spark, tmp_path):
    spark.createDataFrame([(1, None)] * 30, "a int, b string").repartition(6).write.parquet(f"{tmp_path}/s")
    assert compact_dataset(spark, f"{tmp_path}/s", f"{tmp_path}/d")["rows"] == 30


def test_folders_keep_their_layout(spark, tmp_path):
    """Bins and partitions, nested, with metadata; a folder with files of its own beside sub-folders."""
    from divrec.operators.division import KEY, divide
    from divrec.sources.connections import DiskConnection, convert, open_division

    div = divide(spark.range(900).select("id", (F.col("id") % 7).alias("g")).repartition(9), "g")
    convert(div, DiskConnection(f"{tmp_path}/src", n_bins=3))
    done = compact_dataset(spark, f"{tmp_path}/src", f"{tmp_path}/dst")
    assert done["rows"] == 900 and done["nfile"] > done["out_nfile"] == done["folders"] <= 3
    back = open_division(spark, f"{tmp_path}/dst")
    assert back.split_cols == ("g",) and DiskConnection(f"{tmp_path}/dst").read_key(spark, "g=3").count() == back.rows().where(F.col(KEY) == "g=3").count() > 0
    spark.range(60).select("id", (F.col("id") % 3).cast("string").alias("p"), F.lit("007").alias("q")).repartition(20).write.partitionBy("p", "q").parquet(f"{tmp_path}/part")
    done = compact_dataset(spark, f"{tmp_path}/part", f"{tmp_path}/whole")
    assert (done["nfile"] > 3, done["out_nfile"], done["rows"]) == (True, 3, 60) and (tmp_path / "whole" / "p=2" / "q=007").is_dir()
    assert compact_dataset(spark, f"{tmp_path}/part", f"{tmp_path}/whole", overwrite=True)["out_nfile"] == 3
    spark.range(5).write.parquet(f"{tmp_path}/mixed/sub")
    spark.range(8).repartition(4).write.mode("append").parquet(f"{tmp_path}/mixed")
    done = compact_dataset(spark, f"{tmp_path}/mixed", f"{tmp_path}/mixed2")
    assert done["rows"] == 13 and (tmp_path / "mixed2" / "sub").is_dir()


def test_files_of_unknown_range_are_kept_whole(spark):
    conns = spark.createDataFrame([(1, "/a")], "conn_id bigint, loc string")
    rows = [listing(1, "/a", "f1", 100, 5, 1), listing(2, "/a", "f2", 70, None, 1), listing(3, "/a", "f3", 30, 5, None), listing(4, "/a", "f4", 9, 2, 2), listing(5, "/a", "f5", 9, 0, 9)]
    r = plan_compaction(conns, spark.createDataFrame(rows, LIST)).first()
    assert (r["nfile"], r["totstoragesize"], r["n_pairs"], r["copied_pairs"], r["out_nfile"], r["out_totstoragesize"]) == (5, 218, 5, 5, 1, 200)
