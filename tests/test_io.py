"""Connections, conversion, text reading, map/reduce."""

import pytest
from pyspark.sql import functions as F

from divrec.operators.agnostic import update_attributes
from divrec.operators.division import KEY, divide
from divrec.operators.mapreduce import Reduce, counters, mr_exec, source_names
from divrec.runtime import path_exists
from divrec.sources.connections import DiskConnection, add_data, char_to_output, convert, hdfs_conn, local_disk_conn, open_division, remove_data
from divrec.sources.text import read_csv, read_csv2, read_table, read_text_chunks


@pytest.fixture(scope="module")
def div(spark):
    return divide(spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)], "v int, g string"), "g")


def test_overwrite_policy(spark, div, tmp_path):
    c = local_disk_conn(f"{tmp_path}/d")
    c.write(div.rows())
    with pytest.raises(FileExistsError, match="backing out"):
        c.write(div.rows())
    c.write(div.rows().limit(1), overwrite="backup")
    assert path_exists(spark, f"{tmp_path}/d_bak") and c.read(spark).count() == 1
    c.write(div.rows(), overwrite=True)
    assert c.read(spark).count() == 30


def test_convert_and_move(spark, div, tmp_path):
    kept = convert(update_attributes(div), f"{tmp_path}/a")
    (tmp_path / "a").rename(tmp_path / "b")  # no path is stored
    back = open_division(spark, f"{tmp_path}/b")
    assert back.nrow() == 30 and back.split_cols == ("g",) and back.get_attribute("splitRowDistn") == kept.attrs["splitRowDistn"]
    assert back.rows().count() == 30 and convert(back, None).rows().count() == 30


def test_bins_and_keys(spark, div, tmp_path):
    c = DiskConnection(f"{tmp_path}/bins", n_bins=3)
    c.write(div.rows())
    assert c.read_key(spark, "g=b").count() == 10 and "_bin" not in c.read(spark).columns
    plan = c.read_key(spark, "g=b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bin" in plan
    assert add_data(spark, c, div.rows().where("g = 'b'")) == 0
    more = div.rows().where("g = 'b'").withColumn(KEY, F.lit("g=new"))
    assert add_data(spark, c, more) == 10 and c.read(spark).count() == 40
    assert add_data(spark, c, more.limit(4), overwrite=True) == 4 and c.read(spark).count() == 34
    assert remove_data(spark, c, ["g=a", "g=none"]) == 1 and c.read(spark).count() == 24
    assert char_to_output("x").loc == "x" and hdfs_conn("/a").loc == "hdfs:///a"


def test_read_csv_types_blocks_and_missing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(3):
        lines = [f'{i},{i / 2},"t,{i}",{"NA" if i % 4 else "x"}' for i in range(f * 10, f * 10 + 10)]
        (tmp_path / "in" / f"p{f}.csv").write_text("\n".join(["id,half.d,text,c", *lines, ""]) + "\n")
    d = read_csv(spark, f"{tmp_path}/in", rows_per_block=7)
    assert dict(d.rows().dtypes) == {"id": "int", "half.d": "double", "text": "string", "c": "string", KEY: "bigint"}
    assert [(r[KEY], r["n"], r["lo"], r["hi"]) for r in d.rows().groupBy(KEY).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy(KEY).collect()] == [
        (1, 7, 0, 6), (2, 7, 7, 13), (3, 7, 14, 20), (4, 7, 21, 27), (5, 2, 28, 29),
    ]
    assert d.rows().where("text = 't,3' and c is null").count() == 1
    assert d.rows().where("c is not null").count() == 8


def test_read_table_options(spark, tmp_path):
    f = tmp_path / "t.txt"
    f.write_text('# note\nskip me\n1,5;a;x\n2,5;"b;c";y # tail\n\nNA;;z\n')
    d = read_table(spark, str(f), sep=";", dec=",", skip=2, comment="#", columns=["n", "t", "u"]).rows().orderBy("u").collect()
    assert [(r["n"], r["t"]) for r in d] == [(1.5, "a"), (2.5, "b;c"), (None, "")]
    g = tmp_path / "w.txt"
    g.write_text("  1  'two words'\t3\n4 five 6 \n")
    got = read_table(spark, str(g), quote="'").rows().collect()
    assert sorted((r["V1"], r["V2"], r["V3"]) for r in got) == [(1, "two words", 3), (4, "five", 6)]
    h = tmp_path / "bad.csv"
    h.write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="not 2 fields"):
        read_csv(spark, str(h)).rows().collect()
    short = tmp_path / "short.csv"
    short.write_text("a;b\n1,5;2\n1,5\n")
    assert read_csv2(spark, str(short)).rows().where("b is null").count() == 1


def test_text_chunks(spark, tmp_path):
    f = tmp_path / "log.txt"
    f.write_text("".join(f"line {i}{' END' if i % 5 == 4 else ''}\n" for i in range(23)))
    d = read_text_chunks(spark, str(f), lambda lines: {"n": len(lines), "first": lines[0]}, "n int, first string", lines_per_block=10)
    assert sorted((r[KEY], r["n"], r["first"]) for r in d.rows().collect()) == [("1", 10, "line 0"), ("2", 10, "line 10"), ("3", 3, "line 20")]
    whole = read_text_chunks(spark, str(f), lambda lines: {"n": len(lines), "first": lines[0]}, "n int, first string", lines_per_block=7, record_end="END$")
    assert sorted((r["n"], r["first"]) for r in whole.rows().collect()) == [(3, "line 20"), (5, "line 0"), (5, "line 5"), (10, "line 10")]
    none = read_text_chunks(spark, str(f), lambda lines: None if "line 0" in lines[0] else len(lines), "value int", lines_per_block=10, key_fn=lambda t: t[:7])
    assert sorted((r[KEY], r["value"]) for r in none.rows().collect()) == [("line 10", 10), ("line 20", 3)]


def test_map_reduce_blocks_and_counters(spark, div):
    seen = Reduce(lambda st, k, vs: st + sum(vs), lambda st, k, collect: collect(k, float(st)), lambda k: 0)

    def m(keys, values, collect, counter, source):
        for k, v in zip(keys, values):
            counter("pairs", source)
            for x in v["v"]:
                collect("even" if x % 2 == 0 else "odd", int(x))

    res = mr_exec({"one": div, "two": div}, m, seen)
    assert {r[KEY]: r["value"] for r in res.rows().collect()} == {"even": 2.0 * sum(range(0, 30, 2)), "odd": 2.0 * sum(range(1, 30, 2))}
    assert {(r["field"], r["n"]) for r in counters(res).collect()} == {("one", 3), ("two", 3)}
    assert list(source_names([div, div])) == ["dataSource1", "dataSource2"]
    ident = mr_exec(div)
    assert ident.rows().count() == 30 and not ident.is_ddo
    with pytest.raises(ValueError, match="nothing was collected"):
        mr_exec(div, lambda *a: None)


@pytest.mark.parametrize("late", ["1.5", "3000000000", "text", "2d"])
def test_value_that_misfits_its_column(spark, tmp_path, late):
    (tmp_path / "a.csv").write_text("i,x\n" + "".join(f"{i},{i}.5\n" for i in range(1200)))
    (tmp_path / "b.csv").write_text(f"i,x\nNA,\n{'7' if late == '2d' else late},{late if late == '2d' else '0'}\n")
    with pytest.raises(Exception, match=f"not (int|double) in column [ix]; give schema=: {late}"):
        read_csv(spark, str(tmp_path)).df.collect()
    got = read_csv(spark, str(tmp_path), schema="i string, x string").df.where("i is null or i = '1' or x = '2d' or i = '" + late + "'")
    assert got.count() == 3


@pytest.mark.parametrize(("split", "most"), [(None, 10), ("90b", 10), ("90b", 0)])
@pytest.mark.parametrize("multi", [False, True])
def test_lines_and_records_over_many_splits(spark, tmp_path, monkeypatch, split, most, multi):
    """Against Python's own reader: quoted line ends, separators, marks and comment marks; blank lines; files cut into many splits."""
    import csv
    import io
    import random

    from divrec.sources import text

    monkeypatch.setattr(text, "MAX_SPLITS", most * 10_000)  # 0: no split's place is broadcast
    rnd = random.Random(4)
    want = []
    for f in range(4):
        out = io.StringIO()
        out.write("skipped \"line\na,b,c\n")
        w = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL)
        for _ in range([40, 0, 1, 25][f]):
            row = [str(rnd.randint(0, 99)), "".join(rnd.choices(["x", ",", '"', "#", " ", *(["\n"] * multi)], k=rnd.randint(1, 9))) + "e", rnd.choice(["", "end"])]
            want.append((int(row[0]), row[1], row[2]))
            w.writerow(row)
            out.write("\n" * (rnd.random() < 0.2))
        (tmp_path / f"f{f}.csv").write_text(out.getvalue())
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = read_csv(spark, str(tmp_path), skip=1, comment="#", rows_per_block=9).rows().collect()
        lines = read_text_chunks(spark, str(tmp_path), lambda v, h: {"n": len(v), "head": h}, "n int, head string", lines_per_block=10, header=True, skip=1)
        got_lines = sorted((int(r[KEY]), r["n"], r["head"]) for r in lines.rows().collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])
    assert sorted((r["a"], r["b"], r["c"]) for r in rows) == sorted(want)
    for block in {r[KEY] for r in rows}:
        assert sorted((r["a"], r["b"], r["c"]) for r in rows if r[KEY] == block) == sorted(want[(block - 1) * 9 : block * 9])
    n = sum(len(p.read_text().splitlines()) - 2 for p in tmp_path.iterdir())
    assert got_lines == [(i + 1, min(10, n - 10 * i), "a,b,c") for i in range(-(-n // 10))]


def test_open_quotes_and_escapes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"open\n2,x\n')
    with pytest.raises(Exception, match="never closed"):
        read_csv(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text('a,b\n1,x\\ty\\x41\\101\\\\\n')
    assert read_csv(spark, str(tmp_path / "b.csv"), allow_escapes=True).rows().first()["b"] == "x\tyAA\\"
    (tmp_path / "c.csv").write_text('t,n\n"x\ny",1\n"x#1",2\n')
    got = read_csv(spark, str(tmp_path / "c.csv"), comment="#").rows().collect()
    assert sorted((r["t"], r["n"]) for r in got) == [("x\ny", 1), ("x#1", 2)]


def test_look_up_of_every_number_key(spark, tmp_path):
    c = DiskConnection(f"{tmp_path}/n", n_bins=8)
    c.write(spark.range(20).select(F.col("id").alias(KEY), (F.col("id") * 2).alias("v")))
    opened = DiskConnection(f"{tmp_path}/n")  # the number of bins is kept with the rows
    assert [opened.read_key(spark, k).first()["v"] for k in range(20)] == [2 * k for k in range(20)]
    assert opened.read_key(spark, "7").count() == 1 and opened.read_key(spark, 99).count() == 0


@pytest.mark.parametrize("bins", [0, 4])
def test_attributes_follow_changes(spark, tmp_path, bins):
    from divrec.streaming.ingest import add_batch, ingest_files

    o = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(10)], "v int, g string")
    c = DiskConnection(f"{tmp_path}/k", n_bins=bins)
    convert(update_attributes(divide(o, "g")), c)
    spark.createDataFrame([(i, "cd"[i % 2]) for i in range(5)], o.schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second finds nothing new
        ingest_files(spark, f"{tmp_path}/in", c, o.schema, ["g"], checkpoint=f"{tmp_path}/ck")
        back = open_division(spark, c)
        assert back.rows().count() == back.nrow() == 15 and len(back) == 4 and back.split_cols == ("g",)
    more = divide(o.limit(2).withColumn("g", F.lit(None).cast("string")), "g").rows()
    assert add_data(spark, c, more) == 2 and add_data(spark, c, more) == 0
    again = divide(o.limit(1).withColumn("g", F.lit("b")), "g").rows()
    assert add_data(spark, c, again, overwrite=True) == 1
    back = open_division(spark, c)
    assert back.rows().count() == back.nrow() == 15 and len(back) == 5
    assert remove_data(spark, c, ["g=a", "g=zz"]) == 1
    back = open_division(spark, c)
    assert back.rows().count() == back.nrow() == 11 and len(back) == 4 and "summary" not in back.attrs
    batch = divide(o, "g").rows()
    assert [add_batch(batch, c, "id-1"), add_batch(batch, c, "id-1")] == [10, 0] and c.read(spark).count() == 21
    # a crash while files were moved in: the marker is missing, the files are there
    next((tmp_path / "k" / "_meta" / "batches").glob("id-1")).unlink()
    assert add_batch(batch, c, "id-1") == 10 and c.read(spark).count() == 21


def test_empty_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.csv").write_text("")
    got = read_csv(spark, f"{tmp_path}/none")
    assert got.rows().count() == 0 and got.names == []
    (tmp_path / "none" / "b.csv").write_text("a,b\n")
    got = read_csv(spark, f"{tmp_path}/none")
    assert got.rows().count() == 0 and got.names == ["a", "b"]
    (tmp_path / "none" / "c.csv").write_text("a,b\n\n1,\"x\n\n\"\n")
    got = read_csv(spark, f"{tmp_path}/none").rows().collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, "x\n\n")]
    assert read_text_chunks(spark, f"{tmp_path}/none/a.csv", lambda v: len(v), "value int").rows().count() == 0
