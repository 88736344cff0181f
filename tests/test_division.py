"""Division, deferred methods and recombination: invariants, missing values, odd keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from divrec.operators.combine import comb_collect, comb_ddf, comb_ddo, comb_mean, comb_mean_coef, comb_rbind, recombine
from divrec.operators.division import KEY, Pair, add_transform, cond_div, ddf, ddo, divide, dr_filter, dr_join, dr_lapply, dr_sample, dr_subset, joined_lists, kv_apply, kv_pairs, rr_div, to_ddf
from divrec.operators.mapreduce import mr_exec

# shaped like a flower table: three kinds of fifty rows
RNG = np.random.default_rng(1)
FLOWERS = pd.DataFrame({"Sepal.Length": RNG.normal(5.8, 0.8, 150).round(1), "width": RNG.normal(3, 0.4, 150).round(1), "kind": ["ash"] * 50 + ["elm"] * 50 + ["oak"] * 50})


@pytest.fixture(scope="module")
def flowers(spark):
    return spark.createDataFrame(FLOWERS)


def multiset(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_divide_keeps_the_rows(flowers):
    div = divide(flowers, "kind")
    assert multiset(div.flatten().select(*[f"`{c}`" for c in flowers.columns])) == multiset(flowers)
    assert sorted(r[0] for r in div.get_keys().collect()) == ["kind=ash", "kind=elm", "kind=oak"]
    assert div.names == ["Sepal.Length", "width"] and div.ncol() == 2 and len(div) == 3 and div.nrow() == 150
    assert div.get_split_vars("kind=elm") == {"kind": "elm"}


def test_keys_of_missing_numbers_and_text(spark):
    rows = [(1.0, None, "a|b"), (1.5, True, ""), (None, False, None), (float("nan"), None, "x"), (1e16, True, "x"), (0.1, True, "x"), (-0.0, True, "x"), (float("inf"), True, "x"), (1e300, True, "x")]
    div = divide(spark.createDataFrame(rows, "n double, b boolean, t string"), ["n", "b", "t"])
    keys = {r[0] for r in div.get_keys().collect()}
    assert {"n=1|b=NA|t=a|b", "n=1.5|b=TRUE|t=", "n=NA|b=FALSE|t=NA", "n=NA|b=NA|t=x", "n=10000000000000000|b=TRUE|t=x", "n=0.1|b=TRUE|t=x", "n=0|b=TRUE|t=x", "n=Inf|b=TRUE|t=x"} <= keys


@pytest.mark.parametrize(("n", "spill", "sizes"), [(25, 10, [10, 10, 5]), (20, 10, [10, 10]), (10, 10, [10]), (11, 10, [10, 1]), (3, 10, [3])])
def test_spill(spark, n, spill, sizes):
    """Also at exact multiples of the limit; no suffix unless it is exceeded."""
    div = divide(spark.range(n).withColumn("g", F.lit("x")), "g", spill=spill)
    got = {r[KEY]: r["count"] for r in div.rows().groupBy(KEY).count().collect()}
    assert got == ({"g=x": n} if n <= spill else {f"g=x_{i}": s for i, s in enumerate(sizes, 1)})


def test_random_division(spark, flowers):
    want = None
    for parts in (1, 7):
        div = divide(flowers.repartition(parts), rr_div(30, seed=5))
        got = multiset(div.rows().select(KEY, "`Sepal.Length`", "width", "kind"))
        want = want or got
        assert got == want  # whatever the partitioning
    keys = {r[0] for r in div.get_keys().collect()}
    assert keys <= {f"rr_{i}" for i in range(1, 6)} and len(keys) == 5
    assert multiset(divide(flowers, rr_div(30, seed=6)).rows().select(KEY, "width")) != multiset(div.rows().select(KEY, "width"))
    same = spark.createDataFrame([(1, "a")] * 200, "x int, y string")  # repeated rows spread like others
    assert divide(same, rr_div(50)).get_keys().count() == 4
    again = divide(div, "kind")
    assert multiset(again.flatten().select(*[f"`{c}`" for c in flowers.columns])) == multiset(flowers)


def test_empty_table(flowers):
    div = divide(flowers.limit(0), "kind")
    assert len(div) == 0 and recombine(div, comb_rbind()).count() == 0 and recombine(div, comb_collect()) == []
    with pytest.raises(ValueError, match="example"):
        add_transform(div, lambda v: v)


def test_bad_column(flowers):
    with pytest.raises(ValueError, match="no such column"):
        divide(flowers, "colour")
    with pytest.raises(ValueError, match="grouped"):
        to_ddf(flowers, [])


def test_filter_bsv_pre_post(flowers):
    big = FLOWERS.groupby("kind")["width"].mean().idxmax()
    div = divide(
        flowers, "kind", filter_by=F.avg("width") >= float(FLOWERS.groupby("kind")["width"].mean().max()) - 1e-9, bsv={"mean_w": (F.avg("width"), "mean width"), "n": F.count(F.lit(1))},
        pre=lambda d: d.withColumn("twice", F.col("width") * 2), post=lambda d: d.withColumn("thrice", F.col("width") * 3),
    )
    assert [r[0] for r in div.get_keys().collect()] == [f"kind={big}"]
    assert div.get_bsvs(f"kind={big}")["n"] == 50 and list(div.bsv_info()["desc"]) == ["mean width", "n"]
    assert {"twice", "thrice"} <= set(div.names)
    flat = div.flatten()
    assert {"mean_w", "kind"} <= set(flat.columns) and flat.count() == 50


def test_transforms_chain_fuse_and_freeze(flowers):
    shift = 3.0
    div = add_transform(divide(flowers, "kind"), lambda v: v.assign(w=v["width"] + shift))
    shift = 100.0  # no effect: the value at the time of the call holds
    div = add_transform(div, lambda k, v: {"key_len": len(k), "w": float(v["w"].mean())})
    plan = div.rows()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroups") == 1 and plan.count("Exchange") == 1
    got = {r["kind"]: r["w"] for r in recombine(div, comb_rbind()).collect()}
    assert got == pytest.approx((FLOWERS.groupby("kind")["width"].mean() + 3.0).to_dict())
    assert div.kv_example().key == "kind=ash" and div.summary() is None
    assert "deferred" in repr(div)


def test_no_result_column_is_lost(spark):
    rows = spark.createDataFrame([("a", i, "late" if i == 1500 else "x") for i in range(1501)] + [("b", 1, "x"), ("c", 2, "late")], "g string, i int, lev string")
    div = divide(rows, "g")
    levels = lambda v: v["lev"].value_counts().to_dict()
    # a level beyond row 1000 of the first pair is a column
    assert {r["g"]: (r["x"], r["late"]) for r in recombine(add_transform(div, levels), comb_rbind()).fillna(0).collect()} == {"a": (1500, 1), "b": (1, 0), "c": (0, 1)}
    # one that the first pair hasn't is an error, unless the schema has it
    some = divide(rows.where("not (g = 'a' and lev = 'late')"), "g")
    with pytest.raises(Exception, match="columns that the schema lacks: late; give schema="):
        recombine(add_transform(some, levels), comb_rbind()).collect()
    assert {r["g"]: r["late"] for r in recombine(add_transform(some, levels, schema="x long, late long"), comb_rbind()).collect()} == {"a": None, "b": None, "c": 1}
    # the same in map/reduce, where the first collected pair gives the columns
    with pytest.raises(Exception, match="columns that the schema lacks"):
        mr_exec(some, lambda keys, values, collect, counter, source: [collect(k, {k[-1]: 1}) for k in keys]).df.collect()


def test_number_keys_of_single_rows(spark, tmp_path):
    from divrec.plans.recombination import QUERIES

    rows = [(9, 0.0, 2), (10, 1234.5, 1), (10, -0.25, 1), (11, 99999.0, 1), (12, 3e10, 1), (13, 1e-7, 1), (None, 5.0, 1), (14, None, 1), (14, float("nan"), 1)]
    spark.createDataFrame([(e, g) for e, g, n in rows for _ in range(n)], "educationnum int, capgain double").write.parquet(f"{tmp_path}/census.parquet")
    want = {(9, "0"): 2, (10, "1234.5"): 1, (10, "-0.25"): 1, (11, "99999"): 1, (12, "30000000000"): 1, (13, "0.0000001"): 1, ("NA", "5"): 1, (14, "NA"): 2}
    got = {r["key"]: r["n"] for r in QUERIES["divide_number_keys_whole"](spark, str(tmp_path)).collect()}
    assert got == {f"educationnum={e}|capgain={g}": n for (e, g), n in want.items()}


def test_only_used_columns_are_read(spark, flowers, tmp_path):
    flowers.write.parquet(f"{tmp_path}/f")
    div = add_transform(divide(spark.read.parquet(f"{tmp_path}/f"), "kind"), lambda v: {"cols": ",".join(v.columns)}, uses=["width"])
    plan = div.rows()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<width:double,kind:string>" in plan
    assert {r["cols"] for r in recombine(div, comb_rbind()).collect()} == {"width"}


def test_transform_errors_name_the_key(flowers):
    with pytest.raises(RuntimeError, match="kind=ash"):
        add_transform(divide(flowers, "kind"), lambda v: v["none"])


def test_rekey_and_bind(flowers):
    div = add_transform(divide(flowers, "kind"), lambda k, v: Pair("all", v.head(2)))
    res = recombine(div, comb_ddf())
    assert [(r[KEY], r["count"]) for r in res.rows().groupBy(KEY).count().collect()] == [("all", 6)]
    assert recombine(dr_lapply(divide(flowers, "kind"), lambda v: None, schema="x int"), comb_rbind()).count() == 0


def test_extract_order_and_missing(flowers):
    div = divide(flowers, "kind")
    import hashlib

    md5 = hashlib.md5(b"kind=oak").hexdigest()
    got = div[["kind=oak", "nothing", "kind=ash", 1, md5, 99]]
    assert [p and p.key for p in got] == ["kind=oak", None, "kind=ash", "kind=elm", "kind=oak", None]
    assert len(div["kind=elm"].value) == 50


def test_filter_sample_subset(flowers):
    div = divide(flowers, "kind")
    kept = dr_filter(div, lambda v: v["width"].sum() > 0)
    assert len(kept) == 3
    assert len(dr_filter(div, F.avg("width") > 1e9)) == 0
    assert len(dr_sample(div, 1.0)) == 3 and len(dr_sample(div, 0.0)) == 0
    rows = dr_subset(div, F.col("width") > F.lit(None).cast("double"))
    assert rows.count() == 0
    assert dr_subset(div, max_rows=7).count() == 7 and dr_subset(div, drop=True).columns == ["Sepal.Length", "width"]


def test_combines(spark, flowers):
    div = divide(flowers, "kind")
    means = add_transform(div, agg={"value": F.array(F.avg("width"), F.avg("`Sepal.Length`"))})
    got = [r["mean"] for r in recombine(means, comb_mean()).orderBy("pos").collect()]
    want = FLOWERS.groupby("kind")[["width", "Sepal.Length"]].mean().mean()
    assert got == pytest.approx([want["width"], want["Sepal.Length"]])
    py = dr_lapply(div, lambda v: np.array([1.0, float(len(v))]))
    assert [r["mean"] for r in recombine(py, comb_mean()).orderBy("pos").collect()] == [1.0, 50.0]
    coefs = ddf(spark.createDataFrame([("a", "x", 1.0, 1), ("b", "x", 4.0, 3), ("b", "z", 2.0, 3), ("c", "z", None, 5)], "k string, term string, coef double, n bigint"), "k")
    assert {r["term"]: r["coef"] for r in recombine(coefs, comb_mean_coef()).collect()} == {"x": 3.25, "z": 2.0}
    kept = recombine(div, comb_ddo())
    assert multiset(recombine(kept, comb_rbind())) == multiset(recombine(div, comb_rbind()))
    pairs = recombine(dr_lapply(div, lambda v: len(v)))
    assert {p.key: p.value for p in pairs} == {"kind=ash": 50, "kind=elm": 50, "kind=oak": 50}


def test_pairs(spark):
    assert kv_apply(lambda v: v + 1, "k", 1) == Pair("k", 2)
    assert kv_apply(lambda k, v: Pair("new", k), "k", 1) == Pair("new", "k")
    assert [p.key for p in kv_pairs(("a", 1), ("b", 2))] == ["a", "b"]
    with pytest.raises(ValueError):
        kv_pairs((1, 2, 3))
    vals = ddo(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, value int"))
    assert sorted((p.key, p.value) for p in vals.to_list()) == [("a", 1), ("a", 2), ("b", 3)]


def test_join_keys_are_the_union(spark):
    a = ddf(spark.createDataFrame([("x", 1)] * 30 + [("y", 2), (None, 3)], "k string, v int"), "k")
    b = ddf(spark.createDataFrame([("x", "p"), ("z", "q"), ("z", "q")], "k string, v string"), "k")
    j = dr_join(a=a, b=b)
    got = {r["k"]: (r["na"], r["nb"]) for r in j.df.groupBy(F.col(KEY).alias("k")).agg(F.count("a").alias("na"), F.count("b").alias("nb")).collect()}
    assert got == {"x": (30, 1), "y": (1, 0), None: (1, 0), "z": (0, 2)}
    assert {r[KEY]: len(r["a"]) for r in joined_lists(j).collect()} == {"x": 30, "y": 1, None: 1, "z": 0}
    with pytest.raises(MemoryError):
        joined_lists(j, max_rows=10)
    with pytest.raises(ValueError):
        dr_join()


def test_condition_specs():
    assert cond_div("a", ["b", "c"]).vars == ("a", "b", "c")
    assert "random" in repr(rr_div(10)) and "a, b" in repr(cond_div("a", "b"))


def test_package_names():
    import divrec

    assert all(getattr(divrec, n) is not None for n in divrec.__all__)
    with pytest.raises(AttributeError):
        divrec.nothing


def test_every_phase_collects_and_counts(spark, flowers):
    from divrec.operators.mapreduce import Control, Reduce, controlled, counters, default_control

    def pre(key, collect, counter):
        counter("phase", "pre")
        collect(f"{key}-pre", {"n": 0})
        return 0

    def step(state, key, values, collect, counter):
        counter("phase", "values", len(values))
        return state + sum(values)

    def post(state, key, collect, counter):
        counter("phase", "post")
        collect(key, {"n": state})

    def m(keys, values, collect, counter, source):
        for v in values:
            counter("phase", "map")
            for w in v["width"]:
                collect("wide" if w > 0 else "narrow", 1)

    div = divide(flowers, "kind")
    for combine in (None, lambda k, vs: [sum(vs)]):
        res = mr_exec(div, m, Reduce(step, post, pre, combine), control=Control(partitions=3, conf={"spark.sql.ansi.enabled": "true"}))
        got = {r["_key"]: r["n"] for r in res.rows().collect()}
        assert sum(n for k, n in got.items() if not k.endswith("-pre")) == 150 and sum(k.endswith("-pre") for k in got) == sum(not k.endswith("-pre") for k in got)
        c = {r["field"]: r["n"] for r in counters(res).collect()}
        assert c["map"] == 3 and c["pre"] == c["post"] and (c["values"] == 150 if combine is None else c["values"] < 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with controlled(spark, Control(partitions=77)):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "77"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and default_control() == Control()


def test_join_with_function_and_unnamed_sources(spark):
    from divrec.operators.division import dr_join

    a = divide(spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "id int, x int"), "id")
    b = divide(spark.createDataFrame([(2, "p"), (3, "q")], "id int, y string"), "id")
    got = dr_join(a, other=b, post=lambda v: {"names": ",".join(v), "n": sum(len(f) for f in v.values())}).rows().collect()
    assert sorted((r["_key"], r["names"], r["n"]) for r in got) == [("id=1", "unnamedDataSource1", 2), ("id=2", "unnamedDataSource1,other", 2), ("id=3", "other", 1)]
    assert {r["_source"] for r in dr_join(a, b).rows().collect()} == {"dataSource1", "dataSource2"}
    with pytest.raises(TypeError, match="is no division"):
        dr_join(x=a, y=b.rows())


def test_opaque_between_subset_variables(spark, flowers):
    import datetime

    with pytest.warns(UserWarning, match="range"):
        div = divide(flowers, "kind", bsv=lambda f: {"n": (len(f), "rows"), "mean": float(f["width"].mean()), "range": [0, 1], "odd": object(), "day": datetime.date(2020, 1, 1)})
    assert list(div.bsv_info()["name"]) == ["n", "mean", "odd", "day"] and div.bsv_info()["desc"][0] == "rows"
    got = {r["_key"]: r for r in div.bsvs().collect()}
    assert len(got) == 3 and all(r["n"] == 50 and r["odd"] is None and r["day"].year == 2020 for r in got.values())


def test_positions_pipe_and_first_pair_without_result(spark, flowers):
    div = divide(flowers, "kind")
    assert [p and p.key for p in div.extract([0, -1, 2, 3, -4])] == ["kind=ash", "kind=oak", "kind=oak", None, None]
    assert div.pipe(lambda d, k: d[k].key, 1) == "kind=elm"
    some = add_transform(div, lambda k, v: None if k == "kind=ash" else {"n": len(v)})
    assert sorted((r["_key"], r["n"]) for r in some.rows().collect()) == [("kind=elm", 50), ("kind=oak", 50)]


def test_distinct_values_have_distinct_keys(spark):
    v = [1.00000000001, 1.00000000002, 1e18, 1e22, 1.5e300, 1e-25, float(2**60), -0.0, 0.1]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    keys = [r[0] for r in divide(df, "x").rows().select("_key").collect()]
    assert len(set(keys)) == len(v) and keys[2:4] == ["x=1000000000000000000", "x=10000000000000000000000"] and keys[6] == f"x={2**60}"
    t = spark.createDataFrame([("x|b=y", "z"), ("x", "y|b=z"), ("a\\", "z|b=w"), ("a|b=z", "w"), ("a|b", "c=d")], "a string, b string")
    keys = [r[0] for r in divide(t, ["a", "b"]).rows().select("_key").collect()]
    assert len(set(keys)) == 5 and keys[4] == "a=a|b|b=c=d"


def test_random_division_of_repeated_rows(spark):
    """Rows without an identity: the same subsets under any partitioning, repeated rows spread over them, none lost."""
    rows = [(i, "x") for i in range(300)] + [(7, "y")] * 400 + [(8, None)] * 2
    df = spark.createDataFrame(rows, "a int, b string")
    sizes = []
    for parts in (1, 7):
        div = divide(df.repartition(parts), rr_div(100, seed=3)).rows()
        assert div.count() == 702 and div.columns == ["a", "b", "_key"]
        sizes.append(sorted((r["_key"], r["a"], r["b"] or "", r["n"]) for r in div.groupBy("_key", "a", "b").agg(F.count("*").alias("n")).collect()))
    assert sizes[0] == sizes[1]
    hot = [n for _, a, b, n in sizes[0] if (a, b) == (7, "y")]
    assert len(hot) == 7 and min(hot) > 25


def test_pairs_of_any_size_stay_on_the_cluster(spark, flowers, tmp_path):
    """Pairs by key, position or md5 as rows, those of a changed key too; a subset larger than the driver takes is counted whole."""
    import hashlib

    from divrec.plans.recombination import extract_by_key

    def sizes(div, wanted):
        return sorted((r["_place"], r["_key"], r["n"]) for r in div.extract_rows(wanted).groupBy("_place", "_key").agg(F.count("*").alias("n")).collect())

    div = divide(flowers, "kind")
    wanted = ["kind=oak", "none such", hashlib.md5(b"kind=elm").hexdigest(), 0, -1, 3, "kind=oak"]
    assert sizes(div, wanted) == [(0, "kind=oak", 50), (2, "kind=elm", 50), (3, "kind=ash", 50), (4, "kind=oak", 50), (6, "kind=oak", 50)]
    assert div.extract_rows([0]).columns == [*div.rows().columns, "_place"] and div.extract_rows([99, "none such"], "at").count() == 0
    changed = add_transform(div, lambda k, v: None if k == "kind=ash" else Pair(k[5:], v.head(3)))
    assert sizes(changed, wanted) == [(0, "oak", 3), (2, "elm", 3), (4, "oak", 3), (6, "oak", 3)]
    assert changed.extract_rows([1]).columns == [*changed.rows().columns, "_place"]
    by_number = ddo(spark.createDataFrame([(2.5, "a"), (7.0, "b")], "key double, value string"))
    assert sizes(by_number, [7.0, "2.5", "x"]) == [(0, 7.0, 1), (1, 2.5, 1)]
    with pytest.raises(ValueError, match="kind"):
        div.extract_rows([0], "kind")
    spark.range(5_000_021).select(F.when(F.col("id") < 20, "A").otherwise("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus")).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in extract_by_key(spark, str(tmp_path)).collect()] == [(0, "l_returnflag=R|l_linestatus=F", 5_000_001), (1, None, 0), (2, "l_returnflag=A|l_linestatus=F", 20)]


def test_first_pair_of_any_size(spark, flowers, tmp_path):
    """The example's key, and pairs by position larger than the driver takes."""
    from divrec.plans.recombination import first_pair

    div = divide(flowers, "kind")
    assert div.example_key() == div.kv_example().key == "kind=ash" and ddf(flowers.limit(0)).example_key() is None
    orders = spark.range(5_000_021).select(F.when(F.col("id") < 20, "2").otherwise("1").alias("o_orderpriority"), F.lit(1.0).alias("o_totalprice"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    large, small = ("o_orderpriority=1", 5_000_001, True), ("o_orderpriority=2", 20, True)
    assert [tuple(r) for r in first_pair(spark, str(tmp_path)).collect()] == [(0, *large), (1, *large), (2, *small), (3, *small), (4, None, 0, True)]
