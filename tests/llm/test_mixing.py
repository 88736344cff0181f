import numpy as np
import pytest
from pyspark.sql import functions as F

from divrec.llm.mixing import PARTS, _feature_rows, fit_classifier, mix_sources, plain_source, posteriors, to_parts, unreachable


@pytest.fixture(scope="module")
def docs(spark):
    rnd = np.random.default_rng(6)
    themes = {"Shop ": "lamp chair table wood desk", "news": "vote party law court state", "forum": "game player score team ball"}
    rows = []
    for i in range(900):
        src = ["Shop ", "news", "news", "forum", "shop", "forum", None, "other"][i % 8]
        theme = themes.get(src, themes["Shop "] if src == "shop" else "lamp chair vote game" if src == "other" else themes["news"])
        rows.append((i, " ".join(rnd.choice(theme.split(), size=int(rnd.integers(5, 40)))), src, -1))
    rows += [(9001, None, "news", 0), (9002, "", "news", 0), (9003, "", None, 0), (9004, None, None, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int")


TARGETS = "mix_id int, budget_ratio double, source string, target_weight double, max_repeats int"


def test_shares_are_reached(spark, docs):
    t = spark.createDataFrame([(1, 0.5, "SHOP", 2.0, 3), (1, 0.5, " news", 1.0, 3), (1, 0.5, "forum", 1.0, None)], TARGETS)
    report, uses = mix_sources(docs, t)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"shop", "news", "forum"}
    for s, share in (("shop", 0.5), ("news", 0.25), ("forum", 0.25)):
        assert got[s]["target_share"] == share and abs(got[s]["fitted_tokens"] / got[s]["target_tokens"] - 1) < 1e-3 and abs(got[s]["actual_share"] - share) < 0.05 and not got[s]["saturated"]
    assert got["forum"]["available_tokens"] is None and unreachable(report).count() == 0
    worst = uses.join(docs, "doc_id").where("lower(trim(source)) in ('shop', 'news')").agg(F.max("uses")).first()[0]
    assert worst <= 3
    size = docs.where("lower(trim(source)) = 'shop'").agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
    assert got["shop"]["size_tokens"] == size


def test_unreachable(spark, docs):
    rows = [(1, 1.0, "shop", 9.0, 1), (1, 1.0, "news", 1.0, 1), (2, 5.0, "forum", 1.0, None), (2, 5.0, "nobody", 1.0, 2), (2, 5.0, "NOBODY ", 1.0, 9), (3, 1.0, None, 1.0, 1), (3, 1.0, "news", None, 1), (None, 1.0, "news", 1.0, 1), (4, 1.0, "news", -1.0, 1)]
    report, uses = mix_sources(docs, spark.createDataFrame(rows, TARGETS))
    assert {(r["mix_id"], r["source"]) for r in unreachable(report).collect()} == {(1, "shop"), (2, "nobody")}
    r = {(r["mix_id"], r["source"]): r for r in report.collect()}
    assert set(r) == {(1, "shop"), (1, "news"), (2, "forum"), (2, "nobody")}
    assert r[(2, "nobody")]["max_repeats"] == 2 and r[(2, "nobody")]["target_share"] == pytest.approx(2 / 3)
    assert r[(1, "shop")]["actual_tokens"] >= r[(1, "shop")]["size_tokens"] > 0
    assert uses.where("mix_id = 1 and uses > 1").count() == 0


def test_unreachable_with_documents_without_source(spark):
    """A third of the words have no source and half the sound of shop: they lift it above its target, and its own documents leave the cap."""
    rnd = np.random.default_rng(8)
    shop, news = "lamp chair table wood desk".split(), "vote party law court state".split()
    rows = [(i, " ".join(rnd.choice([shop, news, shop + news][i % 3], size=20)), ["shop", "news", None][i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([(1, 1.0, "shop", 0.35, 1), (1, 1.0, "news", 0.65, 1)], TARGETS)
    report, _ = mix_sources(docs, t)
    got = {r["source"]: r for r in report.collect()}
    assert all(got[s]["size_tokens"] == 6000 for s in ("shop", "news")) and got["shop"]["target_tokens"] == pytest.approx(6300)
    assert not got["shop"]["saturated"]
    assert {r["source"] for r in unreachable(report).collect()} == {"shop", "news"}


def test_same_at_any_partitioning(spark, docs):
    t = spark.createDataFrame([(1, 0.7, "shop", 1.0, 2), (1, 0.7, "news", 1.0, 2)], TARGETS)
    key = lambda d: sorted(map(tuple, mix_sources(d, t)[1].collect()))
    assert key(docs.repartition(1)) == key(docs.repartition(9))


def test_empty(spark, docs):
    t = spark.createDataFrame([(1, 1.0, "shop", 1.0, 2)], TARGETS)
    report, uses = mix_sources(docs.limit(0), t)
    assert uses.count() == 0 and [(r["size_tokens"], r["actual_share"]) for r in report.collect()] == [(0, 0.0)]
    report, uses = mix_sources(docs, t.limit(0))
    assert report.count() == 0 and uses.count() == 0


def test_classifier_held_out():
    rnd = np.random.default_rng(7)
    themes = [["lamp", "chair", "wood", "the"], ["vote", "law", "court", "the"], ["game", "score", "ball", "the"]]
    seqs = [list(rnd.choice(themes[i % 3], size=12)) for i in range(600)]
    y = np.arange(600) % 3
    w = fit_classifier(_feature_rows(seqs[:300]), y[:300], 3)
    p = posteriors(w, seqs[300:])
    assert (p.argmax(axis=1) == y[300:]).mean() > 0.97 and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    q = to_parts(p)
    assert (q.sum(axis=1) == PARTS).all() and (np.abs(q / PARTS - p) < 1 / PARTS).all()


def test_plain_source(spark):
    df = spark.createDataFrame([(" A b\t",), ("",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(plain_source(F.col("s"))).collect()] == ["a b", None, None, None]


def test_fit_by_jobs_is_the_fit_in_one_place(spark, docs):
    t = spark.createDataFrame([(1, 0.7, "shop", 1.0, 2), (1, 0.7, "news", 1.0, 2), (2, 3.0, "forum", 1.0, None), (2, 3.0, "shop", 3.0, 4)], TARGETS)
    key = lambda n: sorted((r["mix_id"], r["source"], round(r["fitted_tokens"], 6), r["actual_tokens"], r["saturated"]) for r in mix_sources(docs, t, local_groups=n)[0].collect())
    assert key(0) == key(10**6)


def test_sample_is_that_of_the_least_hashes(spark):
    from divrec.llm.mixing import _labelled_sample

    known = spark.range(3000).select(F.col("id").alias("i"), F.concat(F.lit("s"), F.col("id") % 3).alias("s"), F.lit("a b").alias("t"), F.xxhash64("id").alias("h"))
    want = [r["s"] for r in known.orderBy("h", "i").limit(100).collect()]
    for n in (3000, 10**7, 1):  # the count is only an estimate of how far to look
        labels, x = _labelled_sample(known, 100, n)
        assert labels == want and x.shape[0] == 100
    assert len(_labelled_sample(known, 10**4, 3000)[0]) == 3000 and _labelled_sample(known.limit(0), 10, 0)[0] == []
    plan = known.where(F.col("h") <= 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan


def test_memberships_are_sparse(spark):
    """A thousand sources: a document holds one entry, or as many as it has parts at most."""
    rnd = np.random.default_rng(3)
    rows = [(i, " ".join(rnd.choice(["lamp", "vote", "game", "wood"], size=9)), f"s{i % 500}" if i % 10 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([(1, 0.5, f"s{i}", 1.0, 3) for i in range(500)], TARGETS)
    report, uses = mix_sources(docs, t)
    r = report.agg(F.count("*").alias("n"), F.sum("actual_share").alias("s"), F.sum("size_tokens").alias("z")).first()
    assert r["n"] == 500 and r["s"] == pytest.approx(1, abs=0.02) and r["z"] == 9 * 1800 and uses.agg(F.max("uses")).first()[0] <= 3
