import math
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from divrec.llm.repetition import perplexities, perplexity_bands, plain_language, repeated_shares, repeated_words
from divrec.llm.text import words


def slow(seq, run):
    marked = set()
    for j in range(len(seq) - run + 1):
        if any(seq[i : i + run] == seq[j : j + run] for i in range(j)):
            marked |= set(range(j, j + run))
    return len(marked)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=25), st.integers(1, 6))
def test_repeated_words(seq, run):
    assert repeated_words(seq, run) == slow(seq, run)


def test_shares(spark):
    six = "one two three four five six"
    rows = [(1, f"{six} {six}"), (2, None), (3, ""), (4, "word"), (5, "a " * 50_000), (6, "Same here. Other. SAME here!\nSame here. Other. SAME here!"), (6, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_words", F.lit(1)).withColumn("share", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_words"], r["repeated_words"], round(r["share"], 3)) for r in repeated_shares(df).collect())
    assert got == [(1, 12, 6, 0.5), (2, 0, 0, 0.0), (3, 0, 0, 0.0), (4, 1, 0, 0.0), (5, 50_000, 49_999, 1.0), (6, 1, 0, 0.0), (6, 10, 0, 0.0)]
    # five words repeated are no run of six; as lines and sentences they count
    line = {r["doc_id"]: r for r in repeated_shares(df).where("n_words = 10").collect()}[6]
    assert line["paragraph_share"] == 0.5 and line["sentence_share"] > 0.5
    assert repeated_shares(df.limit(0)).count() == 0


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney trigrams, by definition."""
    seqs = [["^ ", "^ ", *words(t), "$ "] for t in texts]
    c3 = Counter((s[i - 2], s[i - 1], s[i]) for s in seqs for i in range(2, len(s)))
    c2 = Counter((b, c) for _, b, c in c3)
    c1 = Counter(c for _, c in c2)

    def discounts(counts):
        t = Counter(counts.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else math.nan
        out = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * t[k + 1] / t[k] if t[k] else math.nan
            out.append(d if 0 < d < k else k / 2)
        return out

    def level(counts, of, lower):
        ds = discounts(counts)
        total, freed = defaultdict(float), defaultdict(float)
        for g, n in counts.items():
            total[of(g)] += n
            freed[of(g)] += ds[min(n, 3) - 1]
        return lambda g: (counts[g] - ds[min(counts[g], 3) - 1] + freed[of(g)] * lower(g)) / total[of(g)]

    p1 = level(c1, lambda g: 0, lambda g: 1 / len(c1))
    p2 = level(c2, lambda g: g[0], lambda g: p1(g[1]))
    p3 = level(c3, lambda g: g[:2], lambda g: p2(g[1:]))
    return [math.exp(-sum(math.log(p3((s[i - 2], s[i - 1], s[i]))) for i in range(2, len(s))) / (len(s) - 2)) for s in seqs], p3


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the cat sat on the dog the cat sat on the dog", "", "one", "mat log mat log mat log mat log", "cat sat"] * 2


def test_perplexity_by_definition(spark):
    rows = [(i, t, ["en", "EN-gb", "eng"][i % 3]) for i, t in enumerate(TEXTS)] + [(100, "le chat", "fr"), (101, None, None)]
    got = {r["doc_id"]: r for r in perplexities(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    want, _ = kneser_ney(TEXTS)
    for i, p in enumerate(want):
        assert got[i]["perplexity"] == pytest.approx(p, rel=1e-9) and got[i]["n_words"] == len(words(TEXTS[i])) and got[i]["lang"] == "en"
    assert got[101]["lang"] == "und" and got[101]["n_words"] == 0
    assert perplexities(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_bands(spark):
    rows = [(i, "en" if i % 2 else "de", 10, float(i)) for i in range(200)]
    got = perplexity_bands(spark.createDataFrame(rows, "doc_id bigint, lang string, n_words bigint, perplexity double"), 0.1, 0.9)
    assert {(r["lang"], r["verdict"]): r["count"] for r in got.groupBy("lang", "verdict").count().collect()} == {(x, v): n for x in ("en", "de") for v, n in (("low", 9), ("keep", 81), ("high", 10))}


def test_plain_language(spark):
    df = spark.createDataFrame([("en-GB",), ("de_DE",), ("ENG",), (" fr ",), ("",), (None,), ("zz",), ("?",)], "l string")
    assert [r[0] for r in df.select(plain_language(F.col("l"))).collect()] == ["en", "de", "en", "fr", "und", "und", "zz", "und"]


def test_held_out_texts_and_pruned_models(spark):
    """Texts the model was not counted on, with words and n-grams it lacks; a model of few n-grams still sums up to one."""
    import numpy as np

    from divrec.llm.repetition import _hashes, kneser_ney as fit

    rows = [(i, t, "en") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = fit(docs)
    new = ["the dog sat on the mat", "unheard words", "cat cat cat", ""]
    got = {r["doc_id"]: r["perplexity"] for r in perplexities(spark.createDataFrame([(i, t, "en") for i, t in enumerate(new)] + [(9, "x", "fr")], docs.schema), model=model).collect()}
    _, p3 = kneser_ney(TEXTS)

    def back_off(a, b, c):  # by definition, for words that are known
        seqs = [["^ ", "^ ", *words(t), "$ "] for t in TEXTS]
        c3 = Counter((s[i - 2], s[i - 1], s[i]) for s in seqs for i in range(2, len(s)))
        return p3((a, b, c)) if (a, b, c) in c3 else None

    s = ["^ ", "^ ", *words(new[0]), "$ "]
    seen = [back_off(*s[i - 2 : i + 1]) for i in range(2, len(s))]
    assert all(np.isfinite(list(got[i] for i in range(4)))) and got[9] is None and got[1] > got[0]
    if all(x is not None for x in seen):
        assert got[0] == pytest.approx(math.exp(-sum(map(math.log, seen)) / len(seen)))
    vocab = sorted({w for t in TEXTS for w in words(t)} | {"$ "})
    for m in (model, fit(docs, keep=(4, 5, 6)), fit(docs, keep=(0, 0, 0))):
        for a, b in (("^ ", "^ "), ("the", "cat"), ("never", "the"), ("never", "seen")):
            h = [np.repeat(_hashes([x]), len(vocab)) for x in ("en", a, b)]
            p = np.exp(m.log_probabilities(h[0], h[1], h[2], _hashes(vocab), np.repeat([m.langs["en"]], len(vocab), axis=0)))
            assert p.sum() == pytest.approx(1.0) and p.min() > 0
    assert len(fit(docs, keep=(4, 5, 6)).counts[3][0]) <= 6 < len(model.counts[3][0])


def test_what_the_arrays_lack_is_scored_exactly(spark):
    """However few n-grams the arrays hold, perplexities are those of the whole model, of its own texts and of others."""
    from divrec.llm.repetition import kneser_ney as fit

    rows = [(i, t, "en") for i, t in enumerate(TEXTS)] + [(3, "the cat sat", "en"), (100, "le chat", "fr"), (101, None, None), (102, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("row", F.lit(1)).withColumn("p", F.lit("clash"))
    new = spark.createDataFrame([(0, "the dog sat on the mat", "en"), (1, "unheard words of the cat", "en"), (2, "cat cat cat", "en"), (3, "", "en"), (4, "x", "de"), (5, None, "fr"), (5, "chat le", "fr")], "doc_id bigint, text string, lang string")
    seen = lambda df: sorted((r["doc_id"], r["lang"], r["n_words"], -1.0 if r["perplexity"] is None else r["perplexity"]) for r in df.collect())
    whole = fit(docs)
    want = {texts: seen(perplexities(texts, model=whole)) for texts in (docs, new)}
    for keep in ((4, 5, 6), (0, 0, 0), (10**6, 3, 10**6)):
        model = fit(docs, keep=keep)
        for texts, rows in want.items():
            got = seen(perplexities(texts, model=model))
            assert [g[:3] for g in got] == [r[:3] for r in rows] and [g[3] for g in got] == pytest.approx([r[3] for r in rows], rel=1e-9)
        p = [r["perplexity"] for r in perplexities(docs, model=model).where("doc_id < 100 and n_words <> 3").orderBy("doc_id").collect()]
        assert p[:8] == p[8:] and p == pytest.approx(kneser_ney([*TEXTS, "the cat sat"])[0][:-1], rel=1e-9)  # equal texts: the same to the last bit
    assert perplexities(new.limit(0), model=model).count() == 0


def test_scoring_moves_no_rows(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, lang string")
    assert "Exchange" not in perplexities(docs)._jdf.queryExecution().executedPlan().toString()
