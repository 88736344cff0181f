import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from divrec.llm.contamination import SuffixAutomaton, decontaminate, leaks


def brute(seqs, doc, k):
    found = {}
    for key, seq in seqs:
        grams = {tuple(seq[i : i + k]) for i in range(len(seq) - k + 1)}
        at = [i for i in range(len(doc) - k + 1) if tuple(doc[i : i + k]) in grams]
        if at:
            found[key] = len({p for i in at for p in range(i, i + k)})
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5))
def test_automaton(items, doc, k):
    seqs = list(enumerate(items))
    got = SuffixAutomaton(seqs, k).covered(doc)
    assert {key: sum(e - s for s, e in spans) for key, spans in got.items()} == brute(seqs, doc, k)


ITEM = "the quick brown fox jumps over the lazy dog near the old river bank today"


@pytest.fixture(scope="module")
def tables(spark):
    items = [(1, ITEM), (2, ITEM + " and again"), (3, "too short to leak"), (4, None), (5, ""), (None, ITEM), (6, "other words that nobody would ever put into any review of a lamp")]
    docs = [
        (1, "I say: The QUICK brown <b>fox</b> jumps over the lázy dog near the old river bank today. Fine."), (2, "the quick brown fox jumps over the lazy dog"), (3, None), (4, ""),
        (5, "nothing " * 20000 + ITEM.upper()), (6, "the quick brown fox jumps over the lazy dog NEAR"), (6, "the quick brown fox jumps over the lazy dog NEAR"), (None, ITEM), (7, "nothing to see here at all, really nothing, only a few plain words"),
    ]
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "eval_id bigint, text string")


@pytest.mark.parametrize("block", [2_000_000, 5])
def test_leaks(tables, block):
    got = sorted((r["doc_id"] or 0, r["eval_id"], r["item_words"]) for r in leaks(*tables, block_words=block).collect())
    assert got == [(0, 1, 15), (0, 2, 15), (1, 1, 15), (1, 2, 15), (5, 1, 15), (5, 2, 15), (6, 1, 10), (6, 1, 10), (6, 2, 10), (6, 2, 10)]


def test_empty_and_clashing(tables):
    docs, items = tables
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0
    assert leaks(docs.withColumn("eval_id", F.lit(3)).withColumn("spans", F.lit(1)), items).count() == 10


def test_decontaminate(tables):
    docs, items = tables
    docs = docs.where("doc_id is not null").distinct().withColumn("verdict", F.lit("mine"))
    got = {r["doc_id"]: r for r in decontaminate(docs, leaks(docs, items), max_coverage=0.9).collect()}
    assert got[1]["verdict_"] == "cut" and got[1]["text"] == "I say: . Fine." and got[1]["verdict"] == "mine"
    assert got[6]["verdict_"] == "drop" and got[6]["coverage"] == 1.0
    assert got[2]["verdict_"] == "keep" and got[3]["text"] is None and got[5]["verdict_"] == "cut" and len(got[5]["text"]) == 160_000
    assert got[7]["verdict_"] == "keep"


def test_against_all_grams(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 40)))) for i in range(40)]
    docs = [(i, " ".join(rnd.choices(vocab, k=60))) for i in range(60)]
    got = {(r["doc_id"], r["eval_id"]): r["item_words"] for r in leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "eval_id bigint, text string"), min_words=4, block_words=300).collect()}
    seqs = [(k, t.split()) for k, t in items]
    assert got == {(d, k): n for d, t in docs for k, n in brute(seqs, t.split(), 4).items()}


@pytest.mark.parametrize(("block", "words_a_pass"), [(300, 10**6), (5, 10**6), (60, 250)])
def test_many_blocks_and_passes(spark, monkeypatch, block, words_a_pass):
    """More blocks than a worker holds, and more words than a pass takes: the same pairs."""
    from divrec.llm import contamination

    monkeypatch.setattr(contamination, "PASS_WORDS", words_a_pass)
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(0, 40)))) for i in range(40)]
    docs = [(i, " ".join(rnd.choices(vocab, k=60))) for i in range(60)] + [(99, "w0 " * 500 + "w1 w2 w3 w4"), (98, "nothing of it")]
    d, i = spark.createDataFrame(docs, "doc_id int, text string").repartition(3), spark.createDataFrame(items, "eval_id bigint, text string")
    found = leaks(d, i, min_words=4, block_words=block)
    got = {(r["doc_id"], r["eval_id"]): r["item_words"] for r in found.collect()}
    seqs = [(k, t.split()) for k, t in items]
    assert got == {(a, k): n for a, t in docs for k, n in brute(seqs, t.split(), 4).items()}
    if block == 300:
        scans = found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
        assert scans == 1  # the documents are read once for all blocks


def test_clean_in_one_pass(tables):
    """As decontaminate, and with missing and repeated ids: every row is cut by its own spans."""
    from divrec.llm.contamination import clean_documents

    docs, items = tables
    unique = docs.where("doc_id is not null").distinct()
    key = lambda d: sorted((r["doc_id"], r["text"], r["coverage"], r["verdict"]) for r in d.select("doc_id", F.coalesce("text", F.lit("-")).alias("text"), "coverage", "verdict").collect())
    assert key(clean_documents(unique, items, max_coverage=0.9)) == key(decontaminate(unique, leaks(unique, items), max_coverage=0.9))
    odd = docs.where("doc_id is null").unionByName(docs.where("doc_id in (1, 7)").withColumn("doc_id", F.lit(1).cast("bigint"))).withColumn("_cut", F.lit("mine"))
    got = sorted((r["doc_id"] or 0, r["verdict"], r["_cut"]) for r in clean_documents(odd, items, max_coverage=0.9).collect())
    assert got == [(0, "drop", "mine"), (1, "cut", "mine"), (1, "keep", "mine")]
    assert clean_documents(docs, items.limit(0)).where("verdict <> 'keep'").count() == 0 and clean_documents(docs.limit(0), items).count() == 0


def test_broadcasts_hold_plain_values(tables):
    """Executors don't have this package, so what is sent must not name its classes."""
    import pickle

    from divrec.llm.contamination import _shared, item_blocks
    from divrec.llm.repetition import kneser_ney

    docs, items = tables
    assert b"divrec" not in pickle.dumps(_shared(docs.sparkSession, list(item_blocks(items, 10))).value)
    m = kneser_ney(docs.withColumn("lang", F.lit("en")))
    assert b"divrec" not in pickle.dumps((m.counts, m.contexts, m.langs))
