"""Repetition inside a single document.

``repeated_shares`` measures, for every document, the share of words lying in
runs of words that begin at an earlier place of the same text as well, and the
share of words in repeated sentences and paragraphs.

``kneser_ney`` counts a modified Kneser-Ney trigram model of every language over
all documents and keeps it as sorted arrays of n-gram hashes, what is too large
for them in tables; ``perplexities`` scores any texts with the whole of it, by
binary search in place and the rest by joins, and ``perplexity_bands`` rejects
what lies outside its language's lower and upper band. Perplexity tells
unusually predictable or unpredictable texts; it holds no share of repeated
content, so the share comes from ``repeated_shares``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divrec.llm.quantiles import quantile_states, quantiles
from divrec.llm.text import portions, words
from divrec.runtime import broadcast_if_small, require_columns, stage

RUN = 6


def repeated_words(seq: list[str], run: int = RUN) -> int:
    """Words of ``seq`` in runs of ``run`` words that also begin at an earlier word (the two may overlap)."""
    grams = list(zip(*(seq[i:] for i in range(run))))
    if len(set(grams)) == len(grams):
        return 0
    seen, total, end = set(), 0, 0
    for i, g in enumerate(grams):
        if g in seen:
            total += i + run - max(end, i)
            end = i + run
        else:
            seen.add(g)
    return total


def _repeated_parts(text: str | None, mark: str) -> int:
    """Words in parts of the text (between marks) that are the same, as words, as an earlier part."""
    seen, total = set(), 0
    for part in (text or "").replace("!", ".").replace("?", ".").split(mark) if mark == "." else (text or "").split(mark):
        seq = tuple(words(part))
        if not seq:
            continue
        if seq in seen:
            total += len(seq)
        seen.add(seq)
    return total


def repeated_shares(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", run: int = RUN, parts: bool = True) -> DataFrame:
    """The share of repeated content of every document.

    Result, one row per input row: ``doc_id, n_words, repeated_words, share``
    (0 for texts without words), ``sentence_share`` and ``paragraph_share``
    (words in sentences, or lines, that are the same as an earlier one; NULL
    without ``parts``). One pass, no shuffle; memory is that of one text's runs.
    """
    require_columns(docs, [doc_id, text])
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_words", "repeated_words", "_s", "_p")])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column(1).to_pylist():
                seq = words(body)
                rows.append((len(seq), repeated_words(seq, run), *((_repeated_parts(body, "."), _repeated_parts(body, "\n")) if parts else (None, None))))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], names=schema.names)

    res = docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")).mapInArrow(measure, schema)
    share = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(F.lit(0.0))
    return res.select("doc_id", "n_words", "repeated_words", share("repeated_words").alias("share"), share("_s").alias("sentence_share"), share("_p").alias("paragraph_share"))


#: Three-letter codes of languages that also have a two-letter one (fixed values of ISO 639).
LANG3 = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "nld": "nl", "dut": "nl", "por": "pt"}


def plain_language(lang: Column) -> Column:
    """A language as its code: lower case, without region, two letters where there are two; missing is ``und``."""
    code = F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]+)", 1))
    two = F.create_map(*[F.lit(x) for pair in LANG3.items() for x in pair])
    return F.coalesce(F.try_element_at(two, code), F.nullif(code, F.lit("")), F.lit("und"))


#: N-grams of each order (words, pairs, triples) that a model holds in arrays: the most frequent ones, by a cut on their counts.
#: The others are in tables and found by joins, so the cut changes no perplexity. Some 24 bytes each in every worker that scores.
KEEP = (1_000_000, 1_500_000, 3_000_000)
_START, _END = "^ ", "$ "  # blanks can't occur in a word, so these marks are no words


def _hashes(flat: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(flat, dtype=object), categorize=True) if flat else np.zeros(0, np.uint64)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit key of several hashes."""
    out = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ p.astype(np.uint64, copy=False)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
            out *= np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
    return out


def _trigrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, a, b, c, n``: how often each triple of words (as hashes) occurs, the end of a text being a word."""
    schema = "lang string, w array<bigint>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            seqs = [[_START, _START, *words(body), _END] for body in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *(len(s) for s in seqs)])
            flat = pa.array(_hashes([w for s in seqs for w in s]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["lang", "w"])

    rows = docs.select(plain_language(F.col(f"`{lang}`")), F.col(f"`{text}`").cast("string")).mapInArrow(split, schema)
    three = F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 2).alias("a"), F.get("w", i - 1).alias("b"), F.get("w", i).alias("c")))
    return rows.select("lang", F.explode(three).alias("g")).groupBy("lang", "g.a", "g.b", "g.c").agg(F.count(F.lit(1)).alias("n"))  # combined before the exchange


def _discounts(types: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts per language from the counts of counts; 0.5, 1, 1.5 where they can't be had."""
    c = F.col("n")
    counts = types.groupBy("lang").agg(*[F.sum((c == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)])
    y = F.col("t1") / F.nullif(F.col("t1") + 2 * F.col("t2"), F.lit(0.0))
    d = [F.lit(k + 0.0) - (k + 1) * y * F.col(f"t{k + 1}") / F.nullif(F.col(f"t{k}"), F.lit(0.0)) for k in (1, 2, 3)]
    ok = lambda x, k: F.coalesce(F.when((x > 0) & (x < k), x), F.lit(k / 2.0))
    return counts.select("lang", *[ok(x, k).alias(f"d{k}") for k, x in enumerate(d, 1)])


def _cut(types: DataFrame, most: int) -> int:
    """The least count of n-grams at which at most ``most`` of them have it; 1 if that is all of them."""
    per = types.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n"))
    left = most
    for r in per.toLocalIterator():  # one row a count, from the top: at most ``most`` of them are looked at
        if r["k"] > left:
            return r["n"] + 1
        left -= r["k"]
    return 1


class KneserNey:
    """A model as sorted arrays of 64-bit keys with their values; what the arrays lack is backed off.

    For words (1), pairs (2) and triples (3): the discounted counts of the kept
    ones; for contexts of one (2) and two (3) words: the total of their counts
    and the mass that is left for backing off. Keys that coincide are an error
    when a model is made; an n-gram that it lacks is taken for another with a
    probability of (number of keys) / 2**64.

    Where the arrays don't hold every n-gram, ``tables`` has the whole model by
    order (see ``_tables``) and ``known`` the keys and log probabilities, under
    the whole model, of the triples in the arrays; ``perplexities`` goes by
    these. ``log_probabilities`` is of the arrays alone.
    """

    def __init__(self, counts: dict[int, tuple], contexts: dict[int, tuple], langs: dict[str, tuple[float, float, float]], known: tuple | None = None, tables: dict[int, tuple[DataFrame, DataFrame]] | None = None):
        self.counts, self.contexts, self.langs = counts, contexts, langs
        self.known, self.tables = known, tables

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)

    def log_probabilities(self, lang: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Of each word c after a and b; ``base``: (total, mass left, number of words) of its language by row."""
        total, left, v = base.T
        p = self.find(*self.counts[1], _mixed(lang, c), 0.0) / total + left / v
        for order, context in ((2, (b,)), (3, (a, b))):
            keys, totals, lefts = self.contexts[order]
            at = _mixed(lang, *context)
            n = self.find(*self.counts[order], _mixed(lang, *context, c), 0.0)
            p = n / self.find(keys, totals, at, 1.0) + self.find(keys, lefts, at, 1.0) * p
        return np.log(p)


def kneser_ney(docs: DataFrame, *, text: str = "text", lang: str = "lang", keep: tuple[int, int, int] = KEEP) -> KneserNey:
    """The interpolated modified Kneser-Ney model of each language.

    Counts, continuation counts, discounts and totals are aggregations over all
    documents, combined before they are exchanged. Of each order at most
    ``keep`` n-grams are held in arrays, by a cut on the counts. If these are
    all, no n-gram is joined with another; else the probabilities of all of them
    are staged as tables, which last as other staged tables do.
    """
    t3 = stage(_trigrams(docs, text, lang), "trigrams")
    t2 = stage(t3.groupBy("lang", "b", "c").agg(F.count(F.lit(1)).alias("n")), "pairs")
    t1 = stage(t2.groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n")), "singles")
    counts, contexts, langs, levels, cuts = {}, {}, {}, {}, {}
    for order, types, names in ((1, t1, ["c"]), (2, t2, ["b", "c"]), (3, t3, ["a", "b", "c"])):
        d = _discounts(types).collect()  # one row a language
        cut = cuts[order] = _cut(types, keep[order - 1])
        by = F.create_map(*[F.lit(x) for r in d for x in (r["lang"], F.array(*[F.lit(r[f"d{k}"]) for k in (1, 2, 3)]))]) if d else F.create_map()
        less = types.withColumn("num", F.col("n") - F.element_at(F.element_at(by, F.col("lang")), F.least(F.col("n"), F.lit(3)).cast("int"))) if d else types.withColumn("num", F.lit(0.0))
        levels[order] = (less, names)
        kept = F.col("n") >= cut
        counts[order] = _arrays(less.where(kept).select("lang", *names, "num"), len(names), 1)
        sums = less.groupBy("lang", *names[:-1]).agg(F.sum("n").alias("total"), F.sum(F.when(kept, F.col("num"))).alias("held"), F.count(F.lit(1)).alias("v"))
        sums = sums.select("lang", *names[:-1], F.col("total").cast("double").alias("total"), (1 - F.coalesce("held", F.lit(0.0)) / F.col("total")).alias("left"), "held", "v")
        if order == 1:
            langs = {r["lang"]: (r["total"], r["left"], float(r["v"])) for r in sums.collect()}
        else:  # contexts without a kept n-gram leave all to the shorter ones, which is what a missing context means
            contexts[order] = _arrays(sums.where("held is not null").select("lang", *names[:-1], "total", "left"), len(names) - 1, 2)
    if max(cuts.values()) == 1:
        return KneserNey(counts, contexts, langs)
    tables = _tables(levels)
    keys, p = _arrays(tables[3][0].where(F.col("n") >= cuts[3]).select("lang", "a", "b", "c", "p"), 3, 1)
    return KneserNey(counts, contexts, langs, (keys, np.log(p)), tables)


def _tables(levels: dict[int, tuple[DataFrame, list[str]]]) -> dict[int, tuple[DataFrame, DataFrame]]:
    """By order: all n-grams with count and probability ``p``, and their contexts with the mass ``left`` for backing off and the number ``v`` of n-grams.

    A join brings together at most as many n-grams as there are words.
    """
    tables: dict[int, tuple[DataFrame, DataFrame]] = {}
    for order, (less, names) in levels.items():
        context = ["lang", *names[:-1]]
        sums = less.groupBy(*context).agg(F.sum("n").alias("total"), (F.sum(F.col("n") - F.col("num")) / F.sum("n")).alias("left"), F.count(F.lit(1)).alias("v"))
        sums = stage(sums, f"contexts{order}")
        rows = less.join(broadcast_if_small(sums), context)
        if order == 1:
            shorter = 1 / F.col("v")
        else:
            rows, shorter = rows.join(tables[order - 1][0].select("lang", *names[1:], F.col("p").alias("q")), ["lang", *names[1:]]), F.col("q")
        p = F.col("num") / F.col("total") + F.col("left") * shorter
        tables[order] = (stage(rows.select("lang", *names, "n", p.alias("p")), f"probabilities{order}"), sums)
    return tables


def _probabilities(wanted: DataFrame, names: list[str], tables: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``lang``, ``names`` and probability ``p`` of all n-grams of the model and all of ``wanted`` (distinct, of known languages)."""
    types, contexts = tables[len(names)]
    types = types.select("lang", *names, "p")
    lacks = stage(wanted.join(types, ["lang", *names], "left_anti"), "lacks")
    if lacks.isEmpty():
        return types
    if len(names) == 1:
        backed = lacks.join(broadcast_if_small(contexts), "lang").select("lang", *names, (F.col("left") / F.col("v")).alias("p"))
    else:
        shorter = _probabilities(lacks.select("lang", *names[1:]).distinct(), names[1:], tables).withColumnRenamed("p", "q")
        backed = lacks.join(shorter, ["lang", *names[1:]]).join(contexts.select("lang", *names[:-1], "left"), ["lang", *names[:-1]], "left")
        backed = backed.select("lang", *names, (F.coalesce("left", F.lit(1.0)) * F.col("q")).alias("p"))  # a missing context leaves all
    return types.unionByName(backed)


def _arrays(rows: DataFrame, n_words: int, n_values: int) -> tuple[np.ndarray, ...]:
    """Keys in order, and the values beside them. The rows are bounded by ``keep``."""
    table = rows.toArrow()
    cols = [c.to_numpy() for c in table.columns[1:]]
    names = table.column(0).combine_chunks().dictionary_encode()
    of = _hashes(names.dictionary.to_pylist())[names.indices.to_numpy()] if table.num_rows else np.zeros(0, np.uint64)
    keys = _mixed(of, *cols[:n_words])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if len(keys) and (keys[1:] == keys[:-1]).any():
        raise RuntimeError("two n-grams have one key; leave some out by a smaller keep")
    return (keys, *(c[order].astype(np.float64) for c in cols[n_words : n_words + n_values]))


def perplexities(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: KneserNey | None = None) -> DataFrame:
    """``doc_id, lang, n_words, perplexity`` of every document, one row per input row, under its language's model.

    Without ``model`` the documents' own is made. The end of a text counts as a
    word, so an empty text has a perplexity too; a language that the model does
    not know gives NULL. N-grams that the model lacks are backed off; a word it
    doesn't know at all gets what an n-gram never seen gets. One pass, no
    shuffle, if the model's arrays hold all of it; else the words at hand are
    scored in that pass, and the others, a row each, are joined with its tables.
    """
    require_columns(docs, [doc_id, text, lang])
    model = kneser_ney(docs, text=text, lang=lang) if model is None else model
    columns = [F.col(f"`{doc_id}`"), plain_language(F.col(f"`{lang}`")), F.col(f"`{text}`").cast("string")]
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("lang", T.StringType()), T.StructField("n_words", T.LongType())]
    if model.tables is not None:
        return _joined_perplexities(docs.select(*columns, F.monotonically_increasing_id()), fields, model)
    shared = docs.sparkSession.sparkContext.broadcast((model.counts, model.contexts, model.langs))  # plain values, bounded by KEEP
    schema = T.StructType([*fields, T.StructField("perplexity", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = KneserNey(*shared.value)
        for batch in portions(batches, 2):
            names = batch.column(1).to_pylist()
            sizes, known, per, places = _places(names, batch.column(2).to_pylist(), m.langs)
            res: list[float | None] = [None] * len(names)
            if len(known):
                base = np.array([m.langs[names[i]] for i in known])[per]
                sums = np.bincount(per, m.log_probabilities(*places, base), len(known))
                for i, s in zip(known, sums):
                    res[i] = float(np.exp(-s / sizes[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes - 1), pa.array(res, pa.float64())], names=schema.names)

    return docs.select(*columns).mapInArrow(score, schema)


def _places(names: list[str], bodies: list[str | None], langs: dict) -> tuple[np.ndarray, list[int], np.ndarray, tuple[np.ndarray, ...]]:
    """The words to score: how many every text has, the texts of known languages, and for each of their words its text among these, and the hashes of its language, the two words before, and itself."""
    seqs = [[_START, _START, *words(b), _END] for b in bodies]
    sizes = np.array([len(s) - 2 for s in seqs], np.int64)
    known = [i for i, n in enumerate(names) if n in langs]
    if not known:
        return sizes, known, np.zeros(0, np.int64), (np.zeros(0, np.uint64),) * 4
    w = _hashes([x for i in known for x in seqs[i]])
    ends = np.cumsum(sizes[known] + 2)
    # every place but the first two of each text is a word to score
    at = np.concatenate([np.arange(e - n, e) for e, n in zip(ends, sizes[known])])
    per = np.repeat(np.arange(len(known)), sizes[known])
    return sizes, known, per, (_hashes([names[i] for i in known])[per], w[at - 2], w[at - 1], w[at])


def _joined_perplexities(docs: DataFrame, fields: list[T.StructField], model: KneserNey) -> DataFrame:
    """Perplexities of ``docs`` (doc_id, lang, text, row number) under a model of which the arrays hold a part."""
    schema = T.StructType([*fields, T.StructField("log_p", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in ("row", "a", "b", "c")]])
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.langs))  # plain values, bounded by KEEP

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, logs), langs = shared.value
        for batch in portions(batches, 2):
            names = batch.column(1).to_pylist()
            sizes, known, per, places = _places(names, batch.column(2).to_pylist(), langs)
            p = KneserNey.find(keys, logs, _mixed(*places), np.nan)
            lacks = np.flatnonzero(np.isnan(p))
            p[lacks] = 0.0
            sums = np.full(len(names), np.nan)
            sums[known] = np.bincount(per, p, len(known))
            text = [batch.column(0), batch.column(1), pa.array(sizes - 1), pa.array(sums, from_pandas=True), batch.column(3), *[pa.nulls(len(names), pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays(text, names=schema.names)
            of = pa.array(np.array(known, np.int64)[per[lacks]])  # a row for each word that is not at hand
            rest = [pa.nulls(len(lacks), batch.column(0).type), batch.column(1).take(of), pa.nulls(len(lacks), pa.int64()), pa.nulls(len(lacks), pa.float64()), batch.column(3).take(of), *[pa.array(x[lacks].view(np.int64)) for x in places[1:]]]
            yield pa.RecordBatch.from_arrays(rest, names=schema.names)

    rows = stage(docs.mapInArrow(score, schema), "scored")
    names = ["a", "b", "c"]
    rest = rows.where("a is not null").select("row", "lang", *names)
    p = _probabilities(rest.select("lang", *names).distinct(), names, model.tables)
    # added up as decimals, whose sum has no order: equal texts have equal perplexities
    more = rest.join(p, ["lang", *names]).groupBy("row").agg(F.sum(F.log("p").cast("decimal(18,15)")).cast("double").alias("more"))
    total = F.col("log_p") + F.coalesce("more", F.lit(0.0))
    return rows.where("a is null").join(more, "row", "left").select("doc_id", "lang", "n_words", F.exp(-total / (F.col("n_words") + 1)).alias("perplexity"))


def perplexity_bands(scored: DataFrame, lower: float = 0.02, upper: float = 0.98) -> DataFrame:
    """``scored`` with its language's band and ``verdict``: ``low`` (too predictable), ``high``, or ``keep``.

    The bands are exact percentiles of the language's perplexities, by the
    distributed sort.
    """
    scored = stage(scored, "perplexity")
    spark = scored.sparkSession
    probs = spark.createDataFrame([(1, [lower, upper])], "spec_id int, probs array<double>")
    q = quantiles(quantile_states(scored, [(1, "perplexity", "lang")]), probs)
    bands = q.groupBy(F.col("grp").alias("lang")).agg(F.min("q").alias("lower"), F.max("q").alias("upper"))
    verdict = F.when(F.col("perplexity") < F.col("lower"), "low").when(F.col("perplexity") > F.col("upper"), "high").otherwise("keep")
    return scored.join(broadcast_if_small(bands), "lang").select("doc_id", "lang", "n_words", "perplexity", "lower", "upper", verdict.alias("verdict"))
