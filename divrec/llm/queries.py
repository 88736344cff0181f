"""Queries of the problems solved in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divrec.llm.contamination import clean_documents, leaks
from divrec.llm.frequent import frequency_table, frequent_items
from divrec.llm.mixing import mix_sources, unreachable
from divrec.llm.packing import latest_attempts, pack_items, pack_report
from divrec.llm.quantiles import first_deliveries, merge_states, quantile_states, quantiles
from divrec.llm.repetition import LANG3, perplexities, perplexity_bands, repeated_shares

#: Place of the vocabulary that sizes are measured with where tokens are asked for.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _census_states(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    specs = table(spark, sf_dir, "quantile_specs")
    calls = [(r["spec_id"], r["var_name"], r["by_name"]) for r in specs.select("spec_id", "var_name", "by_name").collect()]  # one row a call
    columns = sorted({c for _, v, b in calls for c in (v, b) if c})
    once = first_deliveries(table(spark, sf_dir, "census"), "rec_id", columns, ["load_day", "collected_at"])
    return quantile_states(once, calls, keep), specs


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and probs whose percentile lies above the limit."""
    states, specs = _census_states(spark, sf_dir)
    q = quantiles(states, specs)
    limits = specs.select("spec_id", F.explode(F.arrays_zip("probs", "limits")).alias("_l")).select("spec_id", F.col("_l.probs").alias("prob"), F.col("_l.limits").alias("limit"))
    over = q.join(F.broadcast(limits), ["spec_id", "prob"]).where(F.col("q") > F.col("limit"))  # limits: a few for each call
    return over.select("spec_id", "grp", F.round(F.col("prob") * 1000).cast("int").alias("prob_pm")).distinct()


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles of all days, from states kept for each load day and then combined."""
    daily, specs = _census_states(spark, sf_dir, ("load_day",))
    q = quantiles(merge_states(daily), specs, interpolate=True)
    return q.select("spec_id", "grp", F.round(F.col("prob") * 1000).cast("int").alias("prob_pm"), "n", F.round("q", 6).alias("q"))


def p1_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of each load day, from the same daily states."""
    daily, specs = _census_states(spark, sf_dir, ("load_day",))
    by_day = daily.withColumn("grp", F.concat_ws("@", F.col("grp"), F.col("load_day").cast("string"))).select("spec_id", "grp", "value", "n")
    half = specs.select("spec_id", F.array(F.lit(0.5)).alias("probs"))
    return quantiles(by_day, half).select("spec_id", F.substring_index("grp", "@", 1).alias("grp"), F.substring_index("grp", "@", -1).alias("load_day"), "n", "q")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of y that make up at least 0.5 % of the rows."""
    items = frequent_items(table(spark, sf_dir, "many_levels"), "y")
    return items.where(F.col("n") * 200 >= F.col("total")).select(F.col("item").alias("y"))


def p4_freq_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent values of y with exact counts, and whether their ranks are certain."""
    return frequency_table(table(spark, sf_dir, "many_levels"), "y", 10).select(F.col("item").alias("y"), "n", "total", "certain")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_items(latest_attempts(table(spark, sf_dir, "mr_files")), table(spark, sf_dir, "mr_jobs"), capacity="map_buff_size_bytes")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items larger than a block of their job: those of which the blocks hold a second piece."""
    return _packed(spark, sf_dir).where(F.col("pack").isNotNull() & (F.col("piece") >= 1)).select("job_id", "fp").distinct()


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, bytes and use of room per job."""
    r = pack_report(_packed(spark, sf_dir))
    return r.select("job_id", "packs", "pieces", "bytes", "largest", "capacity", F.round("used", 6).alias("used"))


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job what packing must hold to: all pieces and bytes, no block over its capacity, and the share of room used by all but a fiftieth."""
    r = pack_report(_packed(spark, sf_dir))
    least = F.ceil(F.col("bytes") / F.col("capacity"))
    return r.select("job_id", "pieces", "bytes", (F.col("largest") <= F.col("capacity")).alias("fits"), (F.col("packs") >= least).alias("enough"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding at least ten consecutive words of a test item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "eval_id").distinct()


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after leaked spans were cut out, with the verdict."""
    done = clean_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return done.where("verdict <> 'keep'").select("doc_id", "verdict", F.round("coverage", 6).alias("coverage"), "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that can't reach their target, sizes in words."""
    report, _ = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return unreachable(report)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and the shares really reached, sizes in tokens of a public vocabulary."""
    report, _ = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), tokenizer=TOKENIZER)
    return report.select(
        "mix_id", "source", "max_repeats", F.round("target_tokens", 2).alias("target_tokens"), F.round("target_share", 6).alias("target_share"),
        "size_tokens", "available_tokens", "saturated", F.round("actual_tokens", 2).alias("actual_tokens"), F.round("actual_share", 6).alias("actual_share"),
    )


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which at least 30 % of the words are repeated content."""
    shares = repeated_shares(table(spark, sf_dir, "documents"), parts=False)
    return shares.where((F.col("n_words") > 0) & (F.col("repeated_words") * 10 >= F.col("n_words") * 3)).select("doc_id").distinct()


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of repeated content of every document."""
    r = repeated_shares(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "repeated_words", *[F.round(c, 6).alias(c) for c in ("share", "sentence_share", "paragraph_share")])


def p9_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and repeated words of every document."""
    return repeated_shares(table(spark, sf_dir, "documents"), parts=False).select("doc_id", "n_words", "repeated_words")


def p9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under its language's model, and the verdict of the language's band."""
    r = perplexity_bands(perplexities(table(spark, sf_dir, "documents")))
    return r.select("doc_id", "lang", "n_words", *[F.round(c, 6).alias(c) for c in ("perplexity", "lower", "upper")], "verdict")


QUERIES = {
    q.__name__: q
    for q in (p1_found, p1_percentiles, p1_daily, p4_found, p4_freq_table, p5_found, p5_blocks, p5_totals, p7_found, p7_clean, p8_found, p8_mix, p9_found, p9_shares, p9_repeated_words, p9_perplexity)
}

_ONCE = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY load_day, collected_at) AS rn FROM census) WHERE rn = 1),
 v AS (SELECT 'fnlwgt' AS var_name, 'education' AS by_name, coalesce(education, 'NA') AS grp, fnlwgt AS value, load_day FROM d
  UNION ALL SELECT 'capgain', 'workclass', coalesce(workclass, 'NA'), capgain, load_day FROM d
  UNION ALL SELECT 'caploss', 'marital', coalesce(marital, 'NA'), caploss, load_day FROM d
  UNION ALL SELECT 'hoursperweek', 'relationship', coalesce(relationship, 'NA'), CAST(hoursperweek AS DOUBLE), load_day FROM d),
 s AS (SELECT q.spec_id, v.grp, v.value, v.load_day FROM v JOIN quantile_specs q USING (var_name, by_name) WHERE v.value IS NOT NULL AND NOT isnan(v.value)),
 r AS (SELECT *, row_number() OVER (PARTITION BY spec_id, grp ORDER BY value) AS pos, count(*) OVER (PARTITION BY spec_id, grp) AS n FROM s),
 p AS (SELECT DISTINCT spec_id, unnest(probs) AS prob, unnest(limits) AS lim FROM quantile_specs)"""

#: Letters and digits of full width and those they stand for.
_WIDE = [(0xFF10, "0", 10), (0xFF21, "A", 26), (0xFF41, "a", 26)]
_FROM, _TO = ("".join(chr((a if wide else ord(b)) + i) for a, b, n in _WIDE for i in range(n)) for wide in (True, False))


def _words_sql(text: str) -> str:
    """The words of a text for DuckDB; of the entities those that the tables hold."""
    t = f"regexp_replace({text}, '<[^<>]{{1,60}}>', ' ', 'g')"
    for entity, char in (("&nbsp;", "\u00a0"), ("&quot;", '"'), ("&#44;", ","), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{char}')"
    t = f"strip_accents(lower(replace(translate({t}, '{_FROM}', '{_TO}'), 'ß', 'ss')))"
    t = f"regexp_replace({t}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"
    return f"regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}]+')"


def _runs_sql(rows: str, key: str, n: int) -> str:
    """Every run of n words: key, place (from 1), run."""
    return f"SELECT {key}, i, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {rows} WHERE len(w) >= {n})"


_DOCS = f"d AS (SELECT doc_id, source, {_words_sql('text')} AS w FROM documents)"
_REPEATED = f"""{_DOCS}, r AS ({_runs_sql('d', 'doc_id', 6)}), a AS (SELECT doc_id, i, i > min(i) OVER (PARTITION BY doc_id, run) AS again FROM r),
 c AS (SELECT doc_id, count(DISTINCT p) AS repeated_words FROM (SELECT doc_id, unnest(range(i, i + 6)) AS p FROM a WHERE again) GROUP BY 1),
 s AS (SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(repeated_words, 0) AS repeated_words FROM d LEFT JOIN c USING (doc_id))"""



def _parts_sql(name: str, parts: str) -> str:
    """Words in parts of a text that are the same, as words, as an earlier part."""
    return f"""{name}_p AS (SELECT doc_id, i, {_words_sql('parts[i]')} AS w FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, {parts} AS parts FROM documents WHERE text IS NOT NULL))),
 {name}_a AS (SELECT doc_id, len(w) AS n, i > min(i) OVER (PARTITION BY doc_id, array_to_string(w, ' ')) AS again FROM {name}_p WHERE len(w) > 0), {name} AS (SELECT doc_id, sum(n) AS n FROM {name}_a WHERE again GROUP BY 1)"""


def _level_sql(order: int, types: str, context: str) -> str:
    """Discounts of an order of n-grams, and their discounted counts with totals and freed mass of their context."""
    y = "(t1 / nullif(t1 + 2 * t2, 0))"
    d = [f"{k} - {k + 1} * {y} * t{k + 1} / nullif(t{k}, 0)" for k in (1, 2, 3)]
    counts = ", ".join(f"CAST(count(*) FILTER (n = {k}) AS DOUBLE) AS t{k}" for k in (1, 2, 3, 4))
    ok = ", ".join(f"coalesce(CASE WHEN {x} > 0 AND {x} < {k} THEN {x} END, {k / 2}) AS d{k}" for k, x in enumerate(d, 1))
    return f"""e{order} AS (SELECT lang, {ok} FROM (SELECT lang, {counts} FROM {types} GROUP BY 1)),
 l{order} AS (SELECT *, sum(n) OVER x AS total, sum(dn) OVER x AS freed, count(*) OVER x AS v FROM (SELECT {types}.*, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS dn FROM {types} JOIN e{order} USING (lang)) WINDOW x AS (PARTITION BY {context}))"""


_LANG = "coalesce(nullif(CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LANG3.items()) + " ELSE x END, ''), 'und')"
_KNESER_NEY = f"""d AS (SELECT doc_id, {_LANG} AS lang, list_concat(['^ ', '^ '], coalesce(w, []), ['$ ']) AS w FROM (SELECT doc_id, lower(regexp_extract(trim(lang), '^([A-Za-z]+)', 1)) AS x, {_words_sql('text')} AS w FROM documents)),
 g AS (SELECT doc_id, lang, w[i - 2] AS a, w[i - 1] AS b, w[i] AS c FROM (SELECT *, unnest(range(3, len(w) + 1)) AS i FROM d)),
 t3 AS (SELECT lang, a, b, c, count(*) AS n FROM g GROUP BY ALL), t2 AS (SELECT lang, b, c, count(*) AS n FROM t3 GROUP BY ALL), t1 AS (SELECT lang, c, count(*) AS n FROM t2 GROUP BY ALL),
 {_level_sql(1, 't1', 'lang')}, {_level_sql(2, 't2', 'lang, b')}, {_level_sql(3, 't3', 'lang, a, b')},
 p1 AS (SELECT lang, c, (n - dn + freed / v) / total AS p FROM l1), p2 AS (SELECT l2.lang, l2.b, l2.c, (n - dn + freed * p1.p) / total AS p FROM l2 JOIN p1 ON l2.lang = p1.lang AND l2.c = p1.c),
 p3 AS (SELECT l3.lang, l3.a, l3.b, l3.c, (n - dn + freed * p2.p) / total AS p FROM l3 JOIN p2 ON l3.lang = p2.lang AND l3.b = p2.b AND l3.c = p2.c),
 s AS (SELECT doc_id, g.lang, count(*) - 1 AS n_words, exp(-avg(ln(p))) AS perplexity FROM g JOIN p3 ON g.lang = p3.lang AND g.a = p3.a AND g.b = p3.b AND g.c = p3.c GROUP BY 1, 2)"""

ORACLES = {
    "p9_perplexity": f"""WITH {_KNESER_NEY}, r AS (SELECT lang, perplexity, row_number() OVER (PARTITION BY lang ORDER BY perplexity) AS k, count(*) OVER (PARTITION BY lang) AS n FROM s),
 b AS (SELECT lang, max(CASE WHEN k = greatest(1, ceil(0.02 * n)) THEN perplexity END) AS lower, max(CASE WHEN k = greatest(1, ceil(0.98 * n)) THEN perplexity END) AS upper FROM r GROUP BY 1)
 SELECT doc_id, lang, n_words, round(perplexity, 6) AS perplexity, round(lower, 6) AS lower, round(upper, 6) AS upper, CASE WHEN perplexity < lower THEN 'low' WHEN perplexity > upper THEN 'high' ELSE 'keep' END AS verdict FROM s JOIN b USING (lang)""",
    "p9_shares": f"""WITH {_REPEATED}, {_parts_sql('sen', "string_split(translate(text, '!?', '..'), '.')")}, {_parts_sql('par', "string_split(text, chr(10))")}
 SELECT s.doc_id, n_words, repeated_words, round(coalesce(repeated_words / nullif(n_words, 0), 0), 6) AS share, round(coalesce(sen.n / nullif(n_words, 0), 0), 6) AS sentence_share,
  round(coalesce(par.n / nullif(n_words, 0), 0), 6) AS paragraph_share FROM s LEFT JOIN sen USING (doc_id) LEFT JOIN par USING (doc_id)""",
    "p5_totals": """WITH b AS (SELECT *, sz * CASE WHEN sz_unit = 'KiB' THEN 1024 ELSE 1 END AS bytes FROM mr_files),
 l AS (SELECT *, row_number() OVER (PARTITION BY job_id, fp ORDER BY attempt DESC, written_at DESC, bytes DESC) AS rn FROM b)
 SELECT l.job_id, CAST(sum(greatest(1, (l.bytes + j.map_buff_size_bytes - 1) // j.map_buff_size_bytes)) AS BIGINT) AS pieces, CAST(sum(l.bytes) AS BIGINT) AS bytes, true AS fits, true AS enough
 FROM l JOIN mr_jobs j USING (job_id) WHERE rn = 1 AND l.bytes >= 0 AND j.map_buff_size_bytes > 0 GROUP BY 1""",
    "p7_found": f"""WITH {_DOCS}, e AS (SELECT eval_id, {_words_sql('text')} AS w FROM eval_items), x AS ({_runs_sql('d', 'doc_id', 10)}), y AS ({_runs_sql('e', 'eval_id', 10)})
 SELECT DISTINCT doc_id, eval_id FROM x JOIN y USING (run)""",
    "p8_found": f"""WITH {_DOCS}, z AS (SELECT nullif(lower(trim(source)), '') AS source, sum(coalesce(len(w), 0)) AS n FROM d GROUP BY 1),
 t AS (SELECT mix_id, lower(trim(source)) AS source, max(budget_ratio) AS ratio, sum(target_weight) AS weight, min(max_repeats) AS cap FROM mix_targets WHERE target_weight > 0 AND budget_ratio > 0 AND trim(source) <> '' GROUP BY 1, 2),
 u AS (SELECT *, weight / sum(weight) OVER (PARTITION BY mix_id) * ratio * (SELECT sum(n) FROM z) AS target FROM t)
 SELECT u.mix_id, u.source FROM u LEFT JOIN z USING (source) WHERE cap IS NOT NULL AND coalesce(n, 0) * cap < target""",
    "p9_found": f"WITH {_REPEATED} SELECT doc_id FROM s WHERE n_words > 0 AND repeated_words * 10 >= n_words * 3",
    "p9_repeated_words": f"WITH {_REPEATED} SELECT * FROM s",
    "p1_found": f"""WITH {_ONCE} SELECT DISTINCT r.spec_id, r.grp, CAST(round(p.prob * 1000) AS INTEGER) AS prob_pm FROM r JOIN p ON r.spec_id = p.spec_id
 AND r.pos = greatest(1, ceil(CAST(CAST(p.prob AS VARCHAR) AS DECIMAL(18, 17)) * r.n)) WHERE r.value > p.lim""",
    "p1_percentiles": f"""WITH {_ONCE}, u AS (SELECT DISTINCT spec_id, prob FROM p),
 t AS (SELECT DISTINCT r.spec_id, r.grp, r.n, u.prob, CAST(CAST(u.prob AS VARCHAR) AS DECIMAL(18, 17)) * (r.n - 1) AS place FROM r JOIN u USING (spec_id)),
 f AS (SELECT *, CAST(floor(place) AS BIGINT) + 1 AS lo FROM t),
 e AS (SELECT t.*, a.value AS a, b.value AS b, CAST(place - floor(place) AS DOUBLE) AS w FROM f t
  JOIN r a ON a.spec_id = t.spec_id AND a.grp = t.grp AND a.pos = t.lo JOIN r b ON b.spec_id = t.spec_id AND b.grp = t.grp AND b.pos = least(t.lo + 1, t.n))
 SELECT spec_id, grp, CAST(round(prob * 1000) AS INTEGER) AS prob_pm, n, round(CASE WHEN w = 0 OR a = b THEN a ELSE a + w * (b - a) END, 6) AS q FROM e""",
    "p1_daily": f"""WITH {_ONCE} SELECT spec_id, grp, CAST(load_day AS VARCHAR) AS load_day, count(*) AS n, quantile_disc(value, 0.5) AS q FROM s GROUP BY ALL""",
    "p4_found": """SELECT y FROM many_levels WHERE y IS NOT NULL GROUP BY y HAVING count(*) * 200 >= (SELECT count(y) FROM many_levels)""",
    "p4_freq_table": """SELECT y, count(*) AS n, (SELECT count(y) FROM many_levels) AS total, count(*) * 2048 > (SELECT count(y) FROM many_levels) AS certain FROM many_levels WHERE y IS NOT NULL GROUP BY y ORDER BY n DESC, y LIMIT 10""",
    "p5_found": """WITH b AS (SELECT *, sz * CASE WHEN sz_unit = 'KiB' THEN 1024 ELSE 1 END AS bytes FROM mr_files),
 l AS (SELECT *, row_number() OVER (PARTITION BY job_id, fp ORDER BY attempt DESC, written_at DESC, bytes DESC) AS rn FROM b)
 SELECT l.job_id, l.fp FROM l JOIN mr_jobs j USING (job_id) WHERE rn = 1 AND l.bytes > j.map_buff_size_bytes""",
}
