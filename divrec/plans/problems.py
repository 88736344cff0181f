"""Queries of the general data problems (skewed keys, small files, records that fail to parse)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divrec.operators.compaction import TARGET_BYTES, compact_dataset, plan_compaction
from divrec.operators.skew import eager_join_aggregate, key_shares, key_states, row_distribution
from divrec.plans.common import table
from divrec.runtime import shared_dir
from divrec.sources.bad_records import classify_records, number_blocks

CENSUS_KEYS = {"div_key": "div_key", "enum_id": "enum_id"}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys held by at least 1 % of all stored rows."""
    shares = key_shares(table(spark, sf_dir, "census"), CENSUS_KEYS)
    return shares.where(F.col("n_row") * 100 >= F.col("n_all")).select("key_column", "key_value")


def p2_key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results for every key, hot or not: rows, ages and hours."""
    s = key_states(table(spark, sf_dir, "census"), CENSUS_KEYS, ["age", "hoursperweek"])
    return s.select("key_column", "key_value", "n", "n_age", "sum_age", "n_hoursperweek", "sum_hoursperweek", "min_hoursperweek", "max_hoursperweek")


def p2_row_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nRow and splitRowDistn as they are now beside those recorded on the earlier load."""
    census, attrs = table(spark, sf_dir, "census"), table(spark, sf_dir, "div_attrs")
    now = row_distribution(key_states(census, CENSUS_KEYS))
    was = attrs.select("key_column", F.col("nrow").alias("recorded_nrow"), F.col("ndiv").alias("recorded_ndiv"))
    long = now.select("key_column", "nrow", "ndiv", F.posexplode("splitrowdistn").alias("pct", "n_rows"))
    return long.join(was, "key_column").select(
        "key_column", "nrow", "ndiv", "recorded_nrow", "recorded_ndiv", F.col("pct").cast("int").alias("pct"), F.round("n_rows", 4).alias("n_rows")
    )


def p2_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census joined with itself on the enumerator, per division: rows and sums of a join that is never built."""
    census = table(spark, sf_dir, "census")
    res = eager_join_aggregate(
        census, census, ["enum_id"], left_sums=["age"], right_sums=["hoursperweek"], products=[("educationnum", "incomebin")], left_groups=["div_key"]
    )
    return res.select("div_key", "n_rows", "sum_age", "sum_hoursperweek", "sum_educationnum_incomebin")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections with at least 50 live data files of less than 1 MiB on average."""
    plan = plan_compaction(table(spark, sf_dir, "conns"), table(spark, sf_dir, "conn_files"))
    return plan.where((F.col("nfile") >= 50) & (F.col("mean_size") < 1 << 20)).select("conn_id")


def p3_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compaction plan of every connection."""
    return plan_compaction(table(spark, sf_dir, "conns"), table(spark, sf_dir, "conn_files")).withColumn("mean_size", F.round("mean_size", 4))


def p3_compact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file listings written as tiny files, consolidated, and counted again by backend of their location."""
    import uuid

    base = f"{shared_dir(spark)}/compact-{uuid.uuid4().hex}"
    table(spark, sf_dir, "conn_files").repartition(64).write.parquet(f"{base}/small")
    done = compact_dataset(spark, f"{base}/small", f"{base}/large")
    if done["out_nfile"] >= done["nfile"]:
        raise RuntimeError(f"nothing was consolidated: {done}")
    rows = spark.read.parquet(f"{base}/large")
    return rows.groupBy("removed").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.sum("n_pairs").cast("bigint").alias("pairs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that fail to parse, with the first reason."""
    rows = classify_records(table(spark, sf_dir, "text_lines"), table(spark, sf_dir, "text_formats"))
    return rows.where(F.col("reason").isin("quoting", "columns", "value")).select("line_id", "reason")


def p6_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the records that load."""
    formats = table(spark, sf_dir, "text_formats")
    rows = classify_records(table(spark, sf_dir, "text_lines"), formats)
    blocks = number_blocks(rows.where(F.col("reason").isNull()).select("line_id", "file_name", "line_no", "format_id"), formats)
    return blocks.groupBy("format_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first_line"), F.max("line_id").alias("last_line"))


QUERIES = {
    q.__name__: q for q in (p2_found, p2_key_results, p2_row_distribution, p2_key_join, p3_found, p3_plan, p3_compact_roundtrip, p6_found, p6_blocks)
}

_KEYS = """k AS (SELECT 'div_key' AS key_column, coalesce(div_key, 'NA') AS key_value, age, hoursperweek FROM census
 UNION ALL SELECT 'enum_id', coalesce(CAST(enum_id AS VARCHAR), 'NA'), age, hoursperweek FROM census)"""

_LOC = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?', ''), "
    "'/+', '/', 'g'), '(/\\.)+(/|$)', '\\2', 'g'), '(.)/$', '\\1')"
)

_LIVE = f"""l AS (SELECT {_LOC.format('conn_loc')} AS loc, * FROM conn_files WHERE conn_loc IS NOT NULL AND file_name IS NOT NULL
   AND NOT regexp_matches(file_name, '(^|/)[_.]')),
 r AS (SELECT *, row_number() OVER (PARTITION BY loc, file_name ORDER BY listed_at DESC, listing_id DESC) AS rn FROM l),
 live AS (SELECT loc, file_name, size_bytes, CASE WHEN n_pairs > 0 THEN CAST(n_pairs AS BIGINT) ELSE 0 END AS len, n_pairs, first_pair FROM r WHERE rn = 1 AND NOT removed)"""

# Records by patterns of each format: a field is quoted, or holds no separator and does not begin with the mark; the line gets one more separator at its end.
_RECORDS = r"""f AS (SELECT *, CASE WHEN sep = '' THEN '[ \t]+' ELSE regexp_escape(sep) END AS s, CASE WHEN sep = '' THEN ' \t' ELSE regexp_escape(sep) END AS c, coalesce(quote_mark, '') AS qm FROM text_formats),
 g AS (SELECT *, CASE WHEN qm = '' THEN '[^' || c || ']*' ELSE qm || '(?:[^' || qm || ']|' || qm || qm || ')*' || qm || '|[^' || qm || c || '][^' || c || ']*' || CASE WHEN sep = '' THEN '' ELSE '|' END END AS field FROM f),
 l AS (SELECT line_id, file_name, line_no, format_id, CASE WHEN raw_line LIKE '%' || chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS raw FROM text_lines WHERE raw_line IS NOT NULL),
 m AS (SELECT l.*, g.* EXCLUDE (format_id), CASE WHEN sep = '' THEN trim(raw, chr(32) || chr(9)) ELSE raw END AS line FROM l JOIN g USING (format_id)),
 n AS (SELECT *, line || CASE WHEN sep = '' THEN ' ' ELSE sep END AS whole FROM m WHERE NOT regexp_full_match(raw, '\s*') AND raw <> coalesce(header_line, '') AND NOT (sep = '' AND line = trim(coalesce(header_line, '')))),
 o AS (SELECT *, regexp_full_match(whole, '(?:(?:' || field || ')' || s || ')+') AS sound, regexp_extract_all(whole, '(' || field || ')' || s, 1) AS fields FROM n),
 u AS (SELECT line_id, dec_mark, unnest(colclasses) AS kind, unnest(fields) AS raw, qm FROM o WHERE sound AND len(fields) = len(colclasses)),
 v AS (SELECT line_id, dec_mark, kind, trim(CASE WHEN qm <> '' AND starts_with(raw, qm) THEN replace(substr(raw, 2, length(raw) - 2), qm || qm, qm) ELSE raw END, chr(32) || chr(9) || chr(13) || chr(10)) AS x FROM u),
 w AS (SELECT line_id, bool_and(x IN ('', 'NA') OR CASE kind WHEN 'character' THEN true
   WHEN 'numeric' THEN NOT (dec_mark <> '.' AND contains(x, '.')) AND regexp_full_match(replace(x, dec_mark, '.'), '[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|NaN|Inf|-Inf')
   WHEN 'integer' THEN regexp_full_match(x, '[+-]?[0-9]+') AND coalesce(abs(TRY_CAST(x AS HUGEINT)) <= 2147483647, false) WHEN 'logical' THEN x IN ('TRUE', 'FALSE', 'T', 'F', 'true', 'false')
   WHEN 'Date' THEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(x AS DATE) IS NOT NULL
   WHEN 'POSIXct' THEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2} (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]') AND TRY_CAST(x AS TIMESTAMP) IS NOT NULL END) AS fit FROM v GROUP BY 1),
 rec AS (SELECT o.*, CASE WHEN NOT sound THEN 'quoting' WHEN len(fields) <> len(colclasses) THEN 'columns' WHEN NOT fit THEN 'value' END AS reason FROM o LEFT JOIN w USING (line_id))"""

ORACLES = {
    "p6_found": f"WITH {_RECORDS} SELECT line_id, reason FROM rec WHERE reason IS NOT NULL",
    "p6_blocks": f"""WITH {_RECORDS}, k AS (SELECT format_id, line_id, rowsperblock, row_number() OVER (PARTITION BY format_id ORDER BY file_name, line_no, line_id) AS rn FROM rec WHERE reason IS NULL)
 SELECT format_id, CASE WHEN rowsperblock >= 1 THEN CAST(floor((rn - 1) / rowsperblock) AS BIGINT) + 1 ELSE 1 END AS block, count(*) AS n, min(line_id) AS first_line, max(line_id) AS last_line FROM k GROUP BY 1, 2""",
    "p2_found": f"""WITH {_KEYS} SELECT key_column, key_value FROM k GROUP BY 1, 2
 HAVING count(*) * 100 >= (SELECT count(*) FROM census)""",
    "p2_key_results": f"""WITH {_KEYS} SELECT key_column, key_value, count(*) AS n, count(age) AS n_age, CAST(sum(age) AS DOUBLE) AS sum_age,
 count(hoursperweek) AS n_hoursperweek, CAST(sum(hoursperweek) AS DOUBLE) AS sum_hoursperweek,
 CAST(min(hoursperweek) AS DOUBLE) AS min_hoursperweek, CAST(max(hoursperweek) AS DOUBLE) AS max_hoursperweek FROM k GROUP BY 1, 2""",
    "p2_row_distribution": f"""WITH {_KEYS}, s AS (SELECT key_column, key_value, count(*) AS n FROM k GROUP BY 1, 2),
 d AS (SELECT key_column, CAST(sum(n) AS BIGINT) AS nrow, count(*) AS ndiv, quantile_cont(n, [{', '.join(str(i / 100) for i in range(101))}]) AS q FROM s GROUP BY 1),
 p AS (SELECT key_column, nrow, ndiv, unnest(q) AS n_rows, unnest(range(0, 101)) AS pct FROM d)
 SELECT p.key_column, p.nrow, p.ndiv, a.nrow AS recorded_nrow, a.ndiv AS recorded_ndiv, CAST(p.pct AS INTEGER) AS pct, round(CAST(p.n_rows AS DOUBLE), 4) AS n_rows
 FROM p JOIN div_attrs a USING (key_column)""",
    "p2_key_join": """SELECT a.div_key, count(*) AS n_rows, CAST(sum(a.age) AS DOUBLE) AS sum_age, CAST(sum(b.hoursperweek) AS DOUBLE) AS sum_hoursperweek,
 CAST(sum(a.educationnum * b.incomebin) AS DOUBLE) AS sum_educationnum_incomebin FROM census a JOIN census b ON a.enum_id = b.enum_id GROUP BY 1""",
    "p3_found": f"""WITH {_LIVE}, g AS (SELECT loc, count(*) AS n, avg(size_bytes) AS m FROM live GROUP BY 1)
 SELECT conn_id FROM conns c JOIN g ON {_LOC.format('c.loc')} = g.loc WHERE n >= 50 AND m < 1048576""",
    "p3_plan": f"""WITH {_LIVE}, e AS (SELECT *, CASE WHEN len > 0 THEN first_pair + len - 1 END AS last_pair FROM live),
 o AS (SELECT *, max(last_pair) OVER (PARTITION BY loc ORDER BY first_pair, len DESC, file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e),
 w AS (SELECT *, CASE WHEN len > 0 THEN greatest(last_pair - greatest(first_pair, coalesce(seen + 1, first_pair)) + 1, 0) ELSE 0 END AS own,
   greatest(first_pair, coalesce(seen + 1, first_pair)) AS own_first FROM o),
 b AS (SELECT loc, count(*) AS nfile, sum(size_bytes) AS totstoragesize, count(size_bytes) AS n_known, sum(own) AS n_pairs FROM w GROUP BY 1),
 p AS (SELECT *, CAST(round(CAST(size_bytes AS DOUBLE) * own / n_pairs) AS BIGINT) AS bytes FROM w WHERE own > 0),
 q AS (SELECT *, coalesce(bytes, 0) + 4096 AS cost FROM p),
 s AS (SELECT *, floor((sum(cost) OVER (PARTITION BY loc ORDER BY own_first, file_name ROWS UNBOUNDED PRECEDING) - cost) / {TARGET_BYTES}e0) AS out_file FROM q),
 f AS (SELECT loc, out_file, sum(bytes) AS b, sum(own) AS np FROM s GROUP BY 1, 2),
 a AS (SELECT loc, count(*) AS out_nfile, sum(b) AS out_totstoragesize, max(b) AS out_max, sum(np) AS copied_pairs FROM f GROUP BY 1)
 SELECT c.conn_id, {_LOC.format('c.loc')} AS loc, coalesce(b.nfile, 0) AS nfile, CAST(coalesce(b.totstoragesize, 0) AS BIGINT) AS totstoragesize, coalesce(b.n_known, 0) AS n_known,
  round(b.totstoragesize / CAST(nullif(b.n_known, 0) AS DOUBLE), 4) AS mean_size, CAST(coalesce(b.n_pairs, 0) AS BIGINT) AS n_pairs, CAST(coalesce(copied_pairs, 0) AS BIGINT) AS copied_pairs,
  coalesce(out_nfile, 0) AS out_nfile, CAST(coalesce(out_totstoragesize, 0) AS BIGINT) AS out_totstoragesize, CAST(coalesce(out_max, 0) AS BIGINT) AS out_max
 FROM conns c LEFT JOIN b ON {_LOC.format('c.loc')} = b.loc LEFT JOIN a ON b.loc = a.loc""",
    "p3_compact_roundtrip": """SELECT removed, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(n_pairs) AS BIGINT) AS pairs FROM conn_files GROUP BY 1""",
}
