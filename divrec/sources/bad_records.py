"""Separating text records that fail to parse from those that load.

Every line is read permissively under an explicit schema (all columns of its
format as text, plus the raw text of corrupt lines) inside the JVM. Lines the
permissive reader refuses, and lines it can't be trusted with (quote marks,
line breaks, lines of LONG characters or more), are classified again by
quoting, column count and casts. All rows pass the Arrow exchange with Python,
in which a line that needs no second look is a NULL; reading the input twice
would cost more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divrec.operators.scan import row_numbers
from divrec.runtime import fresh, require_columns

#: Formats are turned into column expressions, so there must be few of them.
MAX_FORMATS = 1000
INT_MAX = 2147483647
#: Lines of so many characters are split exactly instead of by the permissive reader, whose columns are limited: shorter ones have fewer.
LONG = 100_000
LOGICALS = ("TRUE", "FALSE", "T", "F", "true", "false")
MISSING = ("", "NA")


_NUMBER = r"^(?:[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|NaN|Inf|-Inf)$"
_CLASSES = {"numeric", "integer", "character", "logical", "Date", "POSIXct"}


def _bare(field: Column) -> Column:
    return F.btrim(field, F.lit(" \t\r\n"))  # linear in the length of the field, unlike a pattern


def value_fits(field: Column, kind: Column, dec: Column) -> Column:
    """Whether a field (bare of blanks around it, not NULL) is missing or fits its class; never NULL for a known class."""
    v = field
    digits = F.regexp_replace(v, r"^[+-]?0*", "")
    foreign = (dec != ".") & F.contains(v, F.lit("."))
    number = ~foreign & F.replace(v, dec, F.lit(".")).rlike(_NUMBER)
    integer = v.rlike(r"^[+-]?[0-9]+$") & (F.length(digits) <= 10) & (F.coalesce(digits.try_cast("bigint"), F.lit(0)) <= INT_MAX)
    day = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & v.try_cast("date").isNotNull()
    time = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} (?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$") & v.try_cast("timestamp_ntz").isNotNull()
    fits = (
        F.when(kind == "numeric", number).when(kind == "integer", integer).when(kind == "logical", v.isin(*LOGICALS)).when(kind == "Date", day).when(kind == "POSIXct", time)
    )
    return (kind == "character") | v.isin(*MISSING) | F.coalesce(fits, F.lit(False))


def split_record(line: str, sep: str, quote: str) -> tuple[list[str], bool]:
    """The fields of one record, and whether its quoting is sound.

    A field whose first character is the quote mark is quoted: doubled marks
    stand for one, and it ends at a single mark that a separator or the end
    must follow. A mark later in an unquoted field is plain text. An empty
    separator is any run of blanks and tabs; such a line comes stripped. After
    unsound quoting the rest of the line is not looked at.
    """
    fields, i, n = [], 0, len(line)
    while True:
        if quote and line.startswith(quote, i):
            parts, i = [], i + len(quote)
            while True:
                j = line.find(quote, i)
                if j < 0:
                    return fields, False
                parts.append(line[i:j])
                i = j + len(quote)
                if not line.startswith(quote, i):
                    break
                parts.append(quote)
                i += len(quote)
            fields.append("".join(parts))
            if i < n and not (line.startswith(sep, i) if sep else line[i] in " \t"):
                return fields, False
        elif sep:
            j = line.find(sep, i)
            j = n if j < 0 else j
            fields.append(line[i:j])
            i = j
        else:
            j = i
            while j < n and line[j] not in " \t":
                j += 1
            fields.append(line[i:j])
            i = j
        if i >= n:
            return fields, True
        if sep:
            i += len(sep)
        else:
            while i < n and line[i] in " \t":
                i += 1


def _resplit_columns(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for seps, quotes, lines in columns:
        out, sound = [], []
        for a, q, line in zip(seps.to_pylist(), quotes.to_pylist(), lines.to_pylist()):
            fields, ok = (None, None) if line is None else split_record(line, a or "", q or "")
            out.append(fields)
            sound.append(ok)
        yield pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array(sound, pa.bool_())], names=["fields", "sound"])


def classify_records(lines: DataFrame, formats: DataFrame, *, line: str = "raw_line", fmt: str = "format_id") -> DataFrame:
    """``lines`` without what is no record, with ``fields`` (array of text) and ``reason``.

    ``formats`` has one row per format: ``format_id, sep, dec_mark, quote_mark,
    header_line, colnames, colclasses``. ``reason`` is NULL for a record that
    fits its format, else the first that holds of ``quoting``, ``columns``,
    ``value``; ``format`` where no format is known. NULL, blank and header
    lines are no records. One carriage return at the end doesn't count.
    If ``lines`` already has columns called ``fields`` or ``reason``, the new
    ones get underscores appended. No row is dropped or capped; an empty table
    gives an empty result; a very long line is one value of one task.
    """
    require_columns(lines, [line, fmt])
    specs = formats.limit(MAX_FORMATS + 1).collect()
    if len(specs) > MAX_FORMATS:
        raise ValueError(f"more than {MAX_FORMATS} formats")
    if unknown := {k for s in specs for k in s["colclasses"]} - _CLASSES:
        raise ValueError(f"no such column class: {', '.join(sorted(unknown))}")
    c_fields, c_reason, f = fresh(lines, "fields"), fresh(lines, "reason"), fresh(lines, "_f")
    # The permissive reader's parsers, one for each shape of format, by number; -1: blanks, -2: none can be trusted.
    shapes: dict[tuple, int] = {}

    def parser(s) -> int:
        sep, quote = s["sep"] or "", s["quote_mark"] or ""
        return -1 if not sep else shapes.setdefault((sep, quote, len(s["colclasses"])), len(shapes)) if len(sep) == 1 and len(quote) < 2 else -2

    known = [(s["format_id"], s["sep"] or "", s["dec_mark"] or ".", s["quote_mark"] or "", s["header_line"], list(s["colclasses"]), parser(s)) for s in specs]
    kind_of_id = formats.schema["format_id"].dataType.simpleString()
    table = lines.sparkSession.createDataFrame(known, f"id {kind_of_id}, sep string, dec string, quote string, head string, kinds array<string>, parser int")
    spec = table.select(F.struct(*table.columns).alias(f))
    rows = lines.join(F.broadcast(spec), F.col(f"`{fmt}`") == F.col(f)["id"], "left")  # at most MAX_FORMATS rows
    of = lambda name: F.col(f)[name]
    given = F.col(f"`{line}`")
    raw = F.when(F.endswith(given, F.lit("\r")), F.left(given, F.length(given) - 1)).otherwise(given)
    stripped = F.btrim(raw, F.lit(" \t"))
    blanks = F.coalesce(of("parser") == -1, F.lit(False))  # then blanks and tabs at either end don't count
    header = (raw == of("head")) | (blanks & (stripped == F.trim(of("head"))))
    rows = rows.where(given.isNotNull() & (F.btrim(raw, F.lit(" \t\n\x0b\f\r")) != "") & ~F.coalesce(header, F.lit(False)))

    # Step 1: the permissive read. The columns as text, and whether the reader refuses the line.
    rows = rows.withColumn(f"{f}x", _once(F.when(blanks, stripped).otherwise(raw)))
    text = F.col(f"{f}x")
    strange = F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\n")) | F.contains(text, F.lit("\x00")) | ((of("quote") != "") & F.contains(text, of("quote")))
    n_cols = F.size(of("kinds"))
    parts = F.split(text, r"[ \t]+", -1)
    perm = F.when(blanks, F.struct(parts.alias("fields"), (F.size(parts) != n_cols).alias("corrupt")))
    for (sep, quote, n), number in shapes.items():
        schema = ", ".join([*(f"c{i} string" for i in range(n)), "_corrupt string"])
        parsed = F.from_csv(text, schema, {
            "sep": sep, "quote": quote or "\u0000", "escape": quote or "\u0000", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
            "maxColumns": str(LONG), "nullValue": "\u0001", "emptyValue": "",
        })
        read = F.struct(F.array(*[parsed[f"c{i}"] for i in range(n)]).alias("fields"), parsed["_corrupt"].isNotNull().alias("corrupt"))
        perm = perm.when(of("parser") == number, read)
    plain = of("parser") >= -1
    doubtful = F.coalesce(strange | ~plain | (F.length(text) >= LONG), F.lit(False))
    rows = rows.withColumn(f"{f}d", _once(doubtful))
    rows = rows.withColumns({f"{f}p": F.when(~F.col(f"{f}d"), perm), f"{f}t": F.when(F.col(f"{f}d"), text)})

    # Step 2: lines the reader can't be trusted with are split again, exactly.
    kind = T.StructType([T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("sound", T.BooleanType())])
    rows = rows.withColumn(f"{f}a", F.arrow_udf(_resplit_columns, kind)(*[F.when(F.col(f"{f}d"), of(c)) for c in ("sep", "quote")], F.col(f"{f}t")))

    # Step 3: the reasons, in order.
    again, read = F.col(f"{f}a"), F.col(f"{f}p")
    rows = rows.withColumn(c_fields, F.coalesce(again["fields"], read["fields"]))
    fields = F.col(f"`{c_fields}`")
    bare = F.transform(fields, lambda v: _bare(F.coalesce(v, F.lit(""))))
    fit = F.forall(F.zip_with(bare, of("kinds"), lambda v, k: value_fits(v, k, of("dec"))), lambda ok: ok)
    reason = (
        F.when(F.col(f).isNull(), "format")
        .when(~F.coalesce(again["sound"], F.lit(True)), "quoting")
        .when(F.coalesce(read["corrupt"], F.size(fields) != n_cols), "columns")
        .when(~fit, "value")
    )
    return rows.withColumn(c_reason, _once(reason)).drop(f, *[f"{f}{x}" for x in "xdpta"])


def _once(column: Column) -> Column:
    """The column, computed once: the condition always holds, but Catalyst doesn't know it and so copies the expression nowhere."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


_SPARK_TYPES = {"numeric": "double", "integer": "int", "character": "string", "logical": "boolean", "Date": "date", "POSIXct": "timestamp_ntz"}


def typed_value(field: Column, kind: str, dec: str) -> Column:
    v = _bare(field)
    v = F.when(~v.isin(*MISSING), v)
    if kind == "character":
        return v
    if kind == "numeric":
        plain = F.replace(v, F.lit(dec or "."), F.lit("."))
        plain = F.when(v == "Inf", "Infinity").when(v == "-Inf", "-Infinity").otherwise(plain)
        return plain.try_cast("double")
    if kind == "logical":
        return F.when(v.isin("TRUE", "T", "true"), True).when(v.isin("FALSE", "F", "false"), False)
    return v.try_cast(_SPARK_TYPES[kind])


def number_blocks(valid: DataFrame, formats: DataFrame, *, fmt: str = "format_id", order=("file_name", "line_no", "line_id")) -> DataFrame:
    """Valid records with ``block``: running number from 1 per format, ``rowsperblock`` records each, in file order.

    Without the row limit of a format (NULL or below 1) all its records are block 1.
    """
    numbered = row_numbers(valid, [fmt], list(order), "_row")
    size = F.broadcast(formats.select(F.col("format_id").alias("_fid"), F.col("rowsperblock").alias("_per")))  # at most MAX_FORMATS rows
    block = F.when(F.col("_per") >= 1, F.floor((F.col("_row") - 1) / F.col("_per")) + 1).otherwise(1).cast("bigint")
    return numbered.join(size, F.col(fmt) == F.col("_fid"), "left").withColumn("block", block).drop("_fid", "_per", "_row")


def load_typed(valid: DataFrame, spec, *, keep=("line_id", "block")) -> DataFrame:
    """The records of one format (a row of ``formats``) as typed columns, named by ``colnames``.

    ``keep`` columns come first, where the input has them; a format's column of
    the same name gets underscores appended.
    """
    rows = valid.where(F.col("format_id").eqNullSafe(F.lit(spec["format_id"])))
    out, taken = [], set()
    for c in keep:
        if c in valid.columns:
            out.append(F.col(f"`{c}`"))
            taken.add(c.lower())
    for i, (name, kind) in enumerate(zip(spec["colnames"], spec["colclasses"])):
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(typed_value(F.get(F.col("fields"), F.lit(i)), kind, spec["dec_mark"]).alias(name))
    return rows.select(*out)


def reject_brute_force(rows: list[dict], specs: list[dict]) -> dict:
    """Reason per line id, by plain Python: the small reference that tests compare with."""
    import datetime as dt

    by = {s["format_id"]: s for s in specs}
    out = {}
    for r in rows:
        s, raw = by[r["format_id"]], r["raw_line"]
        if raw is None:
            continue
        raw = raw.removesuffix("\r")
        text = raw.strip(" \t") if not s["sep"] else raw
        if not raw.strip() or raw == s["header_line"] or (not s["sep"] and text == (s["header_line"] or "").strip()):
            continue
        fields, ok = split_record(text, s["sep"], s["quote_mark"])
        reason = None if ok else "quoting"
        if not reason and len(fields) != len(s["colclasses"]):
            reason = "columns"
        if not reason:
            for f, k in zip(fields, s["colclasses"]):
                v = f.strip(" \t\r\n")
                if v in MISSING or k == "character":
                    continue
                good = True
                if k == "numeric":
                    good = (s["dec_mark"] == "." or "." not in v) and re.match(_NUMBER, v.replace(s["dec_mark"], ".")) is not None
                elif k == "integer":
                    good = re.fullmatch(r"[+-]?[0-9]+", v) is not None and abs(int(v)) <= INT_MAX
                elif k == "logical":
                    good = v in LOGICALS
                elif re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + (" [0-9]{2}:[0-9]{2}:[0-9]{2}" if k == "POSIXct" else ""), v):
                    try:
                        dt.datetime.fromisoformat(v)
                    except ValueError:
                        good = False
                else:
                    good = False
                if not good:
                    reason = "value"
                    break
        out[r["line_id"]] = reason
    return out


def formats_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/text_formats.parquet")
