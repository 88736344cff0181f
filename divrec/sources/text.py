"""Delimited and plain text as blocks of rows, read in parallel.

Lines are numbered without moving them: one pass counts the lines of every
split of every file, a small table of splits gets running offsets, and a second
pass adds a line's place in its split to its split's offset.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divrec.operators.division import KEY, Division, _frame, _freeze, kv_apply
from divrec.operators.scan import ordered_scan
from divrec.runtime import broadcast_if_small, stage
from divrec.sources.bad_records import split_record

ROWS_PER_BLOCK, LINES_PER_BLOCK, HEAD_LINES = 50_000, 10_000, 1000

#: Splits of files whose places are broadcast; of more, lines with quoted line ends among them are joined with their split's place.
MAX_SPLITS = 100_000

_SPLIT = ["_path", "_at"]


def _in_order(df: DataFrame) -> DataFrame:
    """Lines with their split (file and where in it the split starts); in a task, the lines of a split come in order."""
    return df.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"))


def _on_split(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``lines`` with the columns of their split's row."""
    side = splits.withColumnsRenamed({"_path": "_sp", "_at": "_sa"})
    return lines.join(broadcast_if_small(side), (F.col("_path") == F.col("_sp")) & (F.col("_at") == F.col("_sa"))).drop("_sp", "_sa")


def _line_end(line: str, inside: bool, sep: str, quote: str, comment: str) -> tuple[bool, int]:
    """Whether a quoted field is open after a line that begins ``inside`` one or not, and where a comment begins (-1: none)."""
    i = 0
    while True:
        if inside:
            j = line.find(quote, i)
            if j < 0:
                return True, -1
            i = j + len(quote)
            if line.startswith(quote, i):
                i += len(quote)
                continue
            inside = False
        else:
            if not sep:
                while i < len(line) and line[i] in " \t":
                    i += 1
            if quote and line.startswith(quote, i):
                inside, i = True, i + len(quote)
                continue
        c = line.find(comment, i) if comment else -1
        if sep:
            j = line.find(sep, i)
        else:
            found = _BLANK.search(line, i)
            j = found.start() if found else -1
        if c >= 0 and (j < 0 or c < j):
            return False, c
        if j < 0:
            return False, -1
        i = j + (len(sep) or 1)


_BLANK = re.compile(r"[ \t]")

_SURVEY = T.StructType(
    [T.StructField("_path", T.StringType()), T.StructField("_at", T.LongType()), T.StructField("first", T.LongType()), T.StructField("top", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("kept0", "kept1")]
    + [T.StructField(n, T.BooleanType()) for n in ("end0", "end1", "loud")]
    + [T.StructField("head", T.StringType())]
)


class _Lines:
    """How lines become records; travels to the executors."""

    def __init__(self, sep: str, quote: str, comment: str, skip: int, header: bool, blanks: bool):
        self.sep, self.quote, self.comment, self.skip, self.header, self.blanks = sep, quote, comment, skip, header, blanks
        self.bare = " " if sep else " \t"

    def kept(self, value: F.Column) -> F.Column:
        """Whether a line on its own is a record; the same test as in ``survey``."""
        return F.btrim(self.plain(value), F.lit(self.bare)) != "" if self.blanks else F.lit(True)

    def plain(self, value: F.Column) -> F.Column:
        return F.substring_index(value, self.comment, 1) if self.comment else value

    def survey(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per split: how many records begin in it and whether a quoted field is open at its end, if none (0) or one (1) was at its beginning.

        ``first``: the running number, in the task, of its first kept line; ``top``:
        kept lines among the first ones that the skipped lines and the header take.
        """
        from pyspark import TaskContext

        count, cur, rows = TaskContext.get().partitionId() << 33, None, []
        for batch in batches:
            paths, ats, values = batch.column(1), batch.column(2).to_pylist(), batch.column(0)
            names = paths.to_pylist()
            at = 0
            while at < len(ats):  # one turn for each split in the batch
                end = at + 1
                while end < len(ats) and ats[end] == ats[at] and names[end] == names[at]:
                    end += 1
                if cur is None or cur["_path"] != names[at] or cur["_at"] != ats[at]:
                    if cur is not None:
                        rows.append(cur)
                    cur = {"_path": names[at], "_at": ats[at], "first": count, "top": 0, "kept0": 0, "kept1": 0, "end0": False, "end1": True, "loud": False, "head": None, "n": 0}
                count += self._part(cur, values.slice(at, end - at))
                at = end
        if cur is not None:
            rows.append(cur)
        yield pa.RecordBatch.from_pylist([{k: v for k, v in r.items() if k != "n"} for r in rows], pa.schema([("_path", pa.string()), ("_at", pa.int64()), *[(n, pa.int64()) for n in ("first", "top", "kept0", "kept1")], *[(n, pa.bool_()) for n in ("end0", "end1", "loud")], ("head", pa.string())]))

    def _part(self, cur: dict, values: pa.Array) -> int:
        n = len(values)
        bare = values
        if self.comment:
            bare = pc.list_element(pc.split_pattern(values, self.comment, max_splits=1), 0)
        kept = pc.not_equal(pc.utf8_trim(bare, self.bare), "").to_numpy(zero_copy_only=False) if self.blanks else pc.is_valid(values).to_numpy(zero_copy_only=False)
        drop = max(0, self.skip + int(self.header) - cur["n"]) if cur["_at"] == 0 else 0
        drop = min(drop, n)
        if self.header and cur["_at"] == 0 and cur["n"] <= self.skip < cur["n"] + n:
            cur["head"] = values[self.skip - cur["n"]].as_py()
            if self.quote and _line_end(cur["head"], False, self.sep, self.quote, "")[0]:
                raise ValueError(f"the header of {cur['_path']} goes over several lines")
        cur["top"] += int(kept[:drop].sum())
        total = int(kept.sum())
        quoted = pc.match_substring(values, self.quote).to_numpy(zero_copy_only=False).nonzero()[0] if self.quote else []
        # Between lines with quote marks, every line is a record of its own, or none is.
        done = drop
        for i in quoted:
            if i < drop:
                continue
            free = int(kept[done:i].sum())
            cur["kept0"] += 0 if cur["end0"] else free
            cur["kept1"] += 0 if cur["end1"] else free
            line = values[int(i)].as_py()
            cur["kept0"] += int(not cur["end0"] and kept[i])
            cur["kept1"] += int(not cur["end1"] and kept[i])
            if self.comment and self.comment in line:
                cur["loud"] = True
            outside, within = _line_end(line, False, self.sep, self.quote, self.comment)[0], _line_end(line, True, self.sep, self.quote, self.comment)[0]
            cur["end0"] = within if cur["end0"] else outside
            cur["end1"] = within if cur["end1"] else outside
            cur["loud"] = cur["loud"] or outside
            done = i + 1
        free = int(kept[done:].sum())
        cur["kept0"] += 0 if cur["end0"] else free
        cur["kept1"] += 0 if cur["end1"] else free
        cur["n"] += n
        return total

    def assemble(self) -> Callable:
        """A function for mapInArrow over lines with their split's ``_open`` and ``_off``: pieces of records, numbered; a record that goes on in another split has several."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cur, inside, number, n = None, False, 0, 0
            piece: list[str] = []
            begun = False
            out: list[tuple] = []

            def close(ends: bool) -> None:
                nonlocal piece, begun
                if piece:
                    text = "\n".join(piece)
                    if not (begun and ends and self.blanks and not text.strip(self.bare)):
                        out.append((number, cur[1], text, begun and ends, cur[0]))
                piece, begun = [], False

            for batch in batches:
                names = batch.schema.names
                col = {c: batch.column(names.index(c)).to_pylist() for c in ("value", "_path", "_at", "_open", "_off")}
                for value, path, at, opened, off in zip(*col.values()):
                    if cur != (path, at):
                        close(False)
                        cur, inside, number, n = (path, at), opened, off, 0
                    n += 1
                    if at == 0 and n <= self.skip + int(self.header):
                        continue
                    fresh = not inside
                    if fresh:
                        begun = True
                        if self.blanks and not (value.partition(self.comment)[0] if self.comment else value).strip(self.bare):
                            begun = False
                            continue
                        number += 1
                    if (self.quote and self.quote in value) or inside:
                        inside, c = _line_end(value, inside, self.sep, self.quote, self.comment)
                        value = value if c < 0 else value[:c]
                    elif self.comment:
                        value = value.partition(self.comment)[0]
                    piece.append(value)
                    if not inside:
                        if not begun:  # the end of a record of an earlier split
                            out.append((number, at, "\n".join(piece), False, path))
                            piece = []
                        else:
                            close(True)
                if len(out) >= 10_000:
                    yield _pieces(out)
                    out = []
            close(False)
            if out:
                yield _pieces(out)

        return run


_PIECE = "_row bigint, _at bigint, value string, whole boolean, _path string"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string())], names=["_row", "_at", "value", "whole", "_path"])


def _records(lines: DataFrame, how: _Lines) -> tuple[DataFrame, str | None, bool]:
    """Records as ``_row`` (from 1, over the files in order of their paths) and ``value``; the header; whether they must be split by the exact splitter.

    Where no quoted field goes over a line end (which the survey tells), the
    second pass stays in the JVM.
    """
    base = _in_order(lines)
    splits = stage(base.mapInArrow(how.survey, _SURVEY), "splits")
    first = splits.where("head is not null").orderBy("_path").limit(1).select("head").collect() if how.header else []
    loud = splits.where("loud").limit(1).count() > 0
    if not loud:
        placed = ordered_scan(splits, [], _SPLIT, sums={"_upto": "kept0"}).select("_path", "_at", "first", "top", (F.col("_upto") - F.col("kept0")).alias("_off"))
        kept = base.where(how.kept(F.col("value"))).withColumn("_seq", F.monotonically_increasing_id())  # numbers the kept lines of a task
        rows = _on_split(kept, placed).where(F.col("_seq") >= F.col("first") + F.col("top"))
        rows = rows.select((F.col("_off") + F.col("_seq") - F.col("first") - F.col("top") + 1).alias("_row"), how.plain(F.col("value")).alias("value"))
        return stage(rows, "records"), first[0][0] if first else None, False

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:  # the splits of one file: as many as it has, not as it has lines
        pdf = pdf.sort_values("_at")
        state, opened = False, []
        for a, b in zip(pdf["end0"], pdf["end1"]):
            opened.append(state)
            state = bool(b if state else a)
        if state:
            raise ValueError(f"a quoted field is never closed in {pdf['_path'].iloc[0]}")
        return pd.DataFrame({"_path": pdf["_path"], "_at": pdf["_at"], "_open": opened, "kept": [int(k1 if o else k0) for o, k0, k1 in zip(opened, pdf["kept0"], pdf["kept1"])]})

    states = stage(splits.groupBy("_path").applyInPandas(follow, "_path string, _at bigint, _open boolean, kept bigint"), "states")
    placed = ordered_scan(states, [], _SPLIT, sums={"_upto": "kept"}).select("_path", "_at", "_open", (F.col("_upto") - F.col("kept")).alias("_off"))
    side = placed.withColumnsRenamed({"_path": "_sp", "_at": "_sa"})
    same = (F.col("_path") == F.col("_sp")) & (F.col("_at") == F.col("_sa"))
    if side.limit(MAX_SPLITS + 1).count() <= MAX_SPLITS:  # one small row a split; the lines stay in order
        base = base.join(F.broadcast(side), same).drop("_sp", "_sa")
    else:  # the lines are joined by their split and put in order again
        base = base.withColumn("_seq", F.monotonically_increasing_id()).join(side.hint("merge"), same).drop("_sp", "_sa")
        base = base.repartition("_path", "_at").sortWithinPartitions("_path", "_at", "_seq")
    pieces = stage(base.mapInArrow(how.assemble(), _PIECE), "pieces")
    rest = pieces.where("not whole").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_p"))
    rest = rest.select("_row", F.array_join(F.transform("_p", lambda p: p["value"]), "\n").alias("value"))  # records over the end of a split: at most one a split
    return pieces.where("whole").select("_row", "value").unionByName(rest), first[0][0] if first else None, True


def read_table(
    spark: SparkSession,
    path: str,
    *,
    sep: str = "",
    header: bool = False,
    quote: str = '"',
    dec: str = ".",
    skip: int = 0,
    comment: str = "",
    fill: bool = False,
    blank_lines_skip: bool = True,
    allow_escapes: bool = False,
    columns: Sequence[str] | None = None,
    schema: str | T.StructType | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    na: Sequence[str] = ("NA",),
    encoding: str = "UTF-8",
    post: Callable[[DataFrame], DataFrame] | None = None,
    output: str | None = None,
    overwrite: bool | str = False,
) -> Division:
    """A delimited file, or a folder of them, as a division keyed by running block number.

    ``sep`` empty: any run of blanks and tabs. Types are those of ``schema``,
    or inferred from the first lines (integer, double, else text); a later value
    that is neither missing nor of its column's type is an error. ``dec`` may
    be a comma. A quoted field may hold separators, comment marks and line
    ends (a file in which one is never closed is an error); ``comment`` outside
    quotes hides the rest of its line. ``allow_escapes``: ``\\n``, ``\\t``,
    ``\\\\``, ``\\x41``, ``\\101`` and the like stand for their characters. ``skip``
    lines and the header are left out at the start of each file. A line of too
    few fields is filled with missing values (``fill``) or an error; too many
    are an error. Block numbers run across the files in order of their paths;
    no line is moved for them.
    """
    how = _Lines(sep, quote, comment, skip, header, blank_lines_skip)
    lines = spark.read.option("encoding", encoding).option("recursiveFileLookup", "true").text(path)
    rows, head, exact = _records(lines, how)
    if header and columns is None:
        columns = _split_line(head, sep, quote) if head is not None else []
    top = [r[0] for r in rows.where(F.col("_row") <= HEAD_LINES).orderBy("_row").select("value").collect()]  # found by the row groups' bounds
    fields = [_split_line(t, sep, quote) for t in top]
    width = len(columns) if columns else max((len(f) for f in fields), default=0)
    names = list(columns) if columns else [f"V{i + 1}" for i in range(width)]
    if schema is not None:
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        names, types = kind.names, [f.dataType for f in kind.fields]
    else:
        types = [_infer([f[i] for f in fields if i < len(f)], dec, na) for i in range(width)]
    rows = rows.withColumn("_f", _split_exactly(F.col("value"), sep, quote, len(names)) if exact else _split_column(F.col("value"), sep, quote, len(names)))
    if allow_escapes:
        rows = rows.withColumn("_f", F.col("_f").withField("fields", _unescaped(F.col("_f.fields"))))
    bad = F.col("_f.long") | (F.col("_f.short") & F.lit(not fill))
    rows = rows.withColumn("_f", F.when(bad, F.raise_error(F.concat(F.lit(f"not {len(names)} fields: "), F.col("value")))).otherwise(F.col("_f.fields")))
    missing = [*na, ""]

    def typed(i: int, t: T.DataType) -> F.Column:
        v = F.get("_f", F.lit(i))
        if isinstance(t, T.StringType):
            return F.when(~v.isin(*na), v)
        v = F.trim(v)
        v = F.when(~v.isin(*missing), v)
        if dec != "." and isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            v = F.replace(v, F.lit(dec), F.lit("."))
        cast = v.try_cast(t)
        misfit = v.isNotNull() & cast.isNull()
        if isinstance(t, (T.DoubleType, T.FloatType)):  # the cast takes 1d and 1f as numbers
            misfit = misfit | v.rlike(r"[0-9.][dDfF]$")
        what = F.concat(F.lit(f"not {t.simpleString()} in column {names[i]}; give schema=: "), v)
        return F.when(misfit, F.raise_error(what)).otherwise(cast)

    block = (F.floor((F.col("_row") - 1) / F.lit(rows_per_block)) + 1).cast("bigint").alias(KEY)
    blocks = rows.select(*[typed(i, t).alias(c) for i, (c, t) in enumerate(zip(names, types))], block)
    res = Division(post(blocks) if post else blocks)
    if output:
        from divrec.sources.connections import DiskConnection

        res = replace(res, df=DiskConnection(output).write(res.df, overwrite))
    return res


_ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{1,2})|([0-7]{1,3})|(.))", re.S)
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def unescape(text: str) -> str:
    """Escapes as in C stand for their characters; any other character after a backslash stands for itself."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2], 8)) if m[2] else _LETTERS.get(m[3], m[3]), text)


def _unescaped(fields: F.Column) -> F.Column:
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in columns:
            yield pa.array([None if f is None else [None if x is None else unescape(x) for x in f] for f in col.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.ArrayType(T.StringType()))(fields)


def _split_exactly(line: F.Column, sep: str, quote: str, width: int) -> F.Column:
    """As ``_split_column``, for records that may hold line ends; unsound quoting is an error."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in columns:
            out = []
            for text in col.to_pylist():
                fields, sound = split_record(text.strip(" \t") if not sep else text, sep, quote)
                if not sound:
                    raise ValueError(f"broken quoting: {text}")
                out.append({"fields": fields, "long": len(fields) > width, "short": len(fields) < width})
            yield pa.array(out, pa.struct([("fields", pa.list_(pa.string())), ("long", pa.bool_()), ("short", pa.bool_())]))

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = T.StructType([T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("long", T.BooleanType()), T.StructField("short", T.BooleanType())])
    return F.arrow_udf(run, kind)(line)


def _split_line(line: str, sep: str, quote: str) -> list[str]:
    return split_record(line.strip(" \t") if not sep else line, sep, quote)[0]


def _split_column(line: F.Column, sep: str, quote: str, width: int) -> F.Column:
    """``fields`` of a line, and whether it is too ``long`` or too ``short``; in the JVM."""
    if sep and len(sep) == 1:
        options = {"sep": sep, "quote": quote or "\u0000", "escape": quote or "\u0000", "mode": "PERMISSIVE", "nullValue": "\u0001", "emptyValue": "", "columnNameOfCorruptRecord": "_corrupt"}
        read = lambda n: F.from_csv(line, ", ".join([*(f"c{i} string" for i in range(n)), "_corrupt string"]), options)
        exact, more = read(width), read(width + 1)
        off = exact["_corrupt"].isNotNull()
        loud = F.size(F.split(line, re.escape(sep), -1)) > width
        if quote:
            loud = loud & ~F.contains(line, F.lit(quote))
        long = off & (more["_corrupt"].isNull() | more[f"c{width}"].isNotNull() | loud)
        # the reader gives NULL for an empty field; a field that isn't there stays NULL
        fields = F.array(*[F.coalesce(exact[f"c{i}"], F.when(~off, "")) for i in range(width)])
        return F.struct(fields.alias("fields"), long.alias("long"), (off & ~long).alias("short"))
    if not sep and not quote:
        parts = F.split(F.btrim(line, F.lit(" \t")), r"[ \t]+")
    elif not sep:  # a quoted field, doubled marks inside, or a run without blanks
        q = re.escape(quote)
        found = F.regexp_extract_all(line, F.lit(rf"({q}(?:[^{q}]|{q}{q})*{q}|[^ \t]+)"), 1)
        parts = F.transform(found, lambda x: F.when(x.startswith(quote), F.replace(F.regexp_replace(x, rf"^{q}|{q}$", ""), F.lit(quote * 2), F.lit(quote))).otherwise(x))
    else:
        parts = F.split(line, re.escape(sep), -1)
    return F.struct(parts.alias("fields"), (F.size(parts) > width).alias("long"), (F.size(parts) < width).alias("short"))


def _infer(values: list[str], dec: str, na: Sequence[str]) -> T.DataType:
    seen = [v.strip() for v in values if v.strip() not in na and v.strip()]
    if seen and all(re.fullmatch(r"[+-]?\d{1,9}", v) for v in seen):
        return T.IntegerType()
    d = re.escape(dec)
    if seen and all(re.fullmatch(rf"[+-]?(\d+({d}\d*)?|{d}\d+)([eE][+-]?\d+)?|NaN|[+-]?Inf", v) for v in seen):
        return T.DoubleType()
    return T.StringType()


def read_csv(spark: SparkSession, path: str, **kw) -> Division:
    return read_table(spark, path, **{"sep": ",", "header": True, "fill": True, **kw})


def read_csv2(spark: SparkSession, path: str, **kw) -> Division:
    return read_table(spark, path, **{"sep": ";", "dec": ",", "header": True, "fill": True, **kw})


def read_delim(spark: SparkSession, path: str, **kw) -> Division:
    return read_table(spark, path, **{"sep": "\t", "header": True, "fill": True, **kw})


def read_delim2(spark: SparkSession, path: str, **kw) -> Division:
    return read_table(spark, path, **{"sep": "\t", "dec": ",", "header": True, "fill": True, **kw})


def _numbered_lines(lines: DataFrame, drop: int, head: int | None) -> tuple[DataFrame, str | None]:
    """``_n`` (from 1, over the files in order of their paths) and ``value`` of the lines left after the first ``drop`` of each file; line ``head`` of the first file."""
    base = _in_order(lines).withColumn("_seq", F.monotonically_increasing_id())
    splits = stage(base.groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("_c"), F.min("_seq").alias("_first")), "splits")
    placed = ordered_scan(splits, ["_path"], ["_at"], sums={"_upto": "_c"}).withColumn("_before", F.col("_upto") - F.col("_c"))
    placed = placed.withColumn("_gone", F.greatest(F.least(F.lit(drop) - F.col("_before"), F.col("_c")), F.lit(0))).withColumn("_left", F.col("_c") - F.col("_gone"))
    placed = ordered_scan(placed, [], _SPLIT, sums={"_all": "_left"}).withColumn("_off", F.col("_all") - F.col("_left"))
    rows = _on_split(base, placed.select(*_SPLIT, "_first", "_before", "_gone", "_off"))
    at = F.col("_seq") - F.col("_first")
    rows = stage(rows.select("_path", (F.col("_before") + at).alias("_in"), (F.col("_off") + at - F.col("_gone") + 1).alias("_n"), (at >= F.col("_gone")).alias("_left"), "value"), "lines")
    top = rows.where(F.col("_in") == F.lit(head)).orderBy("_path").limit(1).select("value").collect() if head is not None else []
    return rows.where("_left").select("_n", "value"), top[0][0] if top else None


def read_text_chunks(
    spark: SparkSession,
    path: str,
    fn: Callable,
    schema: str,
    *,
    lines_per_block: int = LINES_PER_BLOCK,
    header: bool = False,
    skip: int = 0,
    record_end: str | None = None,
    key_fn: Callable[[str], str] | None = None,
) -> Division:
    """``fn(lines)`` (or ``fn(lines, header)``) on blocks of lines; a block whose result is None vanishes.

    The key is the block number, or ``key_fn`` of the block's text. With
    ``record_end`` (a pattern) a record that is open at a block's last line is
    carried over into the next block. A task holds one block at a time.
    """
    rows, head = _numbered_lines(spark.read.text(path, recursiveFileLookup=True), skip + int(header), skip if header else None)
    if record_end is None:
        numbered = rows.withColumn("_block", F.floor((F.col("_n") - 1) / F.lit(lines_per_block)) + 1)
    else:  # the block of a record is that of its last line
        ends = rows.withColumn("_end", F.col("value").rlike(record_end).cast("int"))
        numbered = ordered_scan(ends, [], ["_n"], sums={"_ended": "_end"}).withColumn("_record", F.col("_ended") - F.col("_end"))
        lasts = numbered.groupBy("_record").agg((F.floor((F.max("_n") - 1) / F.lit(lines_per_block)) + 1).alias("_block"))
        numbered = numbered.join(lasts, "_record")
    kind = T.StructType([T.StructField(KEY, T.StringType()), *T._parse_datatype_string(schema).fields])
    work, name = _freeze(fn), (_freeze(key_fn) if key_fn else None)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = list(pdf.sort_values("_n")["value"])
        key = name("\n".join(lines)) if name else str(int(pdf["_block"].iloc[0]))
        two = header and work.__code__.co_argcount >= 2
        return _frame(kv_apply(lambda v: work(v, head) if two else work(v), key, lines), {}, kind.names)

    return Division(numbered.groupBy("_block").applyInPandas(run, kind))
