import pytest
from pyspark.sql import functions as F

from divrec.sources.bad_records import classify_records, load_typed, number_blocks, reject_brute_force, split_record

FMT = "format_id int, sep string, dec_mark string, quote_mark string, header_line string, colnames array<string>, colclasses array<string>, rowsperblock int"
FORMATS = [
    (1, ",", ".", '"', "a,b,c", ["a", "b", "c"], ["numeric", "integer", "character"], 2),
    (2, ";", ",", '"', "x;d;t;f", ["x", "d", "t", "f"], ["numeric", "Date", "POSIXct", "logical"], 50),
    (3, "", ".", '"', "p q", ["p", "line_id"], ["numeric", "character"], None),
    (4, "||", ".", "'", None, ["u", "v"], ["character", "character"], 10),
]
LINES = [
    (1, "a,b,c", "-"), (1, "1,2,x", None), (1, "1,2,x\r", None), (1, "1,2,x\r\r", None), (1, "", "-"), (1, "  ", "-"), (1, None, "-"), (1, "1,2", "columns"), (1, "1,2,x,", "columns"),
    (1, '1,2,"x', "quoting"), (1, '1,2,"x"y', "quoting"), (1, '1,2,"x""y"', None), (1, '1,2,x"y', None), (1, '1,2,"a,b"', None), (1, '1,2,"a\nb"', None), (1, '"1","2",""', None),
    (1, "1e5,2,x", None), (1, "1.,2,x", None), (1, ".5,2,x", None), (1, ".,2,x", "value"), (1, "1.2.3,2,x", "value"), (1, "+1.5e-3, 2 ,x", None), (1, "NaN,NA,", None), (1, "-Inf,,NA", None), (1, "+Inf,1,x", "value"),
    (1, "1,2147483647,x", None), (1, "1,2147483648,x", "value"), (1, "1,-2147483647,x", None), (1, "1,00000000000000000005,x", None), (1, "1,1e3,x", "value"), (1, "1,99999999999999999999999,x", "value"), (1, "null,1,x", "value"),
    (1, '"x,y', "quoting"), (1, '1,"2"3,"', "quoting"), (1, '" 1 ",2,x', None), (1, ' "1",2,x', "value"), (1, "1,2," + "z" * 300_000, None), (1, "," * 5000, "columns"), (1, '1,2,"' + 'q""' * 50_000, "quoting"),
    (2, "1,5;2020-02-29;2020-01-01 23:59:59;TRUE", None), (2, "1.5;2020-02-29;2020-01-01 23:59:59;T", "value"), (2, "1,5;2021-02-29;NA;F", "value"), (2, "1,5;2020-1-01;NA;F", "value"), (2, "1,5;NA;2020-01-01 24:00:00;F", "value"),
    (2, "1,5;NA;2020-01-01 9:00:00;F", "value"), (2, "1,5;NA;2020-01-01T09:00:00;F", "value"), (2, "1,5;NA;;yes", "value"), (2, ";;;false", None), (2, "1,5;NA;2020-13-01 10:00:00;T", "value"),
    (3, "  p q ", "-"), (3, " 1.5 \t x", None), (3, '1 "x y"', None), (3, "1", "columns"), (3, '1 "x', "quoting"), (3, '1 "x"y', "quoting"), (3, "1 x y", "columns"), (3, "x y", "value"),
    (4, "a||b", None), (4, "a|b", "columns"), (4, "'a||b'||c", None), (4, "'a'b||c", "quoting"), (4, "a||b||c", "columns"),
    (9, "anything", "format"), (None, "anything", "format"),
]


@pytest.fixture(scope="module")
def tables(spark):
    lines = spark.createDataFrame([(i, "f", i, f, t) for i, (f, t, _) in enumerate(LINES)], "line_id bigint, file_name string, line_no int, format_id int, raw_line string")
    return lines, spark.createDataFrame(FORMATS, FMT)


def test_reasons(tables):
    got = {r["line_id"]: r["reason"] for r in classify_records(*tables).select("line_id", "reason").collect()}
    for i, (_, text, want) in enumerate(LINES):
        assert got.get(i, "-") == want, (i, text and text[:60])


def test_brute_force_agrees(tables):
    lines, formats = tables
    rows = [r.asDict() for r in lines.where("format_id between 1 and 4").collect()]
    want = reject_brute_force(rows, [f.asDict() for f in formats.collect()])
    got = {r["line_id"]: r["reason"] for r in classify_records(lines, formats).where("format_id between 1 and 4").collect()}
    assert got == want


def test_typed_rows_and_blocks(spark, tables):
    lines, formats = tables
    valid = classify_records(lines, formats).where("reason is null and format_id is not null")
    blocks = number_blocks(valid, formats)
    per = blocks.where("format_id = 1").groupBy("block").count().collect()
    n = sum(r["count"] for r in per)
    assert n == sum(f == 1 and w is None for f, _, w in LINES) and max(r["count"] for r in per) == 2 and len(per) == (n + 1) // 2
    specs = {r["format_id"]: r for r in formats.collect()}
    one = load_typed(blocks, specs[1])
    assert one.columns == ["line_id", "block", "a", "b", "c"]
    vals = {r["line_id"]: (r["a"], r["b"], r["c"]) for r in one.collect()}
    by_text = {t: i for i, (_, t, _) in enumerate(LINES)}
    assert vals[by_text['1,2,"a\nb"']] == (1.0, 2, "a\nb") and vals[by_text['1,2,"x""y"']] == (1.0, 2, 'x"y')
    assert vals[by_text["-Inf,,NA"]] == (float("-inf"), None, None)
    two = load_typed(blocks, specs[2]).where("x = 1.5").first()
    assert str(two["d"]) == "2020-02-29" and str(two["t"]) == "2020-01-01 23:59:59" and two["f"] is True
    assert load_typed(blocks, specs[3]).columns == ["line_id", "block", "p", "line_id_"]
    assert load_typed(blocks, specs[3]).where("line_id_ = 'x y'").count() == 1


def test_clashing_names_repeated_rows_and_empty(tables):
    lines, formats = tables
    odd = lines.where("line_id in (1, 7)").withColumn("reason", F.lit("mine")).withColumn("fields", F.lit(1)).withColumn("_f", F.lit(2))
    got = classify_records(odd.union(odd), formats)
    assert {"reason", "fields", "_f", "reason_", "fields_"} <= set(got.columns)
    assert sorted((r["line_id"], r["reason"], r["reason_"]) for r in got.collect()) == [(1, "mine", None)] * 2 + [(7, "mine", "columns")] * 2
    assert classify_records(lines.limit(0), formats).count() == 0
    assert classify_records(lines, formats.limit(0)).where("reason <> 'format'").count() == 0


def test_unknown_class(spark, tables):
    with pytest.raises(ValueError, match="class"):
        classify_records(tables[0], spark.createDataFrame([(1, ",", ".", '"', "h", ["a"], ["complex"], 1)], FMT))


def test_split_record():
    assert split_record('a,"b""c",', ",", '"') == (["a", 'b"c', ""], True)
    assert split_record("a \t b", "", '"') == (["a", "b"], True)
    assert split_record("", ",", '"') == ([""], True)


def test_more_fields_than_the_reader_takes(spark):
    """No line stops the job, however many fields it has."""
    specs = [{"format_id": 1, "sep": ",", "dec_mark": ".", "quote_mark": '"', "header_line": "a,b", "colnames": ["a", "b"], "colclasses": ["integer", "character"], "rowsperblock": 10}, {"format_id": 2, "sep": "", "dec_mark": ".", "quote_mark": "", "header_line": None, "colnames": ["a"], "colclasses": ["integer"], "rowsperblock": 10}]
    formats = spark.createDataFrame(specs, "format_id int, sep string, dec_mark string, quote_mark string, header_line string, colnames array<string>, colclasses array<string>, rowsperblock int")
    rows = [(1, "f", 1, 1, "1,x"), (2, "f", 2, 1, "," * 200_000), (3, "f", 3, 1, "1," + "y" * 300_000), (4, "f", 4, 1, "1" + ",2" * 99_990), (5, "f", 5, 2, "1 " * 200_000), (6, "f", 6, 1, '1,"' + "z," * 150_000 + '"')]
    got = classify_records(spark.createDataFrame(rows, "line_id bigint, file_name string, line_no int, format_id int, raw_line string"), formats)
    assert {r["line_id"]: r["reason"] for r in got.select("line_id", "reason").collect()} == {1: None, 2: "columns", 3: None, 4: "columns", 5: "columns", 6: None}
