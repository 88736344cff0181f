import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from divrec.llm.text import word_spans, words


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("  \n", []), ("One two", ["one", "two"]), ("don't stop-now_x", ["don", "t", "stop", "now", "x"]), ("a<b>c</b>d", ["a", "c", "d"]), ("x < y > z", ["x", "z"]),
        ("<" + "q" * 61 + ">", ["q" * 61]), ("café café CAFE", ["cafe", "cafe", "cafe"]), ("so­ft z​ero", ["soft", "zero"]), ("ＡＢ１", ["ab1"]), ("fish &amp; chips&nbsp;ok &eacute;", ["fish", "chips", "ok", "e"]),
        ("&#65;&#x42;c", ["abc"]), ("Straße", ["strasse"]), ("3.14 10,000", ["3", "14", "10", "000"]), ("&lt;b&gt;", ["b"]),
    ],
)
def test_words(text, want):
    assert words(text) == want
    assert [w for w, _, _ in word_spans(text)] == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab<>&;#/ \né́​­Ａßﬁ_1"), st.characters(max_codepoint=0x2FFF))))
def test_spans_agree(text):
    spans = word_spans(text)
    assert [w for w, _, _ in spans] == words(text)
    assert all(0 <= s < e <= len(text) for _, s, e in spans) and all(a[2] <= b[1] or a[1] == b[1] or b[1] < a[2] for a, b in zip(spans, spans[1:]))


def test_portions():
    import pyarrow as pa

    from divrec.llm.text import portions

    texts = ["a" * 10, None, "b" * 3, "", "c" * 50, "d", "é" * 4]
    batch = pa.record_batch([pa.array(range(7)), pa.array(texts)], ["i", "t"])
    for most in (1, 8, 13, 1000):
        parts = list(portions(iter([batch, batch.slice(0, 0)]), 1, most))
        assert sum((p.column(1).to_pylist() for p in parts), []) == texts
        assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= most for p in parts)
    assert len(list(portions(iter([batch]), 1, 1000))) == 1


def test_results_do_not_depend_on_portions(spark, monkeypatch):
    from divrec.llm import text
    from divrec.llm.contamination import clean_documents, leaks
    from divrec.llm.repetition import perplexities

    docs = spark.createDataFrame([(i, "one two three four five six seven " * (1 + i % 5) + "end" * (i % 2), "en") for i in range(40)], "doc_id bigint, text string, lang string")
    items = spark.createDataFrame([(1, "two three four five six seven one two three four five")], "eval_id bigint, text string")

    def results():
        return [sorted(map(repr, map(tuple, d.collect()))) for d in (leaks(docs, items), clean_documents(docs, items), perplexities(docs))]

    whole = results()
    monkeypatch.setattr(text, "PORTION", 100)
    assert results() == whole
