import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.operators.filters import boolean_query, compile_filters
from kbspark.operators.html import elements
from kbspark.streaming.changes import resolution


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "text string").select(column).collect()]


def test_language(spark):
    assert values(spark, T.language(F.col("text")), "这是一个测试", "plain words", "12 34", "!!") == ["zh", "en", "mixed", "unknown"]


def test_clean(spark):
    assert values(spark, T.clean(F.col("text")), " a  b\n§c! ") == ["a b c!"]


def test_windows_end_with_pure_overlap(spark):
    assert values(spark, T.windows(F.col("text"), 4, 2), "abcdef", "") == [["abcd", "cdef", "ef"], []]
    with pytest.raises(ValueError):
        T.windows(F.col("text"), 4, 4)


def test_phrase_and_boolean(spark):
    words = T.tokens(F.col("text"))
    assert values(spark, T.has_phrase(words, ["b", "c"]), "a b c", "b a c", "") == [True, False, False]
    assert values(spark, boolean_query("(a OR b) AND NOT c", words), "a", "b c", "d") == [True, False, False]
    with pytest.raises(ValueError):
        boolean_query("(a OR b", words)


def test_filters(spark):
    rows = spark.range(10)
    assert rows.where(compile_filters({"id": {"gte": 3, "lt": 6}})).count() == 3
    assert rows.where(compile_filters({"id": {"in": [1, 2]}})).count() == 2
    assert rows.where(compile_filters(None)).count() == 10


def test_html(spark):
    page = "<main><h1>A</h1><p>one <b>two</b></p><h2>B</h2><ul><li>x</li></ul><img src='i.png'></main>"
    found = elements(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("element_index").collect()
    assert [(r.type, r.text, r.path) for r in found] == [
        ("heading", "A", "A"), ("paragraph", "one two", "A"), ("heading", "B", "A > B"), ("list", "x", "A > B"), ("image", "i.png", "A > B"),
    ]


def test_resolution():
    assert [resolution(h) for h in (1, 4, 5)] == ["1 minute", "5 minutes", "15 minutes"]


def test_sentence_splitter_always_advances():
    from kbspark.operators.diffs import split_sentences

    assert split_sentences("One. Two three. Four", 10, 0) == ["One.", "Two three.", "Four"]
    assert "".join(split_sentences("x" * 950, 100, 0)) == "x" * 950
    assert len(split_sentences("y" * 500, 100, 99)) < 500
    with pytest.raises(ValueError):
        split_sentences("z", 100, 100)


def test_diff_counts(spark):
    from kbspark.operators.diffs import diff_counts, similarity

    rows = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd"), (None, None)], "p string, q string")
    got = rows.select(diff_counts("p", "q").alias("d"), similarity("p", "q").alias("s")).collect()
    assert [tuple(r.d) for r in got] == [(2, 1, 1, 0.75), (0, 0, 0, 0.0)] and got[1].s == 1.0


def test_counted_terms_once_for_each_text(spark):
    """Counted in a table for each text: no array function sorts its words."""
    docs = spark.createDataFrame([(1, "b a1 b ça ça a x1 _y"), (2, ""), (3, None), (4, "kk Kk" * 3)], "id long, text string")
    top = docs.select("id", T.counted_terms(F.lower("text"), 2, 2, drop=["x1"]).alias("t"))
    assert {r.id: [tuple(t) for t in r.t] for r in top.collect()} == {1: [("b", 2), ("ça", 2)], 2: [], 3: [], 4: [("kk", 2), ("kkkk", 2)]}
    every = docs.where("id = 1").select(T.counted_terms("text", word="[a-z]+", longer=0).alias("t")).first().t
    assert sorted(map(tuple, every)) == [("a", 1), ("b", 2)]
    import __spark_entry__

    plan = __spark_entry__.queries()["D05_keywords_en"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "arraysort" not in plan
