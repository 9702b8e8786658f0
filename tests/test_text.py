import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalspark.functions.text import (
    chat_messages,
    crop_middle,
    render_chat,
    render_prompt,
    template_fields,
    validate_prompt_fields,
    word_count,
    words,
)

WS = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", " ", "\x85", "\xa0", " ", " ", " ", "　"]


def py_crop(text, head, tail):
    toks = text.split()
    if isinstance(head, float):
        head = int(len(toks) * head // 1)
    if isinstance(tail, float):
        tail = int(len(toks) * tail // 1)
    return " ".join(toks[:head] + toks[-tail:])


def test_words_match_python_split(spark):
    samples = ["", " ", "a", " a b  ", "a b c\u0085d\u001ce", "\tx\ny\r\n", "é ü ñ", "a{b} c"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = df.select("t", words("t").alias("w"), word_count("t").alias("n")).collect()
    for r in got:
        assert r.w == r.t.split(), r.t
        assert r.n == len(r.t.split())


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "bc", "é", "{x}", "-"]), st.sampled_from(WS)), max_size=8))
def test_words_property(spark, parts):
    text = "".join(w + s for w, s in parts)
    r = spark.createDataFrame([(text,)], "t string").select(words("t").alias("w"), word_count("t").alias("n")).first()
    assert r.w == text.split() and r.n == len(text.split())


@pytest.mark.parametrize(
    "text,head,tail,expected",
    [
        ("a b c d e", 2, 1, "a b e"),
        ("a b c", 30, 30, "a b c a b c"),
        ("a b c", 2, 2, "a b b c"),
        ("a b c", 0.1, 0.1, "a b c"),
        ("a b c", 1, 0, "a a b c"),
        ("", 3, 3, ""),
        ("a\tb c d\u0085e\u001cf", 1, 1, "a f"),
    ],
)
def test_crop_edges(spark, text, head, tail, expected):
    r = spark.createDataFrame([(text,)], "t string").select(crop_middle("t", head, tail).alias("c")).first()
    assert r.c == expected == py_crop(text, head, tail)


def test_crop_matches_python_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    for head, tail in [(30, 30), (0.2, 0.2), (0.1, 0.3), (5, 0)]:
        rows = docs.select("text", crop_middle("text", head, tail).alias("c")).collect()
        for r in rows:
            assert r.c == py_crop(r.text, head, tail)


def test_crop_dedupe_and_errors(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    rows = df.select(crop_middle("t", 2, 2, dedupe=True).alias("c"), crop_middle("t", 1, 0, dedupe=True).alias("d")).collect()
    assert rows[0].c == "a b c" and rows[0].d == "a" and rows[1].c is None
    with pytest.raises(ValueError):
        crop_middle("t", -1, 2)


def test_template_fields_and_validation(spark):
    assert template_fields("Rate {review}. {{literal}} {review}") == ["review"]
    assert template_fields("{review}") == ["review"]
    validate_prompt_fields("Rate {review}.", ["review"])
    with pytest.raises(KeyError, match="extra"):
        validate_prompt_fields("Rate {review}.", ["review", "extra"])
    with pytest.raises(KeyError, match="review"):
        validate_prompt_fields("Rate {review}.", [])
    for bad in ["{x:>10}", "{x.attr}", "{0}", "{}", "{x!r}"]:
        with pytest.raises(ValueError):
            template_fields(bad)


def test_render_prompt_keeps_braces_in_values(spark):
    df = spark.createDataFrame([("good {x} movie",), (None,)], "review string")
    rows = df.select(render_prompt("Rate {review}. {{literal}}").alias("p")).collect()
    assert rows[0].p == "Rate good {x} movie. {literal}" == "Rate {review}. {{literal}}".format(review="good {x} movie")
    assert rows[1].p is None


def test_chat_messages(spark):
    df = spark.createDataFrame([("hi",)], "u string")
    r = df.select(chat_messages("sys", F.col("u")).alias("m")).select("m", render_chat("m").alias("t")).first()
    assert [(m.role, m.content) for m in r.m] == [("system", "sys"), ("user", "hi")]
    assert r.t == "system: sys\nuser: hi"


def test_few_shot_template_and_select_content(spark):
    from evalspark.functions.text import few_shot_template
    from evalspark.operators.infer import select_content

    t = few_shot_template("Rate {review}.\n{examples}\nDone", [("negative", "bad {x}"), ("positive", "good")])
    assert template_fields(t) == ["review"]
    assert t.format(review="R") == 'Rate R.\n- NEGATIVE (negative): "bad {x}"\n- POSITIVE (positive): "good"\nDone'
    df = spark.createDataFrame([(1, "r", 0)], "example_id long, review string, label int")
    assert select_content(df, "Rate {review}").columns == ["example_id", "review"]
    with pytest.raises(KeyError):
        few_shot_template("no slot", [])
