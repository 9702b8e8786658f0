import pytest

from evalspark.functions.parse import label_name, map_values, parse_cot_label, parse_json_label, parse_label

BASIC = [
    ("positive", 0, False, False),
    ("**positive.**", 0, False, False),
    ('"negative"', 1, False, False),
    ("Positive", -1, True, False),
    ("neutral", -1, True, False),
    ("", -1, True, False),
    ("...", -1, True, False),
    ("positive negative", -1, False, True),
    ("very-good", -1, False, True),
    ("posiétive", -1, False, True),
    (None, -1, False, True),
]


def test_parse_label_edge_table(spark):
    df = spark.createDataFrame([(r[0],) for r in BASIC], "raw string")
    got = df.select("raw", parse_label("raw").alias("p")).collect()
    for (raw, label, h, w), r in zip(BASIC, got):
        assert (r.p.label, r.p.is_hallucination, r.p.is_wrong_format) == (label, h, w), raw
        assert (r.p.label == -1) == (r.p.is_hallucination or r.p.is_wrong_format)
        assert not (r.p.is_hallucination and r.p.is_wrong_format)


def test_parse_label_ignore_case_and_custom_prune(spark):
    df = spark.createDataFrame([("Positive",), ("NEG",)], "raw string")
    rows = df.select(parse_label("raw", ignore_case=True).alias("p"),
                     parse_label("raw", {"NEG": 1}, prune="[^A-Z]").alias("q")).collect()
    assert rows[0].p.label == 0 and rows[1].q.label == 1


M = "my classification is:"
COT = [
    (f"long reasoning ... {M} positive.", 0, False, False),
    (f"{M} positive ... {M} negative", 1, False, False),
    (f"text {M}", -1, True, False),
    ("no marker here", -1, False, True),
]


def test_parse_cot(spark):
    df = spark.createDataFrame([(r[0],) for r in COT], "raw string")
    got = df.select(parse_cot_label("raw", M).alias("p")).collect()
    for (raw, label, h, w), r in zip(COT, got):
        assert (r.p.label, r.p.is_hallucination, r.p.is_wrong_format) == (label, h, w), raw


def test_parse_cot_keeps_marker_last_char(spark):
    df = spark.createDataFrame([("answer positive",), ("a----positive",)], "raw string")
    rows = df.select(parse_cot_label("raw", "answer").alias("p"), parse_cot_label("raw", "---").alias("q")).collect()
    assert rows[0].p.is_wrong_format  # 'r positive' is two tokens (reference quirk Q6)
    assert rows[1].q.label == 0  # '-positive' after the last '---'
    with pytest.raises(ValueError):
        parse_cot_label("raw", "")


def test_parse_json(spark):
    cases = [
        ('x {"label": "a"} y', "a"),
        ("{bad}", None),
        ("no braces", None),
        ("} {", None),
        ("{'label': 'a'}", None),
        ('{"other": 1}', None),
        ('{"label": 1} and {"label": 2}', None),
        ('{"label": 3}', "3"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "raw string")
    got = df.select(parse_json_label("raw", ["label"]).alias("j")).collect()
    assert [r.j.label for r in got] == [c[1] for c in cases]


def test_map_and_label_name(spark):
    df = spark.createDataFrame([("negative", 1), ("x", 0), ("1", 5)], "s string, l int")
    rows = df.select(map_values("s", {"negative": 1, "1": 1}).alias("m"), label_name("l").alias("n")).collect()
    assert [r.m for r in rows] == [1, None, 1]
    assert [r.n for r in rows] == ["negative", "positive", None]


def test_custom_mapping_and_cot_options(spark):
    df = spark.createDataFrame([("1",), ("0.",), ("Reasoning... ANSWER: Negative",), ("x  y",)], "raw string")
    rows = df.select(
        parse_label("raw", {"1": 1, "0": 0}).alias("num"),
        parse_cot_label("raw", "ANSWER:", ignore_case=True).alias("cot"),
        parse_label("raw", {"x": 0}, prune="[^a-z  ]").alias("ws"),
    ).collect()
    assert (rows[0].num.label, rows[1].num.label) == (1, 0)
    assert rows[2].cot.label == 1 and not rows[2].cot.is_hallucination
    # a custom prune keeps NBSP: it still separates words as in Python's split
    assert rows[3].ws.is_wrong_format and rows[3].ws.label == -1


def test_python_parser_matches_column_parser(spark):
    import re

    from evalspark.functions.parse import python_parser

    def reference_rule(text):  # the basic rule written in plain Python
        if text is None:
            return (-1, False, True)
        s = re.sub(r"[^a-zA-Z0-9]", " ", text).strip()
        if len(s.split()) > 1:
            return (-1, False, True)
        if s not in {"negative": 1, "positive": 0}:
            return (-1, True, False)
        return ({"negative": 1, "positive": 0}[s], False, False)

    df = spark.createDataFrame([(r[0],) for r in BASIC], "raw string")
    rows = df.select(parse_label("raw").alias("a"), python_parser(reference_rule)("raw").alias("b")).collect()
    assert all(tuple(r.a) == tuple(r.b) for r in rows)


def test_json_engines_agree(spark):
    cases = ['x {"label": "a"} y', "{bad}", "} {", "{'label': 'a'}", '{"other": 1}', '{"label": 1} and {"label": 2}',
             '{"label": 3}', '{"label": 1},{"label": 2}', '{"label": 1}, null, {"label": 2}', '{"label": 1}, null}',
             '{"label": 1}}', '{"label": {"x": 1}}', '{"label": [1,2]}',
             '{"label": null}', '{"label": true}', '{"label": 1.50}', '{"label": "é"}', "", None, "[1]", '{"a": {"label": 1}}']
    df = spark.createDataFrame([(c,) for c in cases], "raw string")
    rows = df.select(parse_json_label("raw", ["label"]).alias("p"),
                     parse_json_label("raw", ["label"], engine="jvm").alias("j")).collect()
    assert [r.p.label for r in rows] == [r.j.label for r in rows]
