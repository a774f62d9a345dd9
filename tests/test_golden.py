"""Known inputs and results of functions."""

import math

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import misc, text, vectors
from skeinlake.operators import dsl, evaluation


def one(spark, c, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(c.alias("r")).first()["r"]


def lit(v):
    return F.lit(v)


@pytest.mark.parametrize("a, b, want", [("lantern", "slattern", 2), ("harbour", "harbour, part 4", 8), ("", "oak", 3), ("moss", "mess", 1), ("ü", "u", 2)])
def test_levenshtein(spark, a, b, want):
    assert one(spark, text.levenshtein_bytes(lit(a), lit(b))) == want


@pytest.mark.parametrize("a, b, low, high", [("Harbour", "harbour five", 0.5, 0.7), ("Kettle repairs 7", "Kettle repairs 8", 0.9, 1), ("OAK ", "oak", 1, 1), (" ", "oak", 0, 0), (None, "oak", 0, 0)])
def test_title_similarity(spark, a, b, low, high):
    assert low <= one(spark, text.title_similarity(lit(a).cast("string"), lit(b))) <= high


def test_text_similarity(spark):
    assert one(spark, text.text_similarity(lit("an old copper kettle"), lit("copper kettle handle"))) == pytest.approx(2 / 4)
    assert one(spark, text.text_similarity(lit(""), lit("a"))) == 0
    assert one(spark, text.text_similarity(lit(None).cast("string"), lit("a"))) == 0


@pytest.mark.parametrize("t, want", [("the copper kettle leaks", ["copper", "kettle", "leaks"]), ("x y z", []), (None, None)])
def test_terms(spark, t, want):
    assert one(spark, text.extract_terms(lit(t).cast("string"))) == want


@pytest.mark.parametrize("t, want", [("moss<i>y</i>", "mossy"), ("open <never", "open "), ("", "")])
def test_strip(spark, t, want):
    assert one(spark, text.strip_html(lit(t))) == want


@pytest.mark.parametrize("a, b, want", [("1a2b", "1a2b", 0), ("f0f0", "0f0f", 16), ("9c31", "9c37", 2), ("", "", 0), ("e", "1", 4), ("abc", "ab", -1), ("ffffffffffffffff", "0000000000000000", 64)])
def test_hex_hamming(spark, a, b, want):
    assert one(spark, vectors.hex_hamming(lit(a), lit(b))) == want


@pytest.mark.parametrize("a, b, want", [([1.0, 2.0], [1.0, 2.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0], [1.0, 2.0], 0), ([0.0, 0.0], [1.0, 1.0], 0)])
def test_cosine(spark, a, b, want):
    arr = lambda v: F.array(*map(F.lit, v))
    assert one(spark, vectors.cosine(arr(a), arr(b))) == pytest.approx(want)


def test_half_precision(spark):
    import numpy as np

    values = [0.1, -3.14159, 65504.0, 1e-7, 0.0, 2.5, 1 / 3, 6e-5]
    got = one(spark, vectors.half(F.array(*map(F.lit, values))))
    assert got == [float(np.float16(v)) for v in values]


def test_fnv_and_hashed_vector(spark):
    assert one(spark, vectors.fnv1a(lit("a"))) == 0xE40C292C
    assert one(spark, vectors.fnv1a(lit(""))) == 2166136261
    v = one(spark, vectors.hashed_vector(F.array(F.lit("hello"), F.lit("world"))))
    assert len(v) == 384 and (abs(math.fsum(x * x for x in v) - 1) < 1e-9 or not any(v))


def test_vector_text(spark):
    assert one(spark, vectors.format_vector(F.array(F.lit(1.5), F.lit(-2.0)))) == "[1.5,-2.0]"
    assert one(spark, vectors.parse_vector(lit("[1.5,-2]"))) == [1.5, -2.0]


@pytest.mark.parametrize("t, want", [
    (">>8801 so >>8817", [("", "8801"), ("", "8817")]), ("&gt;&gt;55", [("", "55")]), (">>>/moss/41 or >>>/k2/ 608", [("moss", "41"), ("k2", "608")]),
    (">>>/oak-1/90 beside >>31", [("oak-1", "90"), ("", "31")]), ("nothing", []),
])
def test_quotes(spark, t, want):
    assert [tuple(r) for r in one(spark, text.extract_quotes(lit(t)))] == want


@pytest.mark.parametrize("t, want", [("03/09/25(Sun)07:41:12", "2025-03-09 07:41:12"), ("2024/11/05 (Mar) 21:03:40", "2024-11-05 21:03:40"), ("06/12/24 (Vie) 09:15", "2024-12-06 09:15:00"), ("30-01-25 18:22:07", "2025-01-30 18:22:07"), ("no date", None), ("17/52/25(Mon)07:41:12", None)])
def test_dates(spark, t, want):
    got = one(spark, misc.display_date(lit(t)).cast("string"))
    assert got == want


def test_sanitize(spark):
    got = text.sanitized('<script>x()</script><a href="javascript:y()">bad</a> <a href="https://ok" class="quote" onclick="z()">good</a><b>k</b><blink>u</blink>')
    assert "script" not in got and "onclick" not in got and "blink" not in got
    assert '<a href="https://ok" class="quote">good</a>' in got and "<b>k</b>u" in got
    assert text.sanitized(None) is None and text.sanitized("") == ""


def test_clean_text(spark):
    t = '<a href="#p1" class="quotelink">&gt;&gt;123</a><br>dubs <span>&gt;&gt;&gt;/b/9</span>'
    assert "dubs" in one(spark, text.clean_text(lit(t))) and "123" not in one(spark, text.clean_text(lit(t)))
    assert one(spark, text.clean_text(lit("<br><br>"))) == ""


def test_ngrams(spark):
    assert one(spark, text.char_ngrams(lit("a!b"), 3, 3)) == ["a!b"]
    assert one(spark, text.char_ngrams(lit("!!!"), 3, 3)) == []
    assert one(spark, text.word_ngrams(lit("ab cd"), 2)) == ["ab cd"]
    assert one(spark, text.char_ngrams(lit(""))) == []


def test_pretokenize_and_pieces(spark):
    assert one(spark, text.pretokenize(lit("Hello, 世界! foo-bar"))) == ["Hello", ",", "世", "界", "!", "foo", "-", "bar"]
    v = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "play": 4, "##ing": 5}
    assert text.word_pieces(["playing", "zzz"], v, 8) == [2, 4, 5, 1, 3, 0, 0, 0]
    assert text.word_pieces(["playing"] * 9, v, 4) == [2, 4, 5, 3]


def test_small_functions(spark):
    assert one(spark, text.file_size(lit("1,024.5"), lit("KB"))) == 1024.5 * 1024
    assert one(spark, text.file_size(lit("x"), lit("KB"))) == 0
    assert one(spark, misc.tolerant_long(lit(" 42 "))) == 42 and one(spark, misc.tolerant_long(lit("x"))) is None
    assert one(spark, misc.unix_time(lit(0))) is None
    assert one(spark, misc.hex_of_base64(lit("7x33r4Dr/BBulWWaaL71Yg=="))) == "ef1df7af80ebfc106e95659a68bef562"
    assert one(spark, misc.resolve_url(lit("https://x.org/b/"), lit("//i.x.org/1.png"))) == "https://i.x.org/1.png"
    assert one(spark, misc.resolve_url(lit("https://x.org/b"), lit("/src/1.png"))) == "https://x.org/src/1.png"
    assert one(spark, misc.stored_path(lit("abcdef"), lit(".png"))) == "full/ab/cd/abcdef.png"
    assert one(spark, misc.first_text(lit(""), lit(None).cast("string"), lit("z"))) == "z"
    assert one(spark, misc.human_size(lit(2048))) == "2.0 KB"
    assert one(spark, text.safe_url(lit("JavaScript:x"))) is False and one(spark, text.safe_url(lit("data:image/png;base64,x"))) is True
    assert one(spark, misc.extension_of_type(lit("video/webm"))) == ".webm" and one(spark, misc.extension_of_type(lit("x/y"))) == ".bin"


@pytest.mark.parametrize("kind, value, want", [("volume", 6.0, "critical"), ("volume", 3.5, "high"), ("burst", 15.0, "critical"), ("burst", 5.0, "high"), ("coordination", 10.0, "critical"), ("coordination", 3.0, "high"), ("other", 9.0, "medium")])
def test_severity(spark, kind, value, want):
    assert one(spark, misc.severity(lit(kind), lit(value))) == want


@pytest.mark.parametrize("source, n", [("board:g", 1), ("site:fourchan board:pol", 2), ("not board:g", 1), ("hello world", 1), ('board:"gaming" text:"hello world"', 2), ("has:image", 1), ("", 0), ("  board:g  ", 1), ("!sage:true", 1)])
def test_dsl_counts(source, n):
    assert len(dsl.parse(source).filters) == n


def test_dsl_parts():
    from datetime import datetime

    assert dsl.parse("board:g").filters[0] == dsl.Filter("board", ":", "g")
    assert dsl.parse("before:2024-01-01").filters[0].value == datetime(2024, 1, 1)
    assert dsl.parse("after:2024-01-01T10:00:00Z").filters[0].value == datetime(2024, 1, 1, 10)
    assert dsl.parse("has:image").filters[0].field == "has_image"
    assert dsl.parse("limit:50").limit == 50 and dsl.parse("offset:100").offset == 100
    assert dsl.parse("sort:timestamp asc").sort == ("timestamp", "asc") and dsl.parse("sort:timestamp").sort == ("timestamp", "desc")
    assert dsl.parse("not board:g").filters[0].negated
    assert dsl.parse("hello big world").filters[0] == dsl.Filter("text", "~", "hello big world")
    assert [f.op for s in (">=100", "timestamp>1000", "replies>=5", "board!=g", "board=g") for f in dsl.parse(s).filters] == [">=", ">", ">=", "!=", ":"]
    assert dsl.vector_text(dsl.parse('semantic:"old cameras" board:g')) == "old cameras"


@pytest.mark.parametrize("source", ["(", "board:", "limit:x", "has:", "date:12:99:99", "board:g )"])
def test_dsl_mistakes_have_positions(source):
    with pytest.raises(dsl.DslError) as e:
        dsl.parse(source)
    assert 0 <= e.value.position <= len(source)


def test_dsl_unknown_field(spark):
    df = spark.createDataFrame([(1,)], "post_id long")
    with pytest.raises(dsl.DslError):
        dsl.apply(dsl.parse("colour:red"), df, df, df)


def test_dsl_like_is_literal(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",)], "author_name string")
    assert [r[0] for r in df.where(dsl.predicate(dsl.Filter("author", "~", "50%"))).collect()] == ["50% off"]


def test_recall_and_ndcg(spark):
    hits = spark.createDataFrame([(1, p, r) for r, p in enumerate([10, 11, 12], 1)] + [(2, 10, 1)], "query_id long, post_id long, rank int")
    judged = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (1, 12, 1), (1, 13, 0)], "query_id long, post_id long, grade int")
    assert dict(evaluation.recall(hits, judged, 3).collect()) == {1: 1.0, 2: 0.0}
    assert dict(evaluation.recall(hits, judged, 1).collect())[1] == pytest.approx(1 / 3)
    assert dict(evaluation.ndcg(hits, judged, 3).collect()) == {1: pytest.approx(1.0), 2: 0.0}
    back = spark.createDataFrame([(1, 12, 1), (1, 11, 2), (1, 10, 3)], "query_id long, post_id long, rank int")
    assert evaluation.ndcg(back, judged, 3).first()["ndcg"] == pytest.approx(0.840303, abs=1e-3)


@pytest.mark.parametrize("values, p, want", [([1, 2, 3, 4, 5], 50, 3), (list(range(1, 11)), 25, 3), (list(range(1, 11)), 75, 7), ([1, 1, 1, 2, 2, 3], 50, 1), ([], 50, 0)])
def test_percentile(spark, values, p, want):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert df.agg(evaluation.percentile(F.col("v"), p)).first()[0] == want


def test_arms_that_fail_have_no_hits():
    ticks = iter(range(100))
    got = evaluation.run({"good": lambda q, k: [q], "bad": lambda q, k: 1 / 0}, [(1, 7)], 5, lambda: next(ticks))
    assert [(a, h) for a, _, h, _ in got] == [("good", [7]), ("bad", [])]
