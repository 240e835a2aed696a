import pytest
from pyspark.sql import functions as F

from grainmill.functions import arrays, text


def one(spark, value, expr, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "s",
    ["\n\t x \r\n", " x ", "　x ", "\u001cx\u001f", "﻿x", " \u0085  ", "a b ", "", "​x"],
)
def test_strip_is_the_unicode_strip(spark, s):
    assert one(spark, s, text.strip) == s.strip()


@pytest.mark.parametrize(
    "t, want",
    [
        ("<|answer|>a<|end|><|answer|> b <|end|>c", "b"), ("<|answer|>7", "7"), ("<|answer|> <|end|>", None),
        ("none here<|end|>", None), ("<|answer|><|end|>x", None), ("<|end|><|answer|> q\u3000", "q"),
    ],
)
def test_extract_answer(spark, t, want):
    assert one(spark, t, text.extract_answer) == want


@pytest.mark.parametrize("answer, expected, ok", [("14", "4", True), ("Forty", "FORT", True), (None, "4", False), ("5", "4", False)])
def test_answer_matches_is_a_substring_test(spark, answer, expected, ok):
    df = spark.createDataFrame([(answer, expected)], "a string, e string")
    assert df.select(text.answer_matches(F.col("a"), F.col("e")).alias("r")).first()["r"] is ok


def test_atomic_pretokens_keep_markers_whole(spark):
    got = one(spark, "<|problem|>a b!<|end|><|end|> <|pad", text.pretokens_atomic)
    assert got == ["<|problem|>", "a", " b", "!", "<|end|>", "<|end|>", " <|", "pad"]


def test_pretokens_concatenate_to_the_text(spark):
    s = "It's  a\n\n test 　 x1 ½  'll  "
    assert "".join(one(spark, s, text.pretokens)) == s


def test_array_helpers(spark):
    ids = "v array<int>"
    assert one(spark, [1, 2, 3, 4, 5], lambda c: arrays.last_n(c, 3), ids) == [3, 4, 5]
    assert one(spark, [1, 2], lambda c: arrays.last_n(c, 3), ids) == [1, 2]
    assert one(spark, [7, 4, 9, 4], arrays.cut_at_stop, ids) == [7, 4]
    assert one(spark, [7, 9], arrays.cut_at_stop, ids) == [7, 9]
    assert one(spark, [], arrays.append_token, ids) == [4]
    assert one(spark, [1, 2, 3], lambda c: F.struct(*arrays.shift_pair(c, 2)), ids) == ([1, 2], [2, 3])
