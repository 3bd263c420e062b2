import pytest
from pyspark.sql import functions as F

from leafgauge.functions import text as X


def one(spark, expr, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(expr(*[F.col(n) for n in names]).alias("r")).first().r


def test_normal_forms(spark):
    assert one(spark, X.normalized, " Ａ　B\n") == "AB"
    assert one(spark, X.normalized, "﻿a") == "﻿a"
    assert one(spark, X.normalized_script, "﻿a b") == "ab"
    assert one(spark, X.normalized, None) is None
    assert one(spark, X.utf16_length, "a😀猫") == 4
    assert one(spark, lambda a, b: X.error_rate(X.normalized_script(a), X.normalized_script(b)), "１２３", "123") == 0


@pytest.mark.parametrize(
    "text,reasons",
    [(None, ["candidate-missing"]), ("x�", ["replacement-character"]), ("x‮", ["bidi-control"]), ("x\u0007", ["forbidden-control"]), ("  ", ["empty-text"]), ("�\u0001‎", ["replacement-character", "forbidden-control", "bidi-control"]), ("ok", [])],
)
def test_hard_reasons(spark, text, reasons):
    assert one(spark, lambda c: X.hard_reasons(c, X.normalized(c)), text) == reasons


def test_lone_surrogates_in_raw_json(spark):
    assert one(spark, X.lone_surrogate, '{"a":"\\ud83d"}')
    assert one(spark, X.lone_surrogate, '{"a":"\\ude00"}')
    assert not one(spark, X.lone_surrogate, '{"a":"\\ud83d\\ude00"}')


def test_runs_and_blocks(spark):
    assert one(spark, X.longest_run, "aabbbba") == 4
    assert one(spark, X.longest_run, "") == 0
    assert one(spark, X.repeated_block, "xabcabcabc")
    assert not one(spark, X.repeated_block, "abcabcab")
    assert one(spark, X.significant_tokens, "テスト123！？4") == ["123", "！？", "4"]
    assert one(spark, X.scripts, "猫のカa1") == ["han", "hiragana", "katakana", "latin", "number"]


def test_reasoning_and_lists(spark):
    assert tuple(one(spark, X.reasoning_stripped, " <think>a</think> b ")) == ("ok", "b")
    assert tuple(one(spark, X.reasoning_stripped, "<think>a")) == ("unterminated", None)
    assert tuple(one(spark, X.reasoning_stripped, "a <think>b</think>")) == ("format-invalid", None)
    assert tuple(one(spark, X.reasoning_stripped, "plain ")) == ("ok", "plain")
    assert one(spark, X.numbered_list, "1：a\n2﹕b") == "1: a\n2: b"
    assert one(spark, X.numbered_list, "1：a\n3：b") == "1：a\n3：b"


@pytest.mark.parametrize("raw,safe", [("a\\b.png", "a/b.png"), ("../a", None), ("/a", None), ("C:x", None), ("a/./b", None), ("a.", None), ("a\0b", None), ("d/1.png", "d/1.png")])
def test_archive_paths(spark, raw, safe):
    assert one(spark, X.archive_path, raw) == safe


def test_names(spark):
    rows = spark.createDataFrame([("10.png",), ("2.png",), ("A1.png",), ("a02.png",)], "n string")
    assert [r.n for r in rows.orderBy(X.natural_key(F.col("n"))).collect()] == ["2.png", "10.png", "A1.png", "a02.png"]
    assert one(spark, X.slug, " Ａb c/ ") == "ab-c"
    assert one(spark, X.same_version, "v1.2.3+x", "1.2.3")
    assert one(spark, X.is_loopback, "http://127.0.0.1:80/a") and not one(spark, X.is_loopback, "http://example.org")
