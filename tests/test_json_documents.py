import json

from pyspark.sql import functions as F

from leafgauge.operators import json_documents as J


def test_values(spark):
    a = {"b": 1, "a": [1, {"d": 1, "c": "é"}], "pages": {"p2": {"id": "x"}, "p1": {}}}
    b = {"a": [1, {"c": "é", "d": 1}], "pages": {"p2": {"id": "x"}, "p1": {}}, "b": 1}
    swapped = {**b, "pages": {"p1": {}, "p2": {"id": "x"}}}
    df = spark.createDataFrame([(json.dumps(x),) for x in (a, b, swapped)] + [(None,), ("{",)], "t string")
    h = [r.h for r in df.select(J.document_hash("t").alias("h")).collect()]
    assert h[0] == h[1] != h[2] and h[3:] == [None, None]
    assert [r.p for r in df.select(J.document_page_ids("t").alias("p")).collect()] == [["x", "p1"], ["x", "p1"], ["p1", "x"], None, None]
    cat = spark.createDataFrame([('{"e":[{"id":"a"},{"id":"b"}],"f":{"id":"a","status":"done"}}',)], "t string")
    assert cat.select(J.document_catalogue("t").alias("m")).first().m == {"a": "f", "b": "e[1]"}
    assert cat.select(J.first_value(("state", "status"))("t").alias("s")).first().s == "done"


def test_schema(spark):
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "minItems": 1, "items": {"type": "string", "pattern": "^x"}}, "c": {"enum": [1, 2]}}}
    df = spark.createDataFrame([('{"a":1}',), ('{"a":0,"z":1}',), ('{"b":["y"],"c":3}',), ("[]",), ("{",), (None,)], "t string")
    got = [r.e for r in df.select(J.schema_check(schema)("t").alias("e")).collect()]
    assert got == [[], ["$.a: minimum", "$.z: additional"], ["$.a: required", "$.b[0]: pattern", "$.c: enum"], ["$: type"], ["$: json"], None]
    assert J.schema_errors({"if": {"required": ["a"]}, "then": {"required": ["b"]}, "not": {"required": ["c"]}}, {"a": 1, "c": 1}) == ["$.b: required", "$: not"]


def test_comparison_and_privacy(spark):
    before = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, text string")
    after = spark.createDataFrame([("a", 1, "changed"), ("b", 3, "y")], "k string, v int, text string")
    assert sorted(tuple(r) for r in J.masked_differences(before, after, ["k"], ["text"]).collect()) == [("b", "after"), ("b", "before")]
    reports = spark.createDataFrame([('{"id":"rg-1 x"}',), (None,)], "t string")
    assert [r.word for r in J.leaked_identifiers(reports, "t", spark.createDataFrame([("rg-1",), ("rg-2",)], "id string"), "id").collect()] == ["rg-1"]
    assert J.merged_config({"a": {"b": 1, "c": [1]}, "d": 1}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}, "d": 1}
    df = spark.createDataFrame([(["<think>x</think> 1：a", "<think>y"],)], "c array<string>")
    assert df.select(J.sanitized_completion(F.col("c")).alias("s")).first().s == ["1: a", None]
