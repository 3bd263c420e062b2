"""JSON documents as values: canonical hashes, schema errors, page ids, catalogues, lookups, masked comparison, privacy.

Each function works on Arrow batches of JSON texts, one document at a time; nothing but its
result leaves the task.  Null and unreadable texts give null (an empty list for errors of
nothing: the text itself is the error).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Children of these keys keep their order; all other objects are sorted by key.
ORDERED = ("pages", "nodes")


def _load(text: str | None):
    value = json.loads(text)
    return json.loads(value) if isinstance(value, str) and value[:1] in "{[" else value


def _over(column: pa.Array, function: Callable, kind: pa.DataType) -> pa.Array:
    out = []
    for text in column.to_pylist():
        try:
            out.append(None if text is None else function(_load(text)))
        except (ValueError, RecursionError):
            out.append(None)
    return pa.array(out, kind)


def canonical(value, parent: str = "") -> str:
    """JSON text without spaces, keys sorted but below ``pages`` and ``nodes``."""
    if isinstance(value, list):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, dict):
        keys = list(value) if parent in ORDERED else sorted(value)
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k], k)}" for k in keys) + "}"
    return json.dumps(value, ensure_ascii=False)


@F.arrow_udf(T.StringType())
def document_hash(column: pa.Array) -> pa.Array:
    """SHA-256 of the canonical text."""
    return _over(column, lambda v: hashlib.sha256(canonical(v).encode("utf-8", "surrogatepass")).hexdigest(), pa.string())


def page_ids(value) -> list[str]:
    """Page ids in first-seen order: pages of arrays and maps, and ids named in context."""
    seen: dict[str, None] = {}
    stack = [("", value)]
    while stack:
        key, v = stack.pop()
        if isinstance(v, dict):
            for name in ("pageId", "page_id"):
                if isinstance(v.get(name), str):
                    seen.setdefault(v[name])
            if key == "pages":
                for k, page in v.items():
                    seen.setdefault(page["id"] if isinstance(page, dict) and isinstance(page.get("id"), str) else k)
            stack.extend((k, v[k]) for k in reversed(list(v)))
        elif isinstance(v, list):
            if key == "pages":
                for page in v:
                    found = page if isinstance(page, str) else page.get("id", page.get("pageId")) if isinstance(page, dict) else None
                    if isinstance(found, str):
                        seen.setdefault(found)
            stack.extend((key if isinstance(x, list) else "", x) for x in reversed(v))
    return list(seen)


@F.arrow_udf(T.ArrayType(T.StringType()))
def document_page_ids(column: pa.Array) -> pa.Array:
    return _over(column, page_ids, pa.list_(pa.string()))


def catalogue(value, path: str = "") -> Iterator[tuple[str, str]]:
    """(id, path) of every object with an id in a catalogue of any shape."""
    if isinstance(value, dict):
        if isinstance(value.get("id"), str):
            yield value["id"], path
        for k, v in value.items():
            yield from catalogue(v, f"{path}.{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from catalogue(v, f"{path}[{i}]")


@F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
def document_catalogue(column: pa.Array) -> pa.Array:
    """Map of ids to their last path."""
    return _over(column, lambda v: list(dict(catalogue(v)).items()), pa.map_(pa.string(), pa.string()))


def first_value(names: tuple[str, ...]):
    """A column function: the first string or number under one of the names, outer levels first."""

    def look(v):
        level = [v]
        while level:
            for x in level:
                if isinstance(x, dict):
                    for n in names:
                        if isinstance(x.get(n), (str, int, float)) and not isinstance(x.get(n), bool):
                            return str(x[n])
            level = [c for x in level for c in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
        return None

    @F.arrow_udf(T.StringType())
    def udf(column: pa.Array) -> pa.Array:
        return _over(column, look, pa.string())

    return udf


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool}


def _is(value, name: str) -> bool:
    if name in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (name == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[name]) if name in _TYPES else True


def schema_errors(schema: dict, value, path: str = "$", root: dict | None = None) -> list[str]:
    """Errors of a value against the supported keywords of a JSON Schema; others are ignored."""
    root = schema if root is None else root
    out: list[str] = []
    if isinstance(ref := schema.get("$ref"), str):
        target = root
        for part in ref.lstrip("#/").split("/"):
            target = target[part.replace("~1", "/").replace("~0", "~")]
        out += schema_errors(target, value, path, root)
    for sub in schema.get("allOf", ()):
        out += schema_errors(sub, value, path, root)
    if "if" in schema:
        branch = "else" if schema_errors(schema["if"], value, path, root) else "then"
        out += schema_errors(schema.get(branch, {}), value, path, root)
    if "not" in schema and not schema_errors(schema["not"], value, path, root):
        out.append(f"{path}: not")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: const")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: enum")
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [*out, f"{path}: type"]
    if isinstance(value, dict):
        out += [f"{path}.{k}: required" for k in schema.get("required", ()) if k not in value]
        props = schema.get("properties", {})
        for k, v in value.items():
            if k in props:
                out += schema_errors(props[k], v, f"{path}.{k}", root)
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: additional")
    if isinstance(value, list):
        out += [f"{path}: {k}" for k, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", len(value)))) if bad]
        if isinstance(schema.get("items"), dict):
            for i, v in enumerate(value):
                out += schema_errors(schema["items"], v, f"{path}[{i}]", root)
        if "contains" in schema:
            n = sum(not schema_errors(schema["contains"], v, path, root) for v in value)
            if not schema.get("minContains", 1) <= n <= schema.get("maxContains", n):
                out.append(f"{path}: contains")
    if isinstance(value, str):
        out += [f"{path}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("pattern", "pattern" in schema and not re.search(schema["pattern"], value))) if bad]
    if _is(value, "number"):
        out += [f"{path}: {k}" for k, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    return out


def schema_check(schema: dict):
    """A column function: array of errors; null texts give null, unreadable ones ``$: json``."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def udf(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            try:
                out.append(None if text is None else schema_errors(schema, _load(text)))
            except (ValueError, RecursionError):
                out.append(["$: json"])
        return pa.array(out, pa.list_(pa.string()))

    return udf


def masked_differences(before: DataFrame, after: DataFrame, keys: list[str], allowed: list[str]) -> DataFrame:
    """Rows that differ in any column but the ``allowed`` ones, with the side they stand on."""
    columns = [c for c in before.columns if c not in allowed]
    a, b = before.select(*columns), after.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after"))).select(*keys, "side")


def leaked_identifiers(reports: DataFrame, text: str, ids: DataFrame, column: str) -> DataFrame:
    """Identifiers that occur as words of a report: an equi-join on the report's words, no comparison of all with all."""
    word = F.explode(F.array_distinct(F.split(F.col(text), r"[^A-Za-z0-9_\-]+"))).alias("word")
    return reports.select(word).where("word <> ''").join(ids.select(F.col(column).alias("word")).distinct(), "word").distinct()


def merged_config(*layers: dict) -> dict:
    """Later layers over earlier ones: objects are merged, arrays and scalars replaced."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged_config(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def sanitized_completion(choices: Column) -> Column:
    """Texts of an answer's choices (array of strings) without reasoning and with plain list numbers; null where malformed."""
    from leafgauge.functions.text import numbered_list, reasoning_stripped

    return F.transform(choices, lambda c: numbered_list(reasoning_stripped(c)["text"]))
