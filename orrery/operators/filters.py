"""The payload filter language: nine leaves and a boolean node, compiled to a Column.

A filter is a dict such as {"bool": {"must": [...], "should": [...], "filter": [...], "must_not": [...]}} or a leaf
{"term": {"field": f, "value": v}}; leaves may also be spelled without the inner dict's braces, as {"type": "term",
"field": f, "value": v}. Fields are keys of a JSON payload, or real columns with force_not_payload. Clauses of a bool
are all ANDed, should being an OR of its own; must_not is NOT (a AND b). Text that isn't a number never matches a
numeric test. Elements of JSON arrays are compared as text, numbers included.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import text as T

LEAVES = ("match", "term", "terms", "any", "all", "match_phrase", "exists", "wildcard", "range")


def literal_type(value: Any) -> str:
    """bool before int: Python's bool is an int."""
    if isinstance(value, bool):
        return "boolean"
    return "double" if isinstance(value, int | float) else "string"


def group_by_type(values: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for v in values:
        out.setdefault(literal_type(v), []).append(v)
    return out


def _path(field: str) -> str:
    return "$." + ".".join(f"['{p}']" if not p.isidentifier() else p for p in field.split("."))


def _text(spec: dict, payload: Column) -> Column:
    if spec.get("force_not_payload"):
        return F.col(spec["field"]).cast("string")
    return F.get_json_object(payload, _path(spec["field"]))


def _number(spec: dict, payload: Column) -> Column:
    return _text(spec, payload).try_cast("double")


def _array(spec: dict, payload: Column) -> Column:
    if spec.get("force_not_payload"):
        return F.col(spec["field"]).cast("array<string>")
    return F.from_json(_text(spec, payload), "array<string>")


def _equal(spec: dict, payload: Column, value: Any) -> Column:
    kind = literal_type(value)
    if kind == "double":
        return _number(spec, payload) == F.lit(float(value))
    return _text(spec, payload) == F.lit(str(value).lower() if kind == "boolean" else value)


def _leaf(kind: str, spec: dict, payload: Column) -> Column:
    value = spec.get("value")
    if kind == "match":
        return T.text_query(T.tokens(_text(spec, payload)), str(value))
    if kind == "term":
        return _equal(spec, payload, value)
    if kind == "terms":
        values = spec.get("values", value)
        return reduce(lambda a, b: a | b, [_equal(spec, payload, v) for v in values]) if values else F.lit(True)
    if kind in ("any", "all"):
        values = F.array(*[F.lit(str(v)) for v in spec.get("values", value)]).cast("array<string>")
        arr = _array(spec, payload)
        return F.arrays_overlap(arr, values) if kind == "any" else F.size(F.array_except(values, arr)) == 0
    if kind == "match_phrase":
        return T.has_phrase(T.tokens(_text(spec, payload)), T.split_words(str(value)))
    if kind == "exists":
        if spec.get("force_not_payload"):
            return F.col(spec["field"]).isNotNull()
        *above, key = spec["field"].split(".")
        holder = F.get_json_object(payload, _path(".".join(above))) if above else payload
        return F.array_contains(F.json_object_keys(holder), key)
    if kind == "wildcard":
        toks = T.tokens(_text(spec, payload))
        words = [w for w in str(value).lower().split() if w.strip("*")]
        tests = [T.has_prefix(toks, w.rstrip("*")) if w.endswith("*") else F.array_contains(toks, w) for w in words]
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)
    if kind == "range":
        bounds = spec.get("range") or {k: spec[k] for k in ("gte", "lte", "gt", "lt", "eq") if spec.get(k) is not None}
        n = _number(spec, payload)
        tests = {"gte": lambda x: n >= x, "lte": lambda x: n <= x, "gt": lambda x: n > x, "lt": lambda x: n < x, "eq": lambda x: n == x}
        found = [tests[k](F.lit(float(x))) for k, x in bounds.items() if x is not None]
        return reduce(lambda a, b: a & b, found) if found else F.lit(True)
    return F.lit(True)


def compile_filter(spec: dict | None, payload: str | Column = "payload") -> Column:
    """A Column that is true where the filter holds and never null. A kind that is not known holds everywhere, as an empty filter does."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    if not spec:
        return F.lit(True)
    if "type" in spec:
        kind, spec = spec["type"], {k: v for k, v in spec.items() if k != "type"}
    else:
        found = [k for k in spec if k in LEAVES or k in ("bool", "query")]
        if len(found) > 1:
            raise ValueError(f"one filter kind expected, got {sorted(spec)}")
        if not found:
            return F.lit(True)
        kind, spec = found[0], spec[found[0]]
    if kind == "query":
        return compile_filter(spec, payload)
    if kind != "bool":
        return F.coalesce(_leaf(kind, spec, payload), F.lit(False))
    out = F.lit(True)
    for clause in ("must", "filter"):
        for x in spec.get(clause) or []:
            out = out & compile_filter(x, payload)
    if spec.get("should"):
        out = out & reduce(lambda a, b: a | b, [compile_filter(x, payload) for x in spec["should"]])
    if spec.get("must_not"):
        out = out & ~reduce(lambda a, b: a & b, [compile_filter(x, payload) for x in spec["must_not"]])
    return out


def relaxed(df: DataFrame, conditions: list[Column], least: int = 2) -> DataFrame:
    """Rows that meet at least so many conditions, with match_count; one pass in place of a union over all subsets."""
    count = reduce(lambda a, b: a + b, [F.coalesce(c.cast("int"), F.lit(0)) for c in conditions])
    return df.withColumn("match_count", count).where(F.col("match_count") >= least)


def subsets(items: list, size: int) -> list[tuple]:
    return list(combinations(items, size))
