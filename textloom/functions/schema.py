"""JSON Schema as column expressions: a schema text becomes one expression over a parsed JSON value, evaluated inside the row.

Supported are the assertions of draft 2020-12 on single values, objects and arrays, their combinations, and references inside the document that do not come
back to themselves. An assertion that is not supported is an error when the schema is compiled; it is never skipped. ``format`` and the ``content...``
keywords are annotations.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
VIOLATION = "array<struct<path:string,rule:string>>"
NOTES = {"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format",
         "contentEncoding", "contentMediaType"}


def kind(value: Column) -> Column:
    """Type of a value as text (``OBJECT<...>``, ``ARRAY<...>``, ``STRING``, ``BIGINT``, ...), null when there is no value."""
    return F.schema_of_variant(value)


def member(value: Column, key: str) -> Column:
    """Value of a key, null when the key is missing or the value is no object."""
    return F.try_variant_get(value, "$[" + json.dumps(key, ensure_ascii=False) + "]", "variant")


def number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def elements(value: Column) -> Column:
    """Elements of an array, none of another value."""
    return F.coalesce(F.when(kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")), F.array().cast("array<variant>"))


def entries(value: Column) -> Column:
    """(key, value) of an object, none of another value."""
    return F.coalesce(F.when(kind(value).startswith("OBJECT"), F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))),
                      F.map_entries(F.create_map().cast("map<string,variant>")))


def is_type(value: Column, name: str) -> Column:
    of = kind(value)
    if name in ("object", "array"):
        return of.startswith(name.upper())
    if name == "null":
        return of == "VOID"
    if name == "number":
        return of.rlike(NUMBER)
    if name == "integer":  # 5.0 is a whole number
        return of.rlike(NUMBER) & (F.floor(number(value)) == number(value))
    if name in ("string", "boolean"):
        return of == name.upper()
    raise ValueError(f"unknown type {name!r}")


def equals(value: Column, constant: object) -> Column:
    if isinstance(constant, bool):
        return (kind(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == constant)
    if constant is None:
        return is_type(value, "null")
    if isinstance(constant, (int, float)):
        return is_type(value, "number") & (number(value) == float(constant))
    if isinstance(constant, str):
        return is_type(value, "string") & (string(value) == constant)
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(constant))))


def every(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests) if tests else F.lit(True)


class Schema:
    """A compiled schema text: ``holds`` says whether a value keeps it, ``violations`` lists what it breaks, and where."""

    def __init__(self, text: str):
        self.root = json.loads(text)
        self._compile(self.root)  # so that faults of the schema show here

    def holds(self, value: Column) -> Column:
        """Whether a present value keeps the schema."""
        return self._ok(self.root, value)

    def violations(self, value: Column) -> Column:
        """Array of (path, rule) in the order of the schema, empty when the value keeps it. The path of the whole value is empty."""
        return self._found(self.root, value, F.lit(""))

    def matches(self, value: Column) -> Column:
        """How many of the alternatives of a ``oneOf`` schema a present value keeps."""
        return self._matches(value, self.root["oneOf"])

    def at(self, *steps: str | int) -> Schema:
        """The part of the schema below the given keywords."""
        out = object.__new__(Schema)
        out.root, out.part_of = reduce(lambda node, step: node[step], steps, self.root), self
        return out

    def _resolved(self, node: dict | bool, seen: tuple = ()) -> dict:
        if isinstance(node, bool):
            return {} if node else {"not": {}}
        ref = node.get("$ref")
        if ref is None:
            return node
        if ref in seen or not ref.startswith("#/"):
            raise ValueError(f"reference {ref!r} leaves the document or comes back to itself")
        top = self
        while hasattr(top, "part_of"):
            top = top.part_of
        steps = [s.replace("~1", "/").replace("~0", "~") for s in ref[2:].split("/")]
        found = reduce(lambda n, s: n[int(s)] if isinstance(n, list) else n[s], steps, top.root)
        return {"allOf": [self._resolved(found, (*seen, ref))], **{k: v for k, v in node.items() if k != "$ref"}}

    def _compile(self, node: dict | bool, seen: tuple = ()) -> None:
        """Walk through the whole schema once, as the expressions will; an endless one and unknown keywords are errors."""
        if isinstance(node, dict) and "$ref" in node:
            if node["$ref"] in seen:
                raise ValueError(f"reference {node['$ref']!r} comes back to itself")
            seen = (*seen, node["$ref"])
        node = self._resolved(node)
        unknown = set(node) - NOTES - set(self.RULES) - set(self.NESTED)
        if unknown:
            raise ValueError(f"unsupported keywords {sorted(unknown)}")
        for key in ("properties", "patternProperties"):
            for sub in node.get(key, {}).values():
                self._compile(sub, seen)
        for key in ("oneOf", "anyOf", "allOf", "prefixItems"):
            for sub in node.get(key, []):
                self._compile(sub, seen)
        for key in ("items", "additionalProperties", "not", "contains"):
            if key in node:
                self._compile(node[key], seen)
        for name in node["type"] if isinstance(node.get("type"), list) else [node["type"]] if "type" in node else []:
            is_type(F.lit(None).cast("variant"), name)

    # Rules on the value itself: each gives the test that must hold. A rule on numbers holds for everything else, and so on.
    def _type(self, v: Column, names: str | list, node: dict) -> Column:
        return reduce(Column.__or__, [is_type(v, n) for n in (names if isinstance(names, list) else [names])])

    @staticmethod
    def _numeric(test: Callable[[Column, float], Column]) -> Callable:
        return lambda self, v, limit, node: ~is_type(v, "number") | test(number(v), float(limit))

    @staticmethod
    def _textual(test: Callable[[Column, object], Column]) -> Callable:
        return lambda self, v, limit, node: ~is_type(v, "string") | test(string(v), limit)

    @staticmethod
    def _sized(name: str, items: Callable[[Column], Column], test: Callable[[Column, int], Column]) -> Callable:
        return lambda self, v, limit, node: ~is_type(v, name) | test(F.size(items(v)), limit)

    def _matches(self, v: Column, schemas: list) -> Column:
        return reduce(Column.__add__, [self._ok(s, v).cast("int") for s in schemas])

    def _unique(self, v: Column, wanted: bool, node: dict) -> Column:
        texts = F.transform(elements(v), lambda x: F.to_json(x))
        return F.lit(True) if not wanted else F.size(F.array_distinct(texts)) == F.size(texts)

    def _contains(self, v: Column, schema: dict, node: dict) -> Column:
        n = F.size(F.filter(elements(v), lambda x: self._ok(schema, x)))
        test = n >= node.get("minContains", 1)
        return ~is_type(v, "array") | (test & (n <= node["maxContains"]) if "maxContains" in node else test)

    RULES: dict[str, Callable] = {}
    NESTED = ("required", "properties", "patternProperties", "additionalProperties", "items", "prefixItems", "allOf", "minContains", "maxContains")

    def _ok(self, node: dict | bool, v: Column) -> Column:
        node = self._resolved(node)
        tests = [self.RULES[k](self, v, limit, node) for k, limit in node.items() if k in self.RULES]
        tests += [~is_type(v, "object") | member(v, k).isNotNull() for k in node.get("required", [])]
        tests += [self._ok(s, v) for s in node.get("allOf", [])]
        for key, sub in node.get("properties", {}).items():
            tests.append(member(v, key).isNull() | self._ok(sub, member(v, key)))
        keeps = lambda p, s: lambda e: ~e["key"].rlike(p) | self._ok(s, e["value"])
        tests += [F.forall(entries(v), keeps(p, s)) for p, s in node.get("patternProperties", {}).items()]
        if "additionalProperties" in node:
            tests.append(F.forall(entries(v), lambda e: self._is_listed(e["key"], node) | self._ok(node["additionalProperties"], e["value"])))
        first = node.get("prefixItems", [])
        for i, sub in enumerate(first):
            x = F.get(elements(v), F.lit(i))
            tests.append(x.isNull() | self._ok(sub, x))
        if "items" in node:
            tests.append(F.forall(F.slice(elements(v), F.lit(len(first) + 1), F.size(elements(v)) + 1) if first else elements(v),
                                  lambda x: self._ok(node["items"], x)))
        return F.coalesce(every(tests), F.lit(False))

    @staticmethod
    def _is_listed(key: Column, node: dict) -> Column:
        return reduce(Column.__or__, [key.rlike(p) for p in node.get("patternProperties", {})], key.isin(*node.get("properties", {})) if node.get("properties") else F.lit(False))

    def _found(self, node: dict | bool, v: Column, path: Column) -> Column:
        node = self._resolved(node)
        none = F.array().cast(VIOLATION)
        below = lambda key: F.concat(path, F.when(path == "", "").otherwise("."), key)
        place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        broken = lambda test, where, rule: F.when(~F.coalesce(test, F.lit(False)), F.struct(where.alias("path"), F.lit(rule).alias("rule")))
        own = [broken(self.RULES[k](self, v, limit, node), path, k) for k, limit in node.items() if k in self.RULES]
        own += [broken(~is_type(v, "object") | member(v, k).isNotNull(), below(F.lit(k)), "required") for k in node.get("required", [])]
        parts = [F.filter(F.array(*own), lambda x: x.isNotNull())] if own else []
        parts += [self._found(s, v, path) for s in node.get("allOf", [])]
        for key, sub in node.get("properties", {}).items():
            parts.append(F.when(member(v, key).isNull(), none).otherwise(self._found(sub, member(v, key), below(F.lit(key)))))
        breaks = lambda p, s: lambda e: F.when(e["key"].rlike(p), self._found(s, e["value"], below(e["key"]))).otherwise(none)
        parts += [F.flatten(F.transform(entries(v), breaks(p, s))) for p, s in node.get("patternProperties", {}).items()]
        if "additionalProperties" in node:
            more = node["additionalProperties"]
            parts.append(F.flatten(F.transform(entries(v), lambda e: F.when(self._is_listed(e["key"], node), none).otherwise(
                F.array(F.struct(below(e["key"]).alias("path"), F.lit("additionalProperties").alias("rule"))) if more is False
                else self._found(more, e["value"], below(e["key"]))))))
        first = node.get("prefixItems", [])
        for i, sub in enumerate(first):
            x = F.get(elements(v), F.lit(i))
            parts.append(F.when(x.isNull(), none).otherwise(self._found(sub, x, place(F.lit(i)))))
        if "items" in node:
            each = lambda x, i: F.when(i < len(first), none).otherwise(self._found(node["items"], x, place(i)))
            parts.append(F.flatten(F.transform(elements(v), each)))
        return F.concat(*parts) if parts else none


Schema.RULES = {
    "type": Schema._type,
    "const": lambda self, v, c, node: equals(v, c),
    "enum": lambda self, v, cs, node: reduce(Column.__or__, [equals(v, c) for c in cs]),
    "minimum": Schema._numeric(lambda x, n: x >= n), "maximum": Schema._numeric(lambda x, n: x <= n),
    "exclusiveMinimum": Schema._numeric(lambda x, n: x > n), "exclusiveMaximum": Schema._numeric(lambda x, n: x < n),
    "multipleOf": Schema._numeric(lambda x, n: F.floor(x / n) == x / n),
    "minLength": Schema._textual(lambda x, n: F.length(x) >= n), "maxLength": Schema._textual(lambda x, n: F.length(x) <= n),
    "pattern": Schema._textual(lambda x, p: x.rlike(p)),
    "minItems": Schema._sized("array", elements, lambda x, n: x >= n), "maxItems": Schema._sized("array", elements, lambda x, n: x <= n),
    "minProperties": Schema._sized("object", entries, lambda x, n: x >= n), "maxProperties": Schema._sized("object", entries, lambda x, n: x <= n),
    "uniqueItems": Schema._unique, "contains": Schema._contains,
    "oneOf": lambda self, v, s, node: self._matches(v, s) == 1, "anyOf": lambda self, v, s, node: self._matches(v, s) > 0,
    "not": lambda self, v, s, node: ~self._ok(s, v),
}
