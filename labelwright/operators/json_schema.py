"""JSON Schema documents compiled to column expressions.

A schema becomes one list of rules, each a test of the value it is about; a
record's violations are one array expression, so that validating any number of
records is a pass without a shuffle or Python.

Keywords: type, required, properties, items, enum, const, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern, minItems,
maxItems.  Keywords that only describe (title, description, $schema) are passed
over, any other one is refused by name: a contract is never half tested.

A row cannot tell an absent value from a null one.  A required value that is
null is a violation unless its type allows null; an optional one is not.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Test = Callable[[Column], Column]
_NOTES = frozenset(("$schema", "$id", "title", "description", "default", "examples"))
_KINDS = {
    "string": (T.StringType,), "boolean": (T.BooleanType,), "array": (T.ArrayType,), "object": (T.StructType,),
    "integer": (T.IntegralType, T.FractionalType), "number": (T.NumericType,),
}
_BOUNDS: dict[str, tuple[str, Callable[[Column, object], Column]]] = {
    "minimum": ("number", lambda c, v: c < v), "maximum": ("number", lambda c, v: c > v),
    "exclusiveMinimum": ("number", lambda c, v: c <= v), "exclusiveMaximum": ("number", lambda c, v: c >= v),
    "minLength": ("string", lambda c, v: F.char_length(c) < v), "maxLength": ("string", lambda c, v: F.char_length(c) > v),
    "pattern": ("string", lambda c, v: ~c.rlike(v)),
    "minItems": ("array", lambda c, v: F.size(c) < v), "maxItems": ("array", lambda c, v: F.size(c) > v),
}


def violations(schema: dict | str, value: Column, kind: T.DataType) -> Column:
    """Rules of ``schema`` (a document or its text) that ``value`` of type ``kind`` breaks, as ``path: keyword``, in the schema's order."""
    document = json.loads(schema) if isinstance(schema, str) else schema
    rules = list(_rules(document, kind, "", required=True))
    broken = [F.when(F.coalesce(test(value), F.lit(False)), F.lit(f"{path or '$'}: {keyword}")) for path, keyword, test in rules]
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def _types(schema: dict) -> list[str]:
    asked = schema.get("type", [])
    return [asked] if isinstance(asked, str) else list(asked)


def _rules(schema: dict, kind: T.DataType | None, path: str, required: bool) -> Iterator[tuple[str, str, Test]]:
    """(path, keyword, whether the value breaks it)."""
    types = _types(schema)
    if required and "null" not in types:
        yield path, "required", lambda c: c.isNull()
    if kind is None or isinstance(kind, T.NullType):
        # No such column: always null, and nothing below it can be wrong.
        return
    named = [t for t in types if t != "null"]
    if named and not any(isinstance(kind, _KINDS[t]) for t in named):
        yield path, "type", lambda c: c.isNotNull()
        return
    if named == ["integer"] and isinstance(kind, T.FractionalType):
        yield path, "type", lambda c: c.isNotNull() & (c != F.floor(c))
    for keyword, wanted in schema.items():
        if keyword in _BOUNDS:
            about, test = _BOUNDS[keyword]
            if isinstance(kind, _KINDS[about]):
                yield path, keyword, lambda c, test=test, wanted=wanted: test(c, wanted)
        elif keyword in ("enum", "const"):
            allowed = [v for v in (wanted if keyword == "enum" else [wanted]) if v is not None]
            yield path, keyword, lambda c, allowed=allowed: c.isNotNull() & ~c.isin(*allowed)
        elif keyword not in _NOTES and keyword not in ("type", "required", "properties", "items"):
            raise ValueError(f"{path or '$'}: keyword {keyword} is not known")
    if isinstance(kind, T.StructType):
        yield from _members(schema, kind, path)
    if isinstance(kind, T.ArrayType) and "items" in schema:
        for below, keyword, test in _rules(schema["items"], kind.elementType, f"{path}[]", required=True):
            yield below, keyword, lambda c, test=test: F.exists(c, lambda x: test(x))


def _members(schema: dict, kind: T.StructType, path: str) -> Iterator[tuple[str, str, Test]]:
    needed = set(schema.get("required", []))
    members = dict(schema.get("properties", {}))
    for name in [*members, *(n for n in schema.get("required", []) if n not in members)]:
        inner = kind[name].dataType if name in kind.names else None
        for below, keyword, test in _rules(members.get(name, {}), inner, f"{path}.{name}".lstrip("."), name in needed):
            # Below a null object nothing is asked.
            yield below, keyword, lambda c, name=name, inner=inner, test=test: c.isNotNull() & test(
                F.lit(None) if inner is None else c.getField(name))
