"""The schema compiler against a plain reading of the same schema, value by value."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelwright.fixed.contracts import CONTRACTS
from labelwright.operators.json_schema import violations


def broken(schema, value, path="", required=True):
    """Violations of one Python value, by walking schema and value together."""
    types = [schema["type"]] if isinstance(schema.get("type"), str) else schema.get("type", [])
    if value is None:
        return [(path, "required")] if required and "null" not in types else []
    out = []
    if types == ["integer"] and value != int(value):
        out.append((path, "type"))
    if "null" in types and "integer" in types and value != int(value):
        out.append((path, "type"))
    tests = {
        "minimum": lambda v, b: v < b, "maximum": lambda v, b: v > b, "minLength": lambda v, b: len(v) < b, "maxLength": lambda v, b: len(v) > b,
        "minItems": lambda v, b: len(v) < b, "maxItems": lambda v, b: len(v) > b, "enum": lambda v, b: v not in b,
        "exclusiveMinimum": lambda v, b: v <= b, "exclusiveMaximum": lambda v, b: v >= b, "const": lambda v, b: v != b,
    }
    out += [(path, k) for k, b in schema.items() if k in tests and tests[k](value, b)]
    for name, inner in schema.get("properties", {}).items():
        out += broken(inner, value.get(name), f"{path}.{name}".lstrip("."), name in schema.get("required", []))
    if "items" in schema and isinstance(value, list):
        for v in value:
            out += broken(schema["items"], v, f"{path}[]")
    return out


def columns_of(schema):
    types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
    kind = next(t for t in types if t != "null")
    if kind == "object":
        return T.StructType([T.StructField(n, columns_of(s)) for n, s in schema["properties"].items()])
    if kind == "array":
        return T.ArrayType(columns_of(schema["items"]))
    return {"string": T.StringType(), "number": T.DoubleType(), "integer": T.DoubleType(), "boolean": T.BooleanType()}[kind]


def made(schema, rng):
    """A value that keeps or breaks the schema by chance."""
    if rng.random() < 0.12:
        return None
    types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
    kind = next(t for t in types if t != "null")
    if kind == "object":
        return {n: made(s, rng) for n, s in schema["properties"].items()}
    if kind == "array":
        return [made(schema["items"], rng) for _ in range(rng.choice([0, 1, 3, 4, 4, 5]))]
    return {"string": lambda: rng.choice(["", "a", "long text"]), "number": lambda: rng.choice([-0.5, 0.0, 0.4, 1.0, 1.5]),
            "integer": lambda: rng.choice([1.0, 2.5, -3.0]), "boolean": lambda: rng.random() < 0.5}[kind]()


EXTRA = {"type": "object", "required": ["a", "c"], "properties": {
    "a": {"type": "string", "minLength": 1, "maxLength": 3, "enum": ["a", "b"]}, "b": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1},
    "c": {"type": "array", "items": {"type": "array", "items": {"type": "integer"}, "maxItems": 3}}}}


@pytest.mark.parametrize("name", [*CONTRACTS, "extra"])
def test_records_against_a_plain_reading(spark, name):
    schema, rng = CONTRACTS.get(name, EXTRA), random.Random(5)
    kind = columns_of(schema)
    rows = [(i, made(schema, rng)) for i in range(400)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("r", kind)]))
    got = {r.i: r.v for r in df.select("i", violations(json.dumps(schema), F.col("r"), kind).alias("v")).collect()}
    for i, value in rows:
        want = {f"{p or '$'}: {k}" for p, k in broken(schema, value)}
        assert set(got[i]) == want and len(got[i]) == len(want), value


def test_absent_columns_types_and_unknown_keywords(spark):
    schema = {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "string"}, "y": {"type": "number"}, "z": {"type": "string"}}}
    df = spark.range(1).select(F.struct(F.lit("3").alias("y")).alias("r"))
    kind = df.schema["r"].dataType
    assert df.select(violations(schema, F.col("r"), kind)).first()[0] == ["x: required", "y: type"]
    assert df.limit(0).select(violations(schema, F.col("r"), kind)).count() == 0
    with pytest.raises(ValueError, match="oneOf"):
        violations({"oneOf": []}, F.col("r"), kind)
    assert df.select(violations({}, F.col("r"), kind)).first()[0] == []
