"""JSON text to typed records and back, with missing, null and invalid told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parsed(c: Column, schema: str) -> Column:
    """Null for text that isn't JSON of this shape."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def as_array(c: Column) -> Column:
    """A lone JSON object as an array of one."""
    return F.when(F.ltrim(c).startswith("{"), F.concat(F.lit("["), c, F.lit("]"))).otherwise(c)


def records(df: DataFrame, c: str, field: str, element: str) -> DataFrame:
    """One row for each record of the array ``field`` of a JSON text; nothing for text that doesn't parse."""
    return df.select(F.inline(parsed(F.col(c), f"{field} array<struct<{element}>>")[field]))


def state_of(c: Column, key: str, kind: str) -> Column:
    """'missing', 'null', 'invalid' or 'valid' for one key of a JSON object; 'malformed' if it isn't one."""
    keys = F.json_object_keys(c)
    raw = F.get_json_object(c, f"$.{key}")
    return (
        F.when(keys.isNull(), "malformed").when(~F.array_contains(keys, key), "missing").when(raw.isNull(), "null")
        .when(raw.try_cast(kind).isNull(), "invalid").otherwise("valid")
    )


def first_list(df: DataFrame, column: str | None = None) -> DataFrame:
    """The first array-of-records column as rows."""
    fields = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if column is None and not fields:
        raise ValueError("no column is a list of records")
    return df.select(F.inline(column or fields[0]))


_NAMES = {T.StringType: "string", T.LongType: "integer", T.IntegerType: "integer", T.ShortType: "integer", T.DoubleType: "number", T.FloatType: "number", T.BooleanType: "boolean"}


def json_schema(t: T.DataType, enums: dict[str, list[str]] | None = None, name: str = "") -> dict:
    """A JSON schema document for a Spark type; nullable fields aren't required."""
    if isinstance(t, T.StructType):
        fields = {}
        for f in t.fields:
            d = json_schema(f.dataType, enums, f.name)
            if f.metadata.get("comment"):
                d = {**d, "description": f.metadata["comment"]}
            fields[f.name] = {"anyOf": [d, {"type": "null"}]} if f.nullable else d
        return {"type": "object", "properties": fields, "required": [f.name for f in t.fields if not f.nullable]}
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": json_schema(t.elementType, enums, name)}
    if isinstance(t, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(t.valueType, enums, name)}
    if isinstance(t, T.TimestampType):
        return {"type": "string", "format": "date-time"}
    out = {"type": _NAMES.get(type(t), "string")}
    return {**out, "enum": enums[name]} if enums and name in enums else out
