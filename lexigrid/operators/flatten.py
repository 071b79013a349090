"""Nested rows as (field, value) string leaves with dotted paths."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAVES = "array<struct<field:string,value:string>>"


def _none() -> Column:
    return F.array().cast(LEAVES)


def _join(path: Column | None, name: Column) -> Column:
    return name if path is None else F.concat(path, F.lit("."), name)


def leaves(column: Column, kind: T.DataType, path: Column | None) -> Column | None:
    """Expression for the string leaves under ``column``; None where its type can hold none.

    Array indices, from 0, and map keys become parts of the path.  Other leaves are not text.
    """
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return F.array(F.struct(path.alias("field"), column.cast("string").alias("value")))
    if isinstance(kind, T.StructType):
        parts = [leaves(column.getField(f.name), f.dataType, _join(path, F.lit(f.name))) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        return F.coalesce(F.concat(*parts), _none()) if parts else None
    if isinstance(kind, T.ArrayType):
        if leaves(F.lit(None), kind.elementType, F.lit("")) is None:
            return None
        inner = F.transform(column, lambda x, i: leaves(x, kind.elementType, _join(path, i.cast("string"))))
        return F.coalesce(F.flatten(inner), _none())
    if isinstance(kind, T.MapType):
        if leaves(F.lit(None), kind.valueType, F.lit("")) is None:
            return None
        inner = F.transform(F.map_entries(column), lambda e: leaves(e["value"], kind.valueType, _join(path, e["key"].cast("string"))))
        return F.coalesce(F.flatten(inner), _none())
    if isinstance(kind, T.VariantType):
        return json_leaves(F.to_json(column), path)
    return None


def _walk(value, path: str) -> Iterator[tuple[str, str]]:
    level = [(path, value)]
    while level:
        below = []
        for at, x in level:
            if isinstance(x, str):
                yield at, x
            elif isinstance(x, (dict, list)):
                below += [(f"{at}.{k}" if at else str(k), y) for k, y in (x.items() if isinstance(x, dict) else enumerate(x))]
        level = below


def _json_leaves(texts: pa.Array, paths: pa.Array) -> pa.Array:
    out = []
    for text, path in zip(texts.to_pylist(), paths.to_pylist()):
        try:
            out.append([{"field": f, "value": v} for f, v in _walk(json.loads(text), path or "")] if text else [])
        except ValueError:
            out.append([])
    return pa.array(out, pa.list_(pa.struct([("field", pa.string()), ("value", pa.string())])))


def json_leaves(column: Column, path: Column | None = None) -> Column:
    """String leaves of a JSON text of unknown shape; none if it can't be parsed."""
    return F.arrow_udf(_json_leaves, LEAVES)(column, F.lit("") if path is None else path)


def flatten(docs: DataFrame, keep: list[str], json_columns: list[str] = (), body: str | None = None) -> DataFrame:
    """(keep..., field, value) for every non-null string leaf of the other columns, or of those in the struct ``body``.

    ``json_columns`` hold JSON texts of any shape, flattened as they come.
    """
    inside = docs.schema.fields if body is None else docs.schema[body].dataType.fields
    parts = []
    for f in inside:
        column = F.col(f"`{f.name}`") if body is None else F.col(f"`{body}`").getField(f.name)
        part = json_leaves(column, F.lit(f.name)) if f.name in json_columns else leaves(column, f.dataType, F.lit(f.name))
        if part is not None:
            parts.append(part)
    kept = [F.col(f"`{k}`") for k in keep]
    if not parts:
        return docs.select(*kept, F.lit("").alias("field"), F.lit("").alias("value")).limit(0)
    return docs.select(*kept, F.inline(F.concat(*parts))).filter("value is not null")
