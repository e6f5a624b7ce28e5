"""Attribute values: a tag, a JSON text, and the key that filters compare with."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidRequest

ATTR_TYPE = "struct<tag:string,json:string,key:string>"
ATTRS_TYPE = f"map<string,{ATTR_TYPE}>"
#: Fixed names of the sixteen kinds of value.
TAGS = (
    "String", "Int", "Uint", "Float", "Bool", "Uuid", "DateTime", "Null", "EmptyArray",
    "StringArray", "IntArray", "UintArray", "FloatArray", "BoolArray", "UuidArray", "DateTimeArray",
)
_I64, _U64 = (-(1 << 63), (1 << 63) - 1), (1 << 64) - 1


@dataclass(frozen=True)
class DateTime:
    """Milliseconds since the epoch; cannot be written as JSON, so only the Python API makes one."""

    millis: int


def float_text(x: float, debug: bool = False) -> str:
    """Shortest decimal digits that give the same number, without an exponent; whole numbers have no point
    unless ``debug``, which keeps one and switches to exponents outside 1e-5 to 1e16."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    digits = repr(x)
    if debug and x != 0 and not 1e-5 <= abs(x) < 1e16:
        mantissa, exponent = f"{Decimal(digits):e}".split("e")
        mantissa = mantissa.rstrip("0").rstrip(".") if "." in mantissa else mantissa
        return f"{mantissa}e{int(exponent)}"
    plain = format(Decimal(digits), "f")
    if "." in plain:
        plain = plain.rstrip("0").rstrip(".")
    if x == 0 and math.copysign(1, x) < 0:
        plain = "-0"
    return plain + ".0" if debug and "." not in plain else plain


def _debug_string(text: str) -> str:
    special = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
    return '"' + "".join(special.get(c) or (c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in text) + '"'


def parse(value: Any, field: str = "") -> tuple[str, Any]:
    """``(tag, value)`` of a JSON or Python value, or InvalidRequest."""
    if value is None:
        return "Null", None
    if isinstance(value, bool):
        return "Bool", value
    if isinstance(value, int):
        if _I64[0] <= value <= _I64[1]:
            return "Int", value
        return ("Uint", value) if 0 <= value <= _U64 else ("Float", float(value))
    if isinstance(value, float):
        return "Float", value
    if isinstance(value, str):
        return "String", value
    if isinstance(value, uuid.UUID):
        return "Uuid", value
    if isinstance(value, DateTime):
        return "DateTime", value
    if isinstance(value, (list, tuple)):
        if not value:
            return "EmptyArray", []
        kinds = {parse(x, field)[0] if not isinstance(x, (list, tuple, dict)) else "nested" for x in value}
        if kinds <= {"Int", "Uint", "Float"}:
            return ("IntArray", list(value)) if kinds == {"Int"} else ("FloatArray", [float(x) for x in value])
        if len(kinds) == 1 and (kind := kinds.pop()) in ("String", "Bool", "Uuid", "DateTime"):
            return f"{kind}Array", list(value)
        raise InvalidRequest(f"attribute {field!r}: an array holds values of one plain type")
    raise InvalidRequest(f"attribute {field!r}: unsupported type {type(value).__name__}")


def _plain(tag: str, value: Any) -> Any:
    if tag.endswith("Array"):
        return [_plain(tag[: -len("Array")], v) for v in value]
    return str(value) if tag == "Uuid" else value.millis if tag == "DateTime" else value


def key(tag: str, value: Any) -> str:
    """The text that a filter compares with; types do not matter, arrays match as a whole."""
    if tag == "Null":
        return "null"
    if tag == "Bool":
        return "true" if value else "false"
    if tag == "Float":
        return float_text(value)
    if tag == "EmptyArray":
        return tag
    if tag.endswith("Array"):
        inner = {"String": _debug_string, "Float": lambda x: float_text(x, debug=True), "Bool": lambda b: "true" if b else "false", "DateTime": lambda d: str(d.millis)}.get(tag[: -len("Array")], str)
        return f"{tag}([{', '.join(map(inner, value))}])"
    return str(_plain(tag, value))


def encode(value: Any, field: str = "") -> dict[str, str]:
    tag, parsed = parse(value, field)
    return {"tag": tag, "json": json.dumps(_plain(tag, parsed), ensure_ascii=False), "key": key(tag, parsed)}


def decode(attr: Any) -> Any:
    """Back to the JSON value."""
    return json.loads(attr["json"])


def overlay(base: Column, patch: Column) -> Column:
    """Key by key, the patch wins; shallow."""
    return F.when(patch.isNull(), base).when(base.isNull(), patch).otherwise(F.map_zip_with(base, patch, lambda _, old, new: F.coalesce(new, old)))


def subset(attributes: Column, fields: Iterable[str]) -> Column:
    """Only the named attributes; no names mean all."""
    names = list(fields)
    return F.map_filter(attributes, lambda k, _: k.isin(names)) if names else attributes


def keyed(df: DataFrame, columns: Iterable[str]) -> Column:
    """Attributes from string, integer and boolean columns, whose keys are their text."""
    tags = {"string": "String", "bigint": "Int", "int": "Int", "boolean": "Bool"}
    kinds = dict(df.dtypes)
    entries = []
    for c in columns:
        if kinds[c] not in tags:
            raise InvalidRequest(f"column {c!r} of type {kinds[c]} needs encode()")
        text = F.col(c).cast("string")
        as_json = F.to_json(F.struct(F.col(c).alias("v")))
        body = F.substring(as_json, F.lit(6), F.length(as_json) - 6)
        entries += [F.lit(c), F.struct(F.when(F.col(c).isNull(), "Null").otherwise(tags[kinds[c]]).alias("tag"), F.when(F.col(c).isNull(), "null").otherwise(body).alias("json"), F.coalesce(text, F.lit("null")).alias("key"))]
    return F.create_map(*entries)
