"""Document ids: a number and a string that print alike are different ids."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import InvalidRequest

UUID, STRING, U64 = 0, 1, 2
ID_TYPE = "struct<bytes:binary,id_type:tinyint>"


def encode(value: Any) -> tuple[bytes, int]:
    if isinstance(value, uuid.UUID):
        return value.bytes, UUID
    if isinstance(value, str):
        return value.encode(), STRING
    if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < 1 << 64:
        return value.to_bytes(8, "little"), U64
    raise InvalidRequest(f"an id is a string or an unsigned 64-bit integer, not {value!r}")


def decode(raw: bytes, id_type: int) -> Any:
    if id_type == UUID:
        return uuid.UUID(bytes=bytes(raw))
    return int.from_bytes(raw, "little") if id_type == U64 else bytes(raw).decode()


def display(raw: bytes, id_type: int) -> str:
    return str(decode(raw, id_type))


def from_long(column: Column) -> Column:
    """The id of a non-negative long column."""
    big = F.lpad(F.hex(column), 16, "0")
    little = F.concat(*[F.substring(big, 15 - 2 * k, 2) for k in range(8)])
    return F.struct(F.unhex(little).alias("bytes"), F.lit(U64).cast("tinyint").alias("id_type"))


def from_string(column: Column) -> Column:
    return F.struct(column.cast("string").cast("binary").alias("bytes"), F.lit(STRING).cast("tinyint").alias("id_type"))


def display_column(column: Column) -> Column:
    raw = column.getField("bytes")
    big = F.reverse(F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1)))
    number = F.conv(F.array_join(big, ""), 16, 10)
    plain = F.lower(F.hex(raw))
    dashed = F.concat_ws("-", *[F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    kind = column.getField("id_type")
    return F.when(kind == U64, number).when(kind == UUID, dashed).otherwise(F.decode(raw, "UTF-8"))


def value_order(name: str) -> Column:
    """What to sort an id column by: UUIDs, strings, numbers, each by value.  The bytes of numbers are little-endian, so their own order is another."""
    big = ", ".join(f"substring({name}.bytes, {k}, 1)" for k in range(8, 0, -1))
    return F.expr(f"struct({name}.id_type, if({name}.id_type = {U64}, concat({big}), {name}.bytes))")
