"""Namespace names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import InvalidRequest

PATTERN = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"
LEAST, MOST = 3, 63


def valid(column: Column) -> Column:
    """3 to 63 of ``a-z 0-9 -``, no hyphen at either end and no two in a row."""
    return F.coalesce(F.length(column).between(LEAST, MOST) & column.rlike(PATTERN) & ~F.contains(column, F.lit("--")), F.lit(False))


def check(name: str) -> str:
    if not isinstance(name, str) or not LEAST <= len(name) <= MOST or not re.fullmatch(PATTERN[1:-1], name) or "--" in name:
        raise InvalidRequest(f"invalid namespace name {name!r}")
    return name
