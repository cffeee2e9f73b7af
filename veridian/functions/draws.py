"""Repeatable random numbers from md5, the same in every engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*keys: Column | str | int) -> Column:
    """A whole number in [0, 2**32) from the keys."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def uniform(*keys: Column | str | int) -> Column:
    """In [0, 1)."""
    return draw(*keys).cast("double") / F.lit(4294967296.0)


def draw_sql(*keys: str) -> str:
    """The same in DuckDB; keys are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(f'({k})::VARCHAR' for k in keys)})), 1, 8))::BIGINT"
