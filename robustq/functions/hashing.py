"""Deterministic, partition-independent random draws.

Every random choice in the library is an md5 rank over ``seed:...:id`` so results do not
depend on partitioning, task retries or executor loss (unlike ``rand()``), and DuckDB can
reproduce them for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    if isinstance(c, str):
        return F.col(c).cast("string")
    return F.lit(str(c))


def hkey(*parts) -> Column:
    """md5 hex of the parts joined by ':' (strings are column names, others literals)."""
    return F.md5(F.concat_ws(":", *[_str(p) for p in parts]))


def hnum(*parts) -> Column:
    """First 15 hex digits of :func:`hkey` as a non-negative bigint."""
    return F.conv(F.substring(hkey(*parts), 1, 15), 16, 10).cast("bigint")


def sql_hkey(*parts: str) -> str:
    """DuckDB twin; parts are SQL expressions."""
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5(concat_ws(':', {inner}))"


def sql_hnum(*parts: str) -> str:
    return f"CAST(('0x' || substr({sql_hkey(*parts)}, 1, 15)) AS BIGINT)"
