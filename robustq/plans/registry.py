"""Query registry: key -> (Spark builder(spark, sf_dir) -> DataFrame, DuckDB SQL or None).

``None`` marks operators with no SQL form (ML fits, driver loops); they are checked by
row count plus our own tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers its keys on import)."""
    from robustq.plans import q_sources, q_prepare, q_prompts  # noqa: F401
    from robustq.plans import q_perturb, q_scoring, q_metrics  # noqa: F401
    from robustq.plans import q_search, q_streaming  # noqa: F401
