"""The registered queries and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import dom, links, pages, payloads, posts, social, state, texts

MODULES = (links, texts, pages, dom, payloads, posts, state, social)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Queries without SQL are tested against literal rows and plain Python."""
    return {k: v for m in MODULES for k, v in m.SQL.items()}
