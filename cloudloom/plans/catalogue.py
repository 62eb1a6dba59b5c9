"""The registered queries and their oracle SQL."""

from __future__ import annotations

from cloudloom.plans import clouds, coding, decoding, references, structures


def queries() -> dict:
    """Name to function of (spark, sf_dir)."""
    return {**clouds.QUERIES, **coding.QUERIES, **structures.QUERIES, **references.QUERIES, **decoding.QUERIES}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by the same names, where SQL can express the query."""
    return {**clouds.SQL, **coding.SQL, **structures.SQL, **references.SQL, **decoding.SQL}
