"""Operators of a training-data pipeline over documents and conversations."""

from __future__ import annotations


def queries():
    """Query name to callable ``(spark, sf_dir) -> DataFrame``."""
    from plumbline.llm.catalog import QUERIES

    return dict(QUERIES)


def oracle_sql():
    """Query name to DuckDB SQL, for the queries that SQL can express."""
    from plumbline.llm.catalog import ORACLES

    return dict(ORACLES)
