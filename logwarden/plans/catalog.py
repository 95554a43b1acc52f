"""Registered queries: name -> function of (spark, folder of parquet tables)."""

from __future__ import annotations



QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say it, its twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
