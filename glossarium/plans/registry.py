"""The queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from ..session import ship

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        def run(spark, sf_dir: str):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put
