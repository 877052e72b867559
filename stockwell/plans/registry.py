"""A registry of queries: a function of (spark, sf_dir) and the SQL that gives the same rows."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return put
