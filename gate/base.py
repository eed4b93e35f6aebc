"""Registration of queries with their SQL."""
from __future__ import annotations


class Gate:
    """Collects queries of one module; ``gate(name, sql)`` decorates a query."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name, sql=None):
        def add(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add
