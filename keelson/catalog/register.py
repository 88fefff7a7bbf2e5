"""A name, a query and, where SQL can say it, the SQL."""

from __future__ import annotations


class Register:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name, sql=None):
        def add(function):
            self.queries[name] = function
            if sql:
                self.oracles[name] = sql
            return function

        return add
