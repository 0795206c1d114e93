"""Registration of queries next to their SQL, and SQL fragments that oracles share."""

from __future__ import annotations

import functools
from collections.abc import Callable

from ..session import reach

#: DuckDB form of functions.rng.uniform for a text expression.
UNIFORM = "(CAST(concat('0x', substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0)"
#: and of gaussian_of.
GAUSS = "(sqrt(-2 * ln((CAST(concat('0x', substr(md5({key} || ':a'), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0)) * cos(2 * pi() * CAST(concat('0x', substr(md5({key} || ':b'), 1, 8)) AS BIGINT) / 4294967296.0))"


class Registry:
    """Queries and oracles of one module."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def keep(f: Callable) -> Callable:
            @functools.wraps(f)
            def query(spark, sf_dir):
                reach(spark)
                return f(spark, sf_dir)

            key = name or f.__name__
            self.queries[key] = query
            if sql is not None:
                self.oracles[key] = sql
            return f

        return keep
