"""Where the query modules register: a function of the views, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pairmill.plans import fixtures

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(body: str | None, *views: str, recursive: bool = False):
    """Registers a function of `Views` under its name; `body` is its SQL over `views`, or None."""

    def register(fn: Callable[[fixtures.Views], DataFrame]):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(fixtures.Views(spark, sf_dir))
        if body is not None:
            SQL[fn.__name__] = fixtures.sql(body, *views, recursive=recursive)
        return fn

    return register
