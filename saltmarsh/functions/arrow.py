"""Arrow UDFs that are built when they are first applied: a schema needs a session to be read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        def applied(*columns: Column | str) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        return applied

    return wrap
