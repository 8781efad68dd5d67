"""Arrow functions that are made when they are first used, as making one needs a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(fn, returns)(*columns)

        return call

    return wrap
