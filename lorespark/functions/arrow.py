"""Arrow UDFs that are made when they are used: a return type is parsed by a session, which workers don't have."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def arrow_function(returns: str):
    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, returns)(*columns)

        return call

    return wrap
