"""Vectorised Python functions whose types are given as text, made when they are first called: a module can be imported without a session."""

from __future__ import annotations

from functools import cache, wraps

from pyspark.sql import functions as F


def vectorised(kind: str):
    def wrap(f):
        made = cache(lambda: F.pandas_udf(f, kind))

        @wraps(f)
        def call(*columns):
            return made()(*columns)

        return call

    return wrap
