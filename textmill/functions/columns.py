"""Helpers for column expressions that are used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; in a lambda an expression is computed for each element that it is used for."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_struct(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, by a generator of one row: the optimizer doesn't copy it to each place that uses it."""
    return df.select("*", F.explode(F.array(value)).alias(name))
