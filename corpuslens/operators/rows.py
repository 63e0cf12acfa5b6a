"""Help for work inside rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The column computed once for each row; a projection alone may be folded into every later use, lambdas included."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
