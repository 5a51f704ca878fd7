"""A seal between a long chain of computed columns and whatever a caller does next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sealed(df: DataFrame, keep: list[str], computed: dict[str, Column]) -> DataFrame:
    """Return ``keep`` plus ``computed`` so that later filters stay above the chain.

    A filter on a computed column is otherwise pushed down through every projection of the chain and
    takes each expression along, which multiplies the plan. The output of a generator is opaque to
    that rewrite; one row in gives one row out, inside the same generated code.
    """
    packed = F.struct(*[column.alias(name) for name, column in computed.items()])
    return df.select(*keep, F.inline(F.array(packed)))
