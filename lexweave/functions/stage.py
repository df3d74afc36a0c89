"""Evaluate expensive columns exactly once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read instead of recomputing.

    Catalyst inlines projected expressions into filters above them, which multiplies the work of
    long rewrite chains. A one-row ``inline`` is a generator, so nothing is copied through it.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline_outer(F.array(row)))


def evaluate_fields(df: DataFrame, row: Column, *names: str) -> DataFrame:
    """The same for one struct expression, its fields becoming the named columns.

    Keep results flat: nested access above a generator trips Spark's generator pruning.
    """
    return df.select("*", F.inline_outer(F.array(row)).alias(*names))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once, for use inside lambdas where no stage can be added."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal(rows: list | dict, ddl: str) -> Column:
    """A constant array or map of code-sized data; the optimizer folds it into one literal."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), ddl)
