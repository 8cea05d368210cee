"""Evaluate an expensive expression exactly once, and build it only once.

Filters on a projected column are pushed below the projection with the expression copied
into them, and lambdas have no common-subexpression elimination.  Both would run text work
several times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append a column behind a one-element generator, which filters do not pass.

    The value itself is computed in a projection, where generated code and common
    subexpressions apply.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, value.alias("_once")).select(*rest, F.explode(F.array("_once")).alias(name))


def with_each_once(df: DataFrame, **values: Column) -> DataFrame:
    """``with_once`` for several columns that do not need one another."""
    rest = [c for c in df.columns if c not in values]
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select(*rest, row.alias("_once")).select(*rest, F.inline(F.array("_once")))


def in_one_column(df: DataFrame, read: Sequence[str], steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``steps``, which read the columns ``read`` and append others, with the rest passing them as one column.

    A step behind a generator copies its row column by column; one column is one copy.
    """
    rest = [c for c in df.columns if c not in read]
    if not rest:
        return steps(df)
    done = steps(df.select(F.struct(*rest).alias("_packed"), *read))
    added = [c for c in done.columns if c not in ("_packed", *read)]
    return done.select(*[F.col(c) if c in read else F.col(f"_packed.{c}").alias(c) for c in df.columns], *added)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a lambda variable, so that ``body`` may use it many times."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def built_once(builder: Callable[..., Column]) -> Callable[..., Column]:
    """Cache a column expression over fixed column names for the life of the JVM connection.

    The large mention expressions take seconds to assemble call by call from Python.
    """
    store: dict = {}

    @wraps(builder)
    def cached(*args) -> Column:
        key = (id(SparkContext._gateway), *args)
        if key not in store:
            store[key] = builder(*args)
        return store[key]

    return cached
