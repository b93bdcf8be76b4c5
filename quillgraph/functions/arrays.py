"""Small helpers for work on arrays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def explode_indexed(df: DataFrame, array: str, pos: str, item: str) -> DataFrame:
    """One row per element with its position; rows without elements vanish.

    The outer form keeps the planner from inferring a size filter, which would
    copy the array's whole expression below every earlier projection.
    """
    return (
        df.select("*", F.posexplode_outer(array).alias(pos, item))
        .filter(F.col(pos).isNotNull())
        .drop(array)
    )


def explode_items(df: DataFrame, array: str, item: str) -> DataFrame:
    return explode_indexed(df, array, "_p", item).drop("_p")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, added up from the left."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def first_seen(items: Column) -> Column:
    """Distinct non-null elements in order of first appearance."""
    return F.array_distinct(F.array_compact(items))
