"""Rebuild or inspect every text leaf of a nested column from its type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ensspark.functions.text import strip


def map_leaves(value: Column, dtype: T.DataType, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to each string leaf; null structs and arrays stay null."""
    if isinstance(dtype, T.StructType):
        fields = [map_leaves(value.getField(f.name), f.dataType, fn).alias(f.name) for f in dtype]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: map_leaves(item, dtype.elementType, fn))
    if isinstance(dtype, T.StringType):
        return fn(value)
    return value


def map_struct(value: Column, dtype: T.StructType, fn: Callable[[Column], Column]) -> Column:
    """``map_leaves`` of a struct that is never null.

    Without the null check the optimizer sees a plain struct, and drops the fields nobody reads.
    """
    return F.struct(*[map_leaves(value.getField(f.name), f.dataType, fn).alias(f.name) for f in dtype])


def has_empty_leaf(value: Column, dtype: T.DataType) -> Column:
    """True where a present element holds nothing but white space."""
    if isinstance(dtype, T.StructType):
        found = F.lit(False)
        for f in dtype:
            found = found | has_empty_leaf(value.getField(f.name), f.dataType)
        return F.coalesce(value.isNotNull() & found, F.lit(False))
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.exists(value, lambda item: has_empty_leaf(item, dtype.elementType)), F.lit(False))
    return F.coalesce(strip(value) == "", F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also where ``use`` reads it for every element of an array.

    The optimizer may put a column's expression into the place that reads it, there inside a loop.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
