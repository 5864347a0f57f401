"""Scaling and filling of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.core import Order, need, numeric_columns
from sparkprep.errors import InvalidConfig
from sparkprep.operators.columns import Transform
from sparkprep.operators.rows import fill_directed

METHODS = ("minmax", "zscore", "l2")


def normalize(method: str, columns: Sequence[str] | None = None) -> Transform:
    """Scale numeric columns (all if none are named) to doubles: minmax, zscore (population deviation) or l2.

    One aggregation over all columns gives the constants. A range, deviation or norm of 0 gives 0.0; nulls stay."""
    if method not in METHODS:
        raise InvalidConfig(f"method is one of {', '.join(METHODS)}")

    def run(df: DataFrame) -> DataFrame:
        names = list(columns) if columns is not None else numeric_columns(df)
        need(df, *names)
        for c in names:
            if not isinstance(df.schema[c].dataType, T.NumericType):
                raise InvalidConfig(f"column {c!r} is not numeric")
        if not names:
            return df
        d = {c: F.col(c).cast("double") for c in names}
        wanted = {"minmax": lambda x: (F.min(x), F.max(x)), "zscore": lambda x: (F.avg(x), F.stddev_pop(x)), "l2": lambda x: (F.lit(0.0), F.sqrt(F.sum(x * x)))}[method]
        stats = df.agg(*(e.alias(f"s{i}_{j}") for i, c in enumerate(names) for j, e in enumerate(wanted(d[c])))).first()
        out = {}
        for i, c in enumerate(names):
            a, b = stats[f"s{i}_0"], stats[f"s{i}_1"]
            if b is None:  # all null
                continue
            width = b - a if method == "minmax" else b
            out[c] = F.when(d[c].isNotNull(), (d[c] - F.lit(a)) / F.lit(width) if width else F.lit(0.0))
        return df.withColumns(out)

    return run


_FITS = {bool: (T.BooleanType,), int: (T.IntegralType,), float: (T.FractionalType,), str: (T.StringType,)}


def fill_value(column: str, value: bool | int | float | str) -> Transform:
    """Replace nulls by a constant of the column's kind; another kind is an error."""

    def run(df: DataFrame) -> DataFrame:
        need(df, column)
        kind = df.schema[column].dataType
        if not isinstance(kind, _FITS.get(type(value), ())):
            raise InvalidConfig(f"{value!r} does not fit column {column!r} of type {kind.simpleString()}")
        return df.withColumn(column, F.coalesce(F.col(column), F.lit(value).cast(kind)))

    return run


def fill_zero(column: str) -> Transform:
    """Replace nulls of a numeric column by 0."""

    def run(df: DataFrame) -> DataFrame:
        need(df, column)
        kind = df.schema[column].dataType
        if not isinstance(kind, T.NumericType):
            raise InvalidConfig(f"column {column!r} is not numeric")
        return df.withColumn(column, F.coalesce(F.col(column), F.lit(0).cast(kind)))

    return run


def fill_forward(column: str, order_by: Order | Sequence[Order]) -> Transform:
    return fill_directed(column, order_by)


def fill_backward(column: str, order_by: Order | Sequence[Order]) -> Transform:
    return fill_directed(column, order_by, backward=True)
