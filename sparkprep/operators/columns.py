"""Projection and schema operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.core import need
from sparkprep.errors import InvalidConfig, SchemaMismatch

Transform = Callable[[DataFrame], DataFrame]


def select(*columns: str) -> Transform:
    """Project, in the order given; a missing column is an error."""

    def run(df: DataFrame) -> DataFrame:
        need(df, *columns)
        return df.select(*columns)

    return run


def drop(*columns: str) -> Transform:
    """Remove columns; unknown names are ignored, and removing all is an error."""

    def run(df: DataFrame) -> DataFrame:
        left = [c for c in df.columns if c not in columns]
        if not left:
            raise InvalidConfig("no column would be left")
        return df.select(*left)

    return run


def rename(names: Mapping[str, str] | Iterable[tuple[str, str]]) -> Transform:
    """Rename; unknown names are ignored."""
    to = dict(names)
    return lambda df: df.withColumnsRenamed({k: v for k, v in to.items() if k in df.columns})


def cast(kinds: Mapping[str, str | T.DataType]) -> Transform:
    """Cast columns; values that can't be cast become null, and unknown names are ignored."""
    return lambda df: df.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items() if c in df.columns})


def map_batches(f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> Transform:
    """Run a function on Arrow batches of the rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield f(batch)

    return lambda df: df.mapInArrow(each, schema)


def where(condition: Column | str) -> Transform:
    """Keep the rows for which the condition is true; null counts as false."""
    return lambda df: df.filter(condition)


class Chain:
    """Transforms in a row; the result is one lazy plan."""

    def __init__(self, *steps: Transform):
        self.steps = list(steps)

    def then(self, step: Transform) -> Chain:
        return Chain(*self.steps, step)

    def __len__(self) -> int:
        return len(self.steps)

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, f: d.transform(f), self.steps, df)


def union_all(*frames: DataFrame) -> DataFrame:
    """Concatenate frames of equal column names and types."""
    if not frames:
        raise InvalidConfig("nothing to concatenate")
    kind = [(f.name, f.dataType) for f in frames[0].schema]
    for other in frames[1:]:
        if [(f.name, f.dataType) for f in other.schema] != kind:
            raise SchemaMismatch(f"{other.schema.simpleString()} is not {frames[0].schema.simpleString()}")
    return reduce(DataFrame.unionByName, frames)


def schema_table(df: DataFrame) -> DataFrame:
    """(position, name, type, nullable) of the columns."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def info(df: DataFrame) -> dict[str, int]:
    """Rows, columns and input files."""
    return {"rows": df.count(), "columns": len(df.columns), "files": len(df.inputFiles())}
