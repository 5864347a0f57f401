"""Order, limits, sampling and duplicates. Results follow an explicit order or a seed, never the layout of partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.core import Order, materialize, need, order_columns, order_value, seeded, seeded_digits, with_row_id
from sparkprep.errors import IndexOutOfBounds, InvalidConfig
from sparkprep.operators.columns import Transform


def sort(by: str | Sequence[str], descending: bool | Sequence[bool] = False, nulls_first: bool = False) -> Transform:
    """Sort by several keys; nulls are last in both directions unless asked otherwise."""
    names = [by] if isinstance(by, str) else list(by)
    down = [descending] * len(names) if isinstance(descending, bool) else list(descending)
    if len(down) != len(names) or not names:
        raise InvalidConfig("a direction for each sort key is needed")

    def run(df: DataFrame) -> DataFrame:
        need(df, *names)
        return df.orderBy(*sort_keys(names, down, nulls_first))

    return run


def sort_keys(names: Sequence[str], down: Sequence[bool], nulls_first: bool = False) -> list[Column]:
    kinds = {(False, False): "asc_nulls_last", (False, True): "asc_nulls_first", (True, False): "desc_nulls_last", (True, True): "desc_nulls_first"}
    return [getattr(F.col(n), kinds[d, nulls_first])() for n, d in zip(names, down, strict=True)]


def take(n: int, order_by: Order | Sequence[Order]) -> Transform:
    """The first n rows: a top-n per partition, merged."""
    return lambda df: df.orderBy(*order_columns(order_by)).limit(max(n, 0))


#: Offsets up to this are found by a merged top-n; larger ones by numbering the rows.
NEAR = 100_000


def _names(order_by: Order | Sequence[Order]) -> list[str] | None:
    items = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return items if all(isinstance(x, str) for x in items) else None


def _literal(df: DataFrame, names: Sequence[str], found) -> Column:
    return F.struct(*[F.struct(F.lit(found[c] is None), F.lit(found[c]).cast(df.schema[c].dataType)) for c in names])


def _edge(df: DataFrame, n: int, names: Sequence[str]):
    """The order columns of the row at a position near the start; None beyond the end."""
    return df.select(*names).orderBy(*order_columns(list(names))).offset(n).limit(1).first()


def skip(n: int, order_by: Order | Sequence[Order]) -> Transform:
    """All rows but the first n: those not below the row at that place, which a top-n finds without moving the others. Far offsets, and
    an edge that several rows share, number the rows in parallel."""

    def run(df: DataFrame) -> DataFrame:
        names = _names(order_by)
        if n <= 0:
            return df
        if names and n <= NEAR:
            found = _edge(df, n, names)
            if found is None:
                return df.limit(0)
            edge = _literal(df, names, found)
            if df.filter(order_value(names) < edge).count() == n:
                return df.filter(order_value(names) >= edge)
        return with_row_id(df, order_by).filter(F.col("_row_id") >= n).drop("_row_id")

    return run


def row(df: DataFrame, i: int, order_by: Order | Sequence[Order]):
    """The row at a position."""
    if 0 <= i <= NEAR:
        found = df.orderBy(*order_columns(order_by)).offset(i).head(1)
    else:
        found = with_row_id(df, order_by).filter(F.col("_row_id") == i).drop("_row_id").head(1)
    if not found:
        raise IndexOutOfBounds(f"no row {i}")
    return found[0]


def head(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def shuffle(seed: int, key: str | Sequence[str]) -> Transform:
    """Permute the rows by a seeded hash of their key."""
    keys = [key] if isinstance(key, str) else list(key)
    return lambda df: df.orderBy(seeded_digits(seed, *keys), *keys)


#: Buckets of the seeded hash that a sample's cut-off is looked up in.
BUCKET_BITS = 16


def sample(n: int | None = None, *, fraction: float | None = None, seed: int = 42, key: str | Sequence[str]) -> Transform:
    """Exactly n rows, or round(rows * fraction), without replacement; all of them if there are no more.

    The rows with the smallest seeded hashes: counts by hash bucket give the cut-off, rows below it are filtered, and only the bucket
    on the edge is sorted."""
    keys = [key] if isinstance(key, str) else list(key)
    if (n is None) == (fraction is None):
        raise InvalidConfig("give either n or a fraction")

    def run(df: DataFrame) -> DataFrame:
        need(df, *keys)
        bucket = F.shiftright(seeded(seed, *keys), 60 - BUCKET_BITS)
        counts = sorted(df.groupBy(bucket.alias("b")).count().collect())  # at most 1 << BUCKET_BITS rows
        total = sum(c for _, c in counts)
        size = max(0, n if fraction is None else int(total * min(1.0, max(0.0, fraction)) + 0.5))
        if size >= total:
            return df
        at, before = 0, 0
        while before + counts[at][1] <= size:
            before += counts[at][1]
            at += 1
        edge = counts[at][0]
        last = df.filter(bucket == edge).orderBy(seeded(seed, *keys), *keys).limit(size - before)
        return df.filter(bucket < edge).unionByName(last)

    return run


def unique(by: str | Sequence[str] | None, order_by: Order | Sequence[Order], keep: str = "first") -> Transform:
    """One row for each key (all columns if by is None): the first or the last in the order.

    Keys group null-safely. The winner is found by a pre-aggregated minimum of the order, unless the order
    holds expressions that can't be compared as a struct; so a very common key doesn't meet in one task."""
    if keep not in ("first", "last"):
        raise InvalidConfig("keep is 'first' or 'last'")
    names = None if by is None else [by] if isinstance(by, str) else list(by)

    def run(df: DataFrame) -> DataFrame:
        keys = df.columns if names is None else names
        need(df, *keys)
        order = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
        if all(isinstance(x, str) for x in order):
            rank = F.struct(*[F.struct(F.col(x).isNull(), F.col(x)) for x in order])
            whole = F.struct(*df.columns)
            best = (F.min_by if keep == "first" else F.max_by)(whole, rank)
            return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best.alias("_row")).select("_row.*")
        w = Window.partitionBy(*keys).orderBy(*order_columns(order))
        if keep == "last":
            return df.withColumn("_n", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy(*keys))).filter("_n = _m").drop("_n", "_m")
        return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    return run


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, distinct_rows, duplicate_rows)."""
    counts = df.groupBy(*df.columns).count()
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")).withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def _filled(column: str, names: list[str]):
    """Scan a sorted partition: nulls take the last value before them. __sp_at: the place in it; __sp_open: there was no value up to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, carry, at = TaskContext.get().partitionId(), 0, None, names.index(column)
        for batch in batches:
            values = batch.column(at)
            carry = pa.nulls(1, values.type) if carry is None else carry
            both = pa.concat_arrays([carry, values])
            last = np.maximum.accumulate(np.where(both.is_valid().to_numpy(zero_copy_only=False), np.arange(len(both)), 0))
            full = both.take(pa.array(last))
            carry = full.slice(len(full) - 1)
            yield pa.RecordBatch.from_arrays([*(full.slice(1) if i == at else c for i, c in enumerate(batch.columns)), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(place, place + batch.num_rows)), full.slice(1).is_null()], [*names, "__sp_part", "__sp_at", "__sp_open"])
            place += batch.num_rows

    return run


def fill_directed(column: str, order_by: Order | Sequence[Order], backward: bool = False) -> Transform:
    """The last value before a null (or the next after it), in an order. Of rows at one place of the order any may be the first.

    Rows are range-partitioned and sorted once; a scan of each partition fills what it can, and the rows at its beginning take one
    value that the partitions before it leave. Backward, the same is done in the opposite order."""

    def run(df: DataFrame) -> DataFrame:
        need(df, column)
        if backward and (names := _names(order_by)) is None:  # expressions can't be turned round; places can
            return fill_directed(column, "_row_id", True)(with_row_id(df, order_by)).select(*df.columns)
        spark, kind = df.sparkSession, df.schema[column].dataType
        keys = [F.col(c).desc_nulls_first() for c in names] if backward else order_columns(order_by)
        schema = T.StructType([*df.schema, T.StructField("__sp_part", T.IntegerType()), T.StructField("__sp_at", T.LongType()), T.StructField("__sp_open", T.BooleanType())])
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        stored = materialize(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_filled(column, df.columns), schema))
        ends = stored.filter("NOT __sp_open").groupBy("__sp_part").agg(F.max_by(column, "__sp_at").alias("_edge"))  # one value a partition
        left, carried, now = {r["__sp_part"]: r["_edge"] for r in ends.collect()}, [], None
        for p in range(parts):
            carried.append((p, now))
            now = left.get(p, now)
        over = spark.createDataFrame(carried, T.StructType([T.StructField("__sp_part", T.IntegerType()), T.StructField("__sp_carried", kind)]))
        return stored.join(F.broadcast(over), "__sp_part").withColumn(column, F.when(F.col("__sp_open"), F.col("__sp_carried")).otherwise(F.col(column))).select(*df.columns)

    return run


def search(df: DataFrame, query: str, order_by: Order | Sequence[Order], start: int = 0) -> int | None:
    """The position of the first row, from start on and around, with a cell that holds the query; case is ignored.

    Hits are filtered first; the least of them is placed by counting the rows before it. Rows that share a place in the order are
    found at the first of these places."""
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False))
    names = _names(order_by)
    if names and start <= NEAR:
        place = order_value(names)
        first, edge = F.min_by(F.struct(*names), place), _edge(df, start, names) if start > 0 else None
        hits = df.filter(hit)
        found = hits.agg(first.alias("f")).first().f
        if start > 0 and edge is not None:
            found = hits.filter(place >= _literal(df, names, edge)).agg(first.alias("f")).first().f or found
        return None if found is None else df.filter(place < _literal(df, names, found)).count()
    turn = with_row_id(df, order_by).filter(hit).agg(F.min(F.when(F.col("_row_id") >= start, F.col("_row_id"))), F.min("_row_id")).first()
    return turn[0] if turn[0] is not None else turn[1]
