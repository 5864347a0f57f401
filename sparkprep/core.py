"""Column checks, materialisation, and order-dependent building blocks that stay distributed.

Spark rows have no position. Whatever depends on order takes an explicit order, and is built on
``ordered``: rows are range-partitioned and sorted, each partition is one stretch of the whole order, and
per-partition totals (a few numbers per partition) give every stretch its offset. No window ever runs over
all rows in one task.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.errors import ColumnNotFound, InvalidConfig

Order = str | Column
_IN_PARTITION = 33  # bits of monotonically_increasing_id below the partition number


def need(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise ColumnNotFound(name, df.columns)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or one for local sessions."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if re.match(r"local($|\[)", spark.sparkContext.master):
        return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"


_scratch: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_scratch(since: int = 0) -> None:
    """Delete the tables that materialize() has written; frames that still read them fail."""
    while len(_scratch) > since:
        try:
            _delete(*_scratch.pop())
        except Exception:  # noqa: BLE001  at exit the session may be gone
            return


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end: for work whose results have been saved or collected by then."""
    mark = len(_scratch)
    try:
        yield
    finally:
        free_scratch(mark)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that rows stay in their partitions' files; deleted at exit, or by scratch()."""
    path = f"{shared_dir(df.sparkSession)}/prep-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _scratch:
        atexit.register(free_scratch)
    _scratch.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What a plan may consist of to be run again as cheaply as its result could be read.
_CHEAP = {"Project", "Filter", "LogicalRelation", "Relation", "LocalRelation", "InMemoryRelation", "Range", "SubqueryAlias"}


def rereadable(df: DataFrame) -> DataFrame:
    """df itself if it is a scan with expressions and filters; else it is written once and read back."""

    def cheap(plan) -> bool:
        children = plan.children()
        return plan.nodeName() in _CHEAP and all(cheap(children.apply(i)) for i in range(children.size()))

    return df if cheap(df._jdf.queryExecution().optimizedPlan()) else materialize(df)


def order_columns(order_by: Order | Sequence[Order]) -> list[Column]:
    items = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    if not items:
        raise InvalidConfig("an order needs at least one column")
    return [F.col(x).asc_nulls_last() if isinstance(x, str) else x for x in items]


def ordered(df: DataFrame, order_by: Order | Sequence[Order]) -> DataFrame:
    """df in its order, with _part and _at: the stretch and the place in it. Materialised, as stretches must not move."""
    keys = order_columns(order_by)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    stored = materialize(placed)
    return stored.withColumn("_part", F.shiftright("_id", _IN_PARTITION)).withColumn("_at", F.col("_id").bitwiseAND((1 << _IN_PARTITION) - 1)).drop("_id")


def _offsets(parts: DataFrame, value: str) -> DataFrame:
    """(_part, value) with one row per stretch -> (_part, _ahead): the sum over the stretches before."""
    spark, at, rows = parts.sparkSession, 0, []
    for r in sorted(parts.collect(), key=lambda r: r["_part"]):
        rows.append((r["_part"], at))
        at += r[value]
    return spark.createDataFrame(rows, "_part long, _ahead long")


def with_row_id(df: DataFrame, order_by: Order | Sequence[Order], name: str = "_row_id") -> DataFrame:
    """Number the rows 0, 1, ... in an order."""
    rows = ordered(df, order_by)
    ahead = _offsets(rows.groupBy("_part").count(), "count")
    return rows.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + F.col("_at")).select(*df.columns, name)


def running_totals(df: DataFrame, group: str, order_by: str, sums: dict[str, str]) -> DataFrame:
    """For each new name in sums, the inclusive running total of a column by order within its group."""
    rows = ordered(df, [group, order_by])
    own = rows.groupBy("_part", group).agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per stretch and group
    ahead = own.select("_part", F.col(group).alias("_same"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_a_{n}") for n in sums))
    inside = Window.partitionBy("_part", group).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.join(ahead, (rows["_part"] == ahead["_part"]) & rows[group].eqNullSafe(F.col("_same"))).drop(ahead["_part"])
    return both.select(*df.columns, *(F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()), *(f"_a_{n}" for n in sums)).select(*df.columns, *((F.col(f"_i_{n}") + F.col(f"_a_{n}")).alias(n) for n in sums))


def order_value(names: Sequence[str]) -> Column:
    """The order of named columns, nulls last, as one comparable value."""
    return F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in names])


def seeded_digits(seed: int | Column, *keys: str | Column) -> Column:
    """The leading 15 hexadecimal digits of the MD5 of a row's seed and key; they sort as the number does."""
    cells = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.substring(F.md5(F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *cells)), 1, 15)


def seeded(seed: int | Column, *keys: str | Column) -> Column:
    """A reproducible pseudo-random number of 60 bits of a row: the leading digits of the MD5 of its seed and key."""
    return F.conv(seeded_digits(seed, *keys), 16, 10).cast("long")


def uniform(seed: int, *keys: str | Column) -> Column:
    """A reproducible number in [0, 1)."""
    return (seeded(seed, *keys) % F.lit(1 << 52)) / F.lit(float(1 << 52))
