"""Splits, resampling, mixing, weighted sampling and loading in batches."""

from __future__ import annotations

import threading
from collections.abc import Iterator, Sequence
from concurrent.futures import Future
from dataclasses import dataclass
from queue import Empty, Queue

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.core import Order, materialize, need, running_totals, seeded, seeded_digits, uniform, with_row_id
from sparkprep.errors import EmptyDataset, InvalidConfig


def half_up(x: float) -> int:
    return int(x + 0.5)


def _check(train: float, test: float, validation: float | None) -> None:
    total = train + test + (validation or 0.0)
    if abs(total - 1) > 1e-9:
        raise InvalidConfig(f"ratios must sum to 1, not {total}")
    if train <= 0 or test <= 0 or (validation is not None and validation <= 0):
        raise InvalidConfig("ratios must be positive")


@dataclass(frozen=True)
class Split:
    train: DataFrame
    test: DataFrame
    validation: DataFrame | None


def _parts(df: DataFrame, columns: list[str], validation: float | None) -> Split:
    one = lambda name: df.filter(F.col("_split") == name).select(*columns)
    return Split(one("train"), one("test"), None if validation is None else one("validation"))


def assign(df: DataFrame, key: str | Sequence[str], train: float, test: float, validation: float | None = None, seed: int | None = None) -> DataFrame:
    """df with _split. Sizes are rounded half up, 1 at least; without a seed the order of the key is cut, else the seeded order."""
    _check(train, test, validation)
    keys = [key] if isinstance(key, str) else list(key)
    order: list[Order] = list(keys) if seed is None else [seeded(seed, *keys), *keys]
    rows = materialize(with_row_id(df, order))
    n = rows.count()
    if n == 0:
        raise EmptyDataset("can't split an empty dataset")
    a = max(1, half_up(n * train))
    b = a + max(1, half_up(n * test))
    last = F.lit("test") if validation is None else F.when(F.col("_row_id") < b, "test").otherwise("validation")
    return rows.withColumn("_split", F.when(F.col("_row_id") < a, "train").otherwise(last)).drop("_row_id")


def from_ratios(df: DataFrame, key: str | Sequence[str], train: float, test: float, validation: float | None = None, seed: int | None = None) -> Split:
    return _parts(assign(df, key, train, test, validation, seed), df.columns, validation)


def place_in_class(df: DataFrame, label: str, order: Column, *ties: str, name: str = "_place") -> DataFrame:
    """Number the rows of each class 0, 1, ... by an order; classes of any size stay distributed."""
    rows = df.withColumn("_order", order).withColumn("_one", F.lit(1).cast("long"))
    rows = rows.withColumn("_by", F.struct("_order", *ties))
    return running_totals(rows, label, "_by", {"_upto": "_one"}).withColumn(name, F.col("_upto") - 1).drop("_order", "_one", "_by", "_upto")


def assign_stratified(df: DataFrame, label: str, key: str, train: float, test: float, validation: float | None = None, seed: int | None = None) -> DataFrame:
    """df with _split, cut within every class; rows of null label are dropped."""
    _check(train, test, validation)
    need(df, label, key)
    rows = df.filter(F.col(label).isNotNull())
    placed = place_in_class(rows, label, F.lit(0) if seed is None else seeded(seed, key), key)
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    placed = placed.join(sizes, F.col(label) == F.col("_label")).drop("_label")
    a = F.least(F.greatest(F.floor(F.col("_n") * train + 0.5), F.lit(1)), F.col("_n"))
    b = a + F.least(F.floor(F.col("_n") * test + 0.5), F.col("_n") - a)
    last = F.lit("test") if validation is None else F.when(F.col("_place") < b, "test").otherwise("validation")
    return placed.withColumn("_split", F.when(F.col("_place") < a, "train").otherwise(last)).select(*df.columns, "_split")


def stratified(df: DataFrame, label: str, key: str, train: float, test: float, validation: float | None = None, seed: int | None = None) -> Split:
    return _parts(materialize(assign_stratified(df, label, key, train, test, validation, seed)), df.columns, validation)


def resample(df: DataFrame, label: str, strategy: str, key: str, seed: int = 42) -> DataFrame:
    """Balance classes: 'oversample' to the largest (rows repeat evenly), 'undersample' to the smallest. Null labels go."""
    if strategy not in ("oversample", "undersample"):
        raise InvalidConfig("strategy is 'oversample' or 'undersample'")
    need(df, label, key)
    rows = df.filter(F.col(label).isNotNull())
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    target = sizes.agg((F.max if strategy == "oversample" else F.min)("_n")).first()[0]
    if target is None:
        raise EmptyDataset("no labels to balance")
    order = F.lit(0) if strategy == "oversample" else seeded(seed, key)
    placed = place_in_class(rows, label, order, key).join(sizes, F.col(label) == F.col("_label"))
    if strategy == "undersample":
        return placed.filter(F.col("_place") < target).select(*df.columns)
    copies = F.floor(F.lit(target) / F.col("_n")) + (F.col("_place") < F.lit(target) % F.col("_n")).cast("long")
    return placed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*df.columns)


def mix(inputs: Sequence[tuple[DataFrame, float]], key: str, seed: int = 42, max_rows: int | None = None) -> DataFrame:
    """Rows of several tables by weight: each gives trunc(total * weight / sum), cycling through its seeded order."""
    if not inputs or any(w <= 0 for _, w in inputs):
        raise InvalidConfig("weights must be positive")
    sizes = [d.count() for d, _ in inputs]
    total, whole = max_rows if max_rows is not None else sum(sizes), sum(w for _, w in inputs)
    out = None
    for i, ((d, w), n) in enumerate(zip(inputs, sizes, strict=True)):
        want = int(total * w / whole)
        if n == 0:
            continue
        rows = with_row_id(d, [seeded(seed + i, key), key])
        copies = F.lit(want // n).cast("long") + (F.col("_row_id") < want % n).cast("long")
        rows = rows.filter(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*d.columns)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise EmptyDataset("all inputs are empty")
    return out


def weighted_sample(df: DataFrame, weight: str, key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """n draws with replacement, proportional to weight; _draw numbers them. All-zero weights cycle through the rows.

    Draws are spread evenly over the running weight with a seeded offset each, so a row with the running weight
    (a, b] gets the draws that fall there: rows count their own draws, and no join on ranges is needed."""
    need(df, weight, key)
    stats = df.agg(F.count("*"), F.min(weight), F.sum(weight)).first()
    if stats[1] is not None and stats[1] < 0:
        raise InvalidConfig("weights can't be negative")
    size = stats[0] if n is None else n
    if not stats[0] or not size:
        return df.limit(0).withColumn("_draw", F.lit(0).cast("long"))
    if not stats[2]:
        rows = with_row_id(df, key)
        copies = F.lit(size // stats[0]).cast("long") + (F.col("_row_id") < size % stats[0]).cast("long")
        return rows.filter(copies > 0).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).withColumn("_draw", F.col("_row_id") + F.col("_i") * stats[0]).select(*df.columns, "_draw")
    rows = df.withColumn("_all", F.lit(0)).withColumn("_w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    rows = running_totals(rows, "_all", key, {"_upto": "_w"}).withColumn("_step", F.lit(stats[2] / size))
    # Stratum i of equal weight holds one draw, at a seeded place within it.
    rows = rows.withColumn("_from", F.floor((F.col("_upto") - F.col("_w")) / F.col("_step")).cast("long")).withColumn("_to", F.least(F.floor(F.col("_upto") / F.col("_step")).cast("long"), F.lit(size - 1)))
    rows = rows.filter("_w > 0").withColumn("_draw", F.explode(F.sequence(F.least("_from", "_to"), F.col("_to"))))
    at = (F.col("_draw") + uniform(seed, "_draw")) * F.col("_step")
    return rows.filter((at >= F.col("_upto") - F.col("_w")) & (at < F.col("_upto"))).select(*df.columns, "_draw")


def batches(df: DataFrame, size: int, order_by: Order | Sequence[Order], drop_last: bool = False) -> DataFrame:
    """df with _batch_id: runs of `size` rows in an order."""
    if size < 1:
        raise InvalidConfig("a batch holds one row at least")
    rows = with_row_id(df, order_by).withColumn("_batch_id", F.floor(F.col("_row_id") / size).cast("long"))
    if drop_last:
        rows = materialize(rows)
        rows = rows.filter(F.col("_batch_id") < rows.count() // size)
    return rows.drop("_row_id")


class DataLoader:
    """Iterate over Arrow batches; partitions are the workers, and prefetched while batches are consumed."""

    def __init__(self, df: DataFrame, batch_size: int = 1, shuffle: bool = False, drop_last: bool = False, seed: int | None = None, key: str | None = None, prefetch: bool = True):
        if batch_size < 1:
            raise InvalidConfig("a batch holds one row at least")
        if shuffle and key is None:
            raise InvalidConfig("shuffling needs the name of a key")
        self.df, self.batch_size, self.drop_last, self.prefetch = df, batch_size, drop_last, prefetch
        self.order = None if not (shuffle or key) else [seeded_digits(seed or 0, key), key] if shuffle else [key]

    def __len__(self) -> int:
        n = self.df.count()
        return n // self.batch_size if self.drop_last else -(-n // self.batch_size)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        """Partitions arrive as Arrow streams, in order, and are cut anew into batches."""
        df = self.df if self.order is None else self.df.orderBy(*self.order)
        schema = df.limit(0).toArrow().schema
        held, size = [], 0
        for data in self._parts(df.mapInArrow(_packed, "data binary")):
            part = pa.ipc.open_stream(data).read_all().cast(schema)
            held.append(part)
            size += part.num_rows
            while size >= self.batch_size:
                whole = pa.concat_tables(held)
                yield whole.slice(0, self.batch_size).combine_chunks().to_batches()[0]
                held, size = [whole.slice(self.batch_size)], size - self.batch_size
        if size and not self.drop_last:
            yield pa.concat_tables(held).combine_chunks().to_batches()[0]

    def _parts(self, packed: DataFrame) -> Iterator[bytes]:
        """Streams of rows, one partition at a time."""
        for row in packed.toLocalIterator(prefetchPartitions=self.prefetch):
            yield bytes(row.data)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 65536):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.slice(at, 65536))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])


class ParallelDataLoader(DataLoader):
    """A loader whose ``workers`` fetch partitions at the same time; batches are those of one worker, in the same order.

    Each worker runs a job over one partition. At most workers + ahead partitions are fetched or being fetched and not yet consumed, which
    bounds what the driver holds. A failure is raised at the place of its partition, and ends the loader. Without workers it is a DataLoader."""

    def __init__(self, df: DataFrame, *args, workers: int = 0, ahead: int = 2, **options):
        super().__init__(df, *args, **options)
        if workers < 0 or ahead < 1:
            raise InvalidConfig("workers can't be negative, and one partition at least is fetched ahead")
        self.workers, self.ahead = workers, ahead
        self.most_at_once = 0

    def _parts(self, packed: DataFrame) -> Iterator[bytes]:
        if not self.workers:
            yield from super()._parts(packed)
            return
        context, rdd = packed.sparkSession.sparkContext, packed.rdd
        places, free, stop = Queue(), threading.Semaphore(self.workers + self.ahead), threading.Event()
        fetched: list[Future] = [Future() for _ in range(rdd.getNumPartitions())]
        for p in range(len(fetched)):
            places.put(p)
        running, lock = [0], threading.Lock()

        def work() -> None:
            while not stop.is_set():
                free.acquire()  # before a place is taken, so that the place the consumer waits for is never the one without room
                try:
                    p = places.get_nowait()
                except Empty:
                    return
                with lock:
                    running[0] += 1
                    self.most_at_once = max(self.most_at_once, running[0])
                try:
                    fetched[p].set_result(context.runJob(rdd, lambda rows: [bytes(r.data) for r in rows], [p]))
                except Exception as e:  # noqa: BLE001  it belongs to whoever asks for this partition
                    fetched[p].set_exception(e)
                    stop.set()
                finally:
                    with lock:
                        running[0] -= 1

        threads = [threading.Thread(target=work, daemon=True) for _ in range(self.workers)]
        for t in threads:
            t.start()
        try:
            for p in range(len(fetched)):
                while True:
                    try:
                        data = fetched[p].result(timeout=0.1)
                        break
                    except TimeoutError:
                        # A place behind may have failed while this one was never begun.
                        if stop.is_set() and not any(t.is_alive() for t in threads) and not fetched[p].done():
                            raise next(f.exception() for f in fetched if f.done() and f.exception()) from None
                yield from data
                fetched[p] = Future()
                free.release()
        finally:
            stop.set()
            for _ in threads:
                free.release()


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows of each part."""
    return df.groupBy("_split").agg(F.count("*").alias("rows"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): sqrt(N / (K * n)), scaled to sum to K."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row per class
    raw = F.sqrt(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))
    counts = counts.withColumn("raw", raw)
    return counts.select(label, "n", (F.col("raw") * F.count("*").over(every) / F.sum("raw").over(every)).cast("float").alias("weight"))
