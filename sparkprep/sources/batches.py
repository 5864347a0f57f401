"""Batches pulled on the driver, and tables made of a user's own batches on the executors."""

from __future__ import annotations

import queue
import threading
from collections.abc import Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sparkprep.errors import InvalidConfig


class BatchSource(Protocol):
    """What a user implements: a schema, and the batches of each of its partitions, which executors ask for."""

    schema: str

    def partitions(self) -> int: ...

    def batches(self, partition: int) -> Iterator[pa.RecordBatch]: ...


class MemoryBatches:
    """Batches at hand, one a partition."""

    def __init__(self, schema: str, held: list[pa.RecordBatch]):
        self.schema, self._held = schema, held

    def partitions(self) -> int:
        return len(self._held)

    def batches(self, partition: int) -> Iterator[pa.RecordBatch]:
        yield self._held[partition]


def register(spark: SparkSession, name: str, source: BatchSource) -> None:
    """Make a source a format of ``spark.read`` and ``spark.readStream``: each of its partitions is a task.

    As a stream, a source may gain partitions; those that it has given must stay what they are. The offset is the number of partitions
    given so far, kept in the query's checkpoint: a query that is started anew goes on behind it, a batch that failed is read again, and a new
    checkpoint begins with the first partition."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(source.partitions())]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            yield from source.batches(partition.value)

    class StreamReader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"partitions": 0}

        def latestOffset(self) -> dict:
            return {"partitions": source.partitions()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [InputPartition(i) for i in range(start["partitions"], end["partitions"])]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            yield from source.batches(partition.value)

    class Registered(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return source.schema

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return Reader()

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ARG002
            return StreamReader()

    spark.dataSource.register(Registered)


def read_batches(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.format(name).load()


def stream_batches(spark: SparkSession, name: str) -> DataFrame:
    return spark.readStream.format(name).load()


class Prefetched:
    """The batches of a loader, fetched ahead by a thread into a queue of ``depth``; errors of the loader are raised where they are met."""

    def __init__(self, loader: Iterable[pa.RecordBatch], depth: int = 4):
        if depth < 1:
            raise InvalidConfig("a depth of one at least")
        self.loader, self.depth = loader, depth
        self.reset()

    def reset(self) -> None:
        """Begin anew; what has been fetched is thrown away."""
        if hasattr(self, "_stop"):
            self._stop.set()
        self._queue: queue.Queue = queue.Queue(self.depth)
        self._stop, self.done = threading.Event(), False
        threading.Thread(target=self._fill, args=(self._queue, self._stop), daemon=True).start()

    def _fill(self, into: queue.Queue, stop: threading.Event) -> None:
        def put(x) -> None:
            while not stop.is_set():
                try:
                    return into.put(x, timeout=0.1)
                except queue.Full:
                    continue

        try:
            for batch in self.loader:
                put(batch)
                if stop.is_set():
                    return
            put(None)
        except Exception as e:  # noqa: BLE001  it belongs to whoever asks for the next batch
            put(e)

    def _take(self, found) -> pa.RecordBatch | None:
        if found is None or isinstance(found, Exception):
            self.done = True
        if isinstance(found, Exception):
            raise found
        return found

    def next(self) -> pa.RecordBatch | None:
        """Wait for the next batch; None after the last one."""
        return None if self.done else self._take(self._queue.get())

    def try_next(self) -> pa.RecordBatch | None:
        """The next batch if it is there; None if it is not yet, or no more (then ``done`` is set)."""
        try:
            return None if self.done else self._take(self._queue.get_nowait())
        except queue.Empty:
            return None

    @property
    def buffered(self) -> int:
        return self._queue.qsize()

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        while (batch := self.next()) is not None:
            yield batch
