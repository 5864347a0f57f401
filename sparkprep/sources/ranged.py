"""Parquet files behind HTTP, read by ranges: footers plan the work, and executors fetch the column chunks that they need.

No file passes the driver, or any machine, as a whole: the driver sends the names, executors read the footers, row groups are dealt to
tasks, and a task fetches the columns asked for of its own row groups. Peak memory is one row group's columns, whatever
the size of the file. A server that doesn't answer ranges is found at the first request.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

from sparkprep.core import need
from sparkprep.errors import EmptyDataset, NotFound, StorageError
from sparkprep.sources.storage import HttpClient

#: Bytes of a first request for a footer: most footers are shorter.
TAIL = 64 << 10


class RangedFile(io.RawIOBase):
    """A remote file that can be sought; each read is one request for a range, but what has been read of its end."""

    def __init__(self, url: str, client: HttpClient, token: str | None = None):
        super().__init__()
        self.url, self.client, self.headers, self.at = url, client, {"Authorization": f"Bearer {token}"} if token else {}, 0
        status, headers, self.tail = self.client.request("GET", url, {**self.headers, "Range": f"bytes=-{TAIL}"})
        if status == 404:
            raise NotFound(url)
        found = {k.lower(): v for k, v in headers.items()}.get("content-range", "")
        if status != 206 or "/" not in found:
            raise StorageError(f"{url}: status {status}, no ranges")
        self.size = int(found.rpartition("/")[2])

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = (0, self.at, self.size)[whence] + offset
        return self.at

    def read(self, n: int = -1) -> bytes:
        end = self.size if n is None or n < 0 else min(self.at + n, self.size)
        if end <= self.at:
            return b""
        held = self.size - len(self.tail)
        if self.at >= held:
            out = self.tail[self.at - held : end - held]
        else:
            status, _, out = self.client.request("GET", self.url, {**self.headers, "Range": f"bytes={self.at}-{end - 1}"})
            if status != 206 or len(out) != end - self.at:
                raise StorageError(f"{self.url}: status {status}, {len(out)} of {end - self.at} bytes")
        self.at = end
        return out


def _open(url: str, client: HttpClient, token: str | None) -> pq.ParquetFile:
    return pq.ParquetFile(pa.PythonFile(RangedFile(url, client, token), mode="r"))


def row_groups(spark: SparkSession, urls: Sequence[str], client: HttpClient, token: str | None = None) -> DataFrame:
    """(url, row_group, rows, bytes) of the files, from their footers, which executors read."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                meta = _open(url, client, token).metadata
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                yield pa.RecordBatch.from_arrays([pa.array([url] * len(groups), pa.string()), pa.array(range(len(groups)), pa.int64()), pa.array([g.num_rows for g in groups], pa.int64()), pa.array([g.total_byte_size for g in groups], pa.int64())], ["url", "row_group", "rows", "bytes"])

    files = spark.createDataFrame([(u,) for u in urls], "url string")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(footers, "url string, row_group long, rows long, bytes long")


def read_ranged(spark: SparkSession, urls: Sequence[str], client: HttpClient | None = None, token: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of Parquet files at URLs, which have one schema. columns: those to fetch."""
    if not urls:
        raise EmptyDataset("no files")
    client = client or HttpClient()
    schema = _open(urls[0], client, token).schema_arrow
    need(spark.createDataFrame([], from_arrow_schema(schema)), *(columns or ()))
    names = list(columns) if columns is not None else schema.names
    kept = pa.schema([schema.field(n) for n in names])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, group in zip(batch.column("url").to_pylist(), batch.column("row_group").to_pylist(), strict=True):
                found = _open(url, client, token).read_row_group(group, columns=names)
                yield from found.select(names).cast(kept).to_batches(max_chunksize=10_000)

    groups = row_groups(spark, urls, client, token).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return groups.mapInArrow(fetch, from_arrow_schema(kept))
