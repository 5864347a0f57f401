"""Arrow IPC files and streams, in any store that both Spark and Arrow know.

Reading: Spark lists the files, executors read their footers, and runs of record batches are dealt to tasks, which fetch
their own ranges; a file of any size is read by many tasks, and no task holds more than a record batch. Streams have no
footer, so each is one task, batch by batch.

Writing is a Python data source: each task attempt writes one file of its own into a temporary folder of the job, and the
commit moves the files of successful attempts to their places; only then does an overwrite delete what was there before.
A failed job deletes its temporary folder and nothing else.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema

from sparkprep.errors import EmptyDataset
from sparkprep.sources.storage import arrow_uri, qualified

#: Record batches a task reads at once of one file.
RUN = 16


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(rest): what follows the path in each file's name; and the path as Arrow knows it."""
    fixed = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    fixed = path if fixed == path else fixed.rpartition("/")[0]
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(qualified(fixed))
    base = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    names = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path")
    return names.select(F.substring("path", len(base) + 1, 1 << 30).alias("rest")), arrow_uri(spark, fixed)


def runs(spark: SparkSession, path: str, batches: int = RUN) -> DataFrame:
    """(rest, first, n): the record batches of the IPC files at a path, in runs, from the files' footers."""
    files, uri = _files(spark, path)

    def footers(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for part in rows:
            for rest in part.column(0).to_pylist():
                with system.open_input_file(root + rest) as f, pa.ipc.open_file(f) as source:
                    total = source.num_record_batches
                first = list(range(0, total, batches))
                yield pa.RecordBatch.from_arrays([pa.array([rest] * len(first), pa.string()), pa.array(first, pa.int64()), pa.array([min(batches, total - x) for x in first], pa.int64())], ["rest", "first", "n"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(footers, "rest string, first long, n long").repartition(n)


def read_ipc(spark: SparkSession, path: str, stream: bool = False, batches: int = RUN) -> DataFrame:
    """All IPC files (or streams) at a path; the schema is that of one of them."""
    files, uri = _files(spark, path)

    def schemas(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for part in rows:
            for rest in part.column(0).to_pylist():
                with system.open_input_file(root + rest) as f, (pa.ipc.open_stream if stream else pa.ipc.open_file)(f) as source:
                    yield pa.RecordBatch.from_arrays([pa.array([source.schema.serialize().to_pybytes()], pa.binary())], ["schema"])

    found = files.limit(1).mapInArrow(schemas, "schema binary").first()
    if found is None:
        raise EmptyDataset(f"no files at {path}")
    schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(found.schema))))

    def ranges(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for part in rows:
            for rest, first, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                with system.open_input_file(root + rest) as f, pa.ipc.open_file(f) as source:
                    yield from (source.get_batch(i) for i in range(first, first + n))

    def whole(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(uri)
        for part in rows:
            for rest in part.column(0).to_pylist():
                with system.open_input_stream(root + rest) as f, pa.ipc.open_stream(f) as source:
                    yield from source

    if stream:
        return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(whole, schema)
    return runs(spark, path, batches).mapInArrow(ranges, schema)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class IpcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.stream, self.overwrite = options["uri"], options.get("mode") == "stream", overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task, (system, root) = TaskContext.get(), fs.FileSystem.from_uri(self.uri)
        name = f"part-{task.partitionId():05d}-{self.job[11:]}-{task.taskAttemptId()}.{'arrows' if self.stream else 'arrow'}"
        first = next(iterator, None)
        if first is None:
            return Written(None)
        system.create_dir(f"{root}/{self.job}", recursive=True)
        with system.open_output_stream(f"{root}/{self.job}/{name}") as out, (pa.ipc.new_stream if self.stream else pa.ipc.new_file)(out, first.schema) as sink:
            sink.write_batch(first)
            for batch in iterator:
                sink.write_batch(batch)
        return Written(name)

    def commit(self, messages: list) -> None:
        system, root = fs.FileSystem.from_uri(self.uri)
        system.create_dir(root, recursive=True)
        before = [f for f in system.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith(("_", "."))] if self.overwrite else []
        for m in messages:
            if m is not None and m.name:
                system.move(f"{root}/{self.job}/{m.name}", f"{root}/{m.name}")
        for f in before:
            (system.delete_dir if f.type == fs.FileType.Directory else system.delete_file)(f.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:  # noqa: ARG002
        system, root = fs.FileSystem.from_uri(self.uri)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class IpcSource(DataSource):
    """Format "arrow_ipc" for writing to a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def writer(self, schema, overwrite: bool) -> IpcWriter:  # noqa: ARG002
        return IpcWriter(dict(self.options), overwrite)


def write_ipc(df: DataFrame, path: str, stream: bool = False) -> None:
    """One file per partition that has rows; what was at the path is replaced once all are there."""
    spark = df.sparkSession
    spark.dataSource.register(IpcSource)
    df.write.format("arrow_ipc").mode("overwrite").option("uri", arrow_uri(spark, path)).option("mode", "stream" if stream else "file").save()
