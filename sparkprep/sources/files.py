"""Reading and writing tables: Parquet, CSV and JSON lines, from files, bytes and strings."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkprep.errors import EmptyDataset, InvalidConfig, SchemaMismatch, UnsupportedFormat

#: Rows that types are inferred from.
INFER_ROWS = 1000


@dataclass(frozen=True)
class CsvOptions:
    header: bool = True
    delimiter: str = ","
    schema: T.StructType | str | None = None


@dataclass(frozen=True)
class JsonOptions:
    schema: T.StructType | str | None = None


def from_batches(spark: SparkSession, batches: Sequence[pa.RecordBatch]) -> DataFrame:
    """A table of Arrow batches that share one schema."""
    if not batches:
        raise EmptyDataset("no batches")
    if any(b.schema != batches[0].schema for b in batches):
        raise SchemaMismatch("batches differ in schema")
    return spark.createDataFrame(pa.Table.from_batches(list(batches)))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan Parquet; a projection reaches the scan, unknown names in it are ignored, and none left means all."""
    df = spark.read.parquet(path)
    known = [c for c in columns or [] if c in df.columns]
    return df.select(*known) if known else df


def from_parquet_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(pq.read_table(io.BytesIO(data)))


def to_parquet_bytes(df: DataFrame) -> bytes:
    """For tables that fit on the driver."""
    out = io.BytesIO()
    pq.write_table(df.toArrow(), out)
    return out.getvalue()


def _head(spark: SparkSession, path: str, n: int) -> list[str]:
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def read_csv(spark: SparkSession, path: str, options: CsvOptions | None = None) -> DataFrame:
    """CSV; without a schema, types come from the first rows alone, so that large files are scanned once."""
    o = options or CsvOptions()
    schema = o.schema
    if schema is None:
        schema = from_csv_lines(spark, _head(spark, path, INFER_ROWS + o.header), o).schema
    return spark.read.csv(path, header=o.header, sep=o.delimiter, schema=schema)


def from_csv_lines(spark: SparkSession, lines: Sequence[str], options: CsvOptions | None = None) -> DataFrame:
    o = options or CsvOptions()
    reader = spark.read.option("header", o.header).option("sep", o.delimiter)
    reader = reader.schema(o.schema) if o.schema is not None else reader.option("inferSchema", True)
    return reader.csv(spark.sparkContext.parallelize(list(lines), 1))


def from_csv_str(spark: SparkSession, text: str, options: CsvOptions | None = None) -> DataFrame:
    return from_csv_lines(spark, text.splitlines(), options)


def read_json(spark: SparkSession, path: str, options: JsonOptions | None = None) -> DataFrame:
    """JSON lines; without a schema, types come from the first rows alone."""
    o = options or JsonOptions()
    schema = o.schema if o.schema is not None else spark.read.json(spark.sparkContext.parallelize(_head(spark, path, INFER_ROWS), 1)).schema
    return spark.read.schema(schema).json(path)


def from_json_str(spark: SparkSession, text: str, options: JsonOptions | None = None) -> DataFrame:
    lines = spark.sparkContext.parallelize([x for x in text.splitlines() if x.strip()], 1)
    reader = spark.read.schema(options.schema) if options and options.schema is not None else spark.read
    return reader.json(lines)


def kind_of(path: str) -> str:
    kinds = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json", ".arrow": "ipc", ".feather": "ipc", ".ipc": "ipc", ".arrows": "ipc_stream", ".spd": "container"}
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in kinds:
        raise UnsupportedFormat(f"unknown kind of file: {path}")
    return kinds[suffix]


def load(spark: SparkSession, path: str) -> DataFrame:
    """Read by extension."""
    kind = kind_of(path)
    if kind in ("ipc", "ipc_stream"):
        from sparkprep.sources.arrow_ipc import read_ipc

        return read_ipc(spark, path, stream=kind == "ipc_stream")
    if kind == "container":
        from sparkprep.sources.container import read_container

        return read_container(spark, path)
    return {"parquet": read_parquet, "csv": read_csv, "json": read_json}[kind](spark, path)


def save(df: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """Write by extension: a folder of files, or one file in it."""
    kind = kind_of(path)
    out = (df.coalesce(1) if single else df).write.mode(mode)
    if kind == "parquet":
        out.parquet(path)
    elif kind == "csv":
        out.option("header", True).csv(path)
    elif kind == "json":
        out.json(path)
    elif kind in ("ipc", "ipc_stream"):
        from sparkprep.sources.arrow_ipc import write_ipc

        write_ipc(df, path, stream=kind == "ipc_stream")
    else:
        raise InvalidConfig("containers are written by sparkprep.sources.container")


def iterate(df: DataFrame, batch_size: int = 1024, prefetch: bool = True) -> Iterator[pa.RecordBatch]:
    """Pull a table batch by batch with bounded memory; the next partition is fetched meanwhile, and errors are raised."""
    if batch_size < 1:
        raise InvalidConfig("a batch holds one row at least")
    from sparkprep.operators.splits import DataLoader

    yield from DataLoader(df, batch_size, prefetch=prefetch)


