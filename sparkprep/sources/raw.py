"""Raw text and bytes whose format is found by looking at them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkprep.errors import EmptyDataset, InvalidConfig
from sparkprep.sources.files import CsvOptions, from_csv_str, from_json_str, from_parquet_bytes

FORMATS = ("csv", "tsv", "json", "jsonl", "text", "unknown")


@dataclass(frozen=True)
class RawConfig:
    force_format: str | None = None
    has_header: bool = True
    delimiter: str | None = None
    max_rows: int | None = None
    infer_types: bool = True
    description: str | None = None


def detect(text: str, config: RawConfig | None = None) -> str:
    """JSON lines, JSON, tabs or commas (a whole one per line on average over five lines), else text."""
    if config and config.force_format:
        if config.force_format not in FORMATS:
            raise InvalidConfig(f"format is one of {', '.join(FORMATS)}")
        return config.force_format
    lines = text.strip().splitlines()
    if not lines:
        return "unknown"
    objects = [x.strip() for x in lines[:2] if x.strip().startswith("{") and x.strip().endswith("}")]
    if len(lines) > 1 and len(objects) == 2:
        return "jsonl"
    if lines[0].lstrip()[0] in "{[":
        return "json"
    first = lines[:5]
    commas, tabs = (sum(x.count(c) for x in first) // len(first) for c in ",\t")
    return "tsv" if tabs and tabs >= commas else "csv" if commas else "text"


def detected(df: DataFrame, column: str, name: str = "format", config: RawConfig | None = None) -> DataFrame:
    """df with the format of each text of a column; null texts are unknown."""
    schema, at = T.StructType([*df.schema, T.StructField(name, T.StringType())]), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([detect(x or "", config) for x in batch.column(at).to_pylist()], pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def parse(spark: SparkSession, text: str, config: RawConfig | None = None) -> DataFrame:
    """A table of the text in the format found; plain text has one column, line."""
    c = config or RawConfig()
    kind = detect(text, c)
    if kind == "unknown":
        raise EmptyDataset("no data")
    if kind in ("csv", "tsv"):
        df = from_csv_str(spark, text.strip(), CsvOptions(c.has_header, c.delimiter or ("\t" if kind == "tsv" else ",")))
        if not c.infer_types:
            df = df.select(*[df[x].cast("string").alias(x) for x in df.columns])
    elif kind == "json":
        df = spark.read.option("multiLine", True).json(spark.sparkContext.parallelize([text], 1))
    elif kind == "jsonl":
        df = from_json_str(spark, text)
    else:
        df = spark.createDataFrame([(x,) for x in text.splitlines()], "line string")
    return df.limit(c.max_rows) if c.max_rows is not None else df


def parse_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    """By the first bytes: Parquet, JSON or CSV."""
    if data[:4] == b"PAR1":
        return from_parquet_bytes(spark, data)
    text = data.decode("utf-8")
    return parse(spark, text, RawConfig(force_format=None if text.lstrip()[:1] in ("{", "[") else "csv"))
