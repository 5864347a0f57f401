"""Declarative content schemas with checks, and content kinds that flatten JSON documents to rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.errors import InvalidConfig, NotFound, ParseError
from sparkprep.sources import raw
from sparkprep.sources.files import to_parquet_bytes

KINDS = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "datetime": T.TimestampType(), "binary": T.BinaryType(), "reference": T.StringType()}


@dataclass(frozen=True)
class Constraint:
    """min, max, min_length, max_length, pattern or enum; others must be registered as custom checks."""

    kind: str
    value: object

    def column(self, c: Column, kind: T.DataType, custom: dict[str, Callable[[Column, object], Column]]) -> Column:
        size = F.size(c) if isinstance(kind, T.ArrayType) else F.length(c)
        simple = {"min": lambda: c >= self.value, "max": lambda: c <= self.value, "min_length": lambda: size >= self.value, "max_length": lambda: size <= self.value, "pattern": lambda: c.rlike(self.value), "enum": lambda: c.isin(list(self.value))}
        if self.kind in simple:
            return simple[self.kind]()
        if self.kind not in custom:
            raise InvalidConfig(f"no check {self.kind!r}")
        return custom[self.kind](c, self.value)


@dataclass(frozen=True)
class Field:
    name: str
    kind: str | dict
    nullable: bool = False
    description: str | None = None
    default: object = None
    constraints: tuple[Constraint, ...] = ()

    @property
    def spark_type(self) -> T.DataType:
        return spark_type(self.kind)


def spark_type(kind: str | dict) -> T.DataType:
    """A name of KINDS, {'array': kind} or {'object': [fields]}."""
    if isinstance(kind, dict):
        if "array" in kind:
            return T.ArrayType(spark_type(kind["array"]))
        return T.StructType([T.StructField(f.name, f.spark_type, f.nullable) for f in kind["object"]])
    if kind not in KINDS:
        raise InvalidConfig(f"no field kind {kind!r}")
    return KINDS[kind]


@dataclass(frozen=True)
class Schema:
    name: str
    version: str = "1.0"
    fields: tuple[Field, ...] = ()
    custom: dict = field(default_factory=dict, compare=False)

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type, f.nullable) for f in self.fields])

    def violations(self) -> Column:
        """An array of the names of broken rules of a row, for tables with these columns."""
        rules = []
        for f in self.fields:
            c = F.col(f.name)
            if not f.nullable:
                rules.append(F.when(c.isNull(), f"{f.name}:required"))
            rules += [F.when(c.isNotNull() & ~k.column(c, f.spark_type, self.custom), f"{f.name}:{k.kind}") for k in f.constraints]
        return F.filter(F.array(*rules), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")

    def validate(self, df: DataFrame) -> DataFrame:
        """df with _violations."""
        for f in self.fields:
            if f.name not in df.columns:
                raise InvalidConfig(f"column {f.name!r} is missing")
        return df.withColumn("_violations", self.violations())

    def is_valid(self, df: DataFrame) -> bool:
        return self.validate(df).filter(F.size("_violations") > 0).isEmpty()


@dataclass(frozen=True)
class Issue:
    path: str
    message: str


@dataclass(frozen=True)
class RenderHints:
    chart_type: str | None = None
    x_column: str | None = None
    y_column: str | None = None
    color_column: str | None = None
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class ContentKind:
    """How documents of a kind are read, checked and flattened."""

    name: str
    struct: str
    required: tuple[str, ...]
    rows: Callable[[DataFrame], DataFrame]
    hints: RenderHints = RenderHints()

    def parse(self, documents: DataFrame, column: str = "json") -> DataFrame:
        """Rows of JSON -> one row per document; damaged documents raise."""
        parsed = documents.select(F.from_json(column, self.struct, {"mode": "FAILFAST"}).alias("d"))
        return parsed.select("d.*")

    def validate(self, document: str) -> list[Issue]:
        try:
            d = json.loads(document)
        except ValueError as e:
            raise ParseError(str(e)) from e
        out = [Issue(k, f"{k} is required") for k in self.required if not d.get(k)]
        for i, c in enumerate(d.get("chapters", []) if self.name == "book" else []):
            out += [Issue(f"chapters[{i}].{k}", f"{k} is required") for k in ("id", "title") if not c.get(k)]
        return out

    def issues(self, documents: DataFrame, key: str, column: str = "json") -> DataFrame:
        """(key, path, message) of every document: what validate() finds in one of them, as expressions over all."""
        parsed = documents.select(F.col(key), F.from_json(column, self.struct, {"mode": "FAILFAST"}).alias("d"))
        kinds = dict(parsed.select("d.*").dtypes)
        empty = lambda c, kind="string": F.coalesce(c.cast("string"), F.lit("")).isin("") if kind == "string" else c.isNull() | (c == 0)
        issue = lambda path, k: F.struct(path.alias("path"), F.lit(f"{k} is required").alias("message"))
        found = F.array(*[F.when(empty(F.col(f"d.{k}"), kinds[k]), issue(F.lit(k), k)) for k in self.required])
        if self.name == "book":
            within = lambda c, i: F.array(*[F.when(empty(c[k]), issue(F.format_string(f"chapters[%d].{k}", i), k)) for k in ("id", "title")])
            found = F.concat(found, F.coalesce(F.flatten(F.transform("d.chapters", within)), F.array()))
        return parsed.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select(key, "i.path", "i.message")

    def to_rows(self, documents: DataFrame, column: str = "json") -> DataFrame:
        return self.rows(self.parse(documents, column))

    def chunks(self, documents: DataFrame, size: int) -> Iterator[pa.RecordBatch]:
        yield from self.to_rows(documents).toArrow().to_batches(size)


_COURSE = "id string, title string, description string, short_description string, categories array<string>, weeks int, featured boolean, difficulty string, prerequisites array<string>, outline struct<title:string,weeks:array<struct<number:int,title:string,lessons:array<struct<number:string,title:string,assets:array<struct<filename:string,kind:string,description:string>>>>>>>"
_BOOK = "id string, title string, author string, description string, version string, source_url string, chapters array<struct<id:string,title:string,order:int,source_file:string,settings:struct<estimated_time:string,difficulty:string,prerequisites:array<string>>>>"

COURSE = ContentKind("course", _COURSE, ("id", "title", "weeks"), lambda d: d.select("id", "title", "description", F.col("weeks").cast("string").alias("weeks"), F.array_join("categories", ", ").alias("categories")))
BOOK = ContentKind("book", _BOOK, ("id", "title", "author"), lambda d: d.select(F.explode("chapters").alias("c")).select(F.col("c.id").alias("chapter_id"), F.col("c.title").alias("chapter_title"), F.col("c.order").cast("string").alias("order"), F.col("c.settings.difficulty").alias("difficulty"), F.col("c.settings.estimated_time").alias("estimated_time")))


@dataclass(frozen=True)
class TableKind:
    """Content that is a table itself: bytes of Parquet, JSON or CSV ('dataset'), or text whose format is found ('raw')."""

    name: str
    schema: Schema
    read: Callable[[SparkSession, bytes], DataFrame]
    hints: RenderHints = RenderHints("table")

    def parse(self, spark: SparkSession, data: bytes) -> DataFrame:
        return self.read(spark, data)

    def serialize(self, df: DataFrame) -> bytes:
        return to_parquet_bytes(df)

    def chunks(self, spark: SparkSession, data: bytes, size: int) -> Iterator[pa.RecordBatch]:
        yield from self.parse(spark, data).toArrow().to_batches(size)


def _raw(spark: SparkSession, data: bytes) -> DataFrame:
    try:
        return raw.parse(spark, data.decode("utf-8"))
    except UnicodeDecodeError as e:
        raise ParseError("not UTF-8 text") from e


DATASET = TableKind("dataset", Schema("dataset", fields=(Field("name", "string", constraints=(Constraint("min_length", 1),)), Field("format", "string", True, constraints=(Constraint("enum", ("parquet", "csv", "json", "arrow")),)), Field("rows", "integer", True), Field("columns", "integer", True))), raw.parse_bytes)
RAW = TableKind("raw", Schema("raw", fields=(Field("data", "string", True), Field("source", "string", True), Field("format", "string", True))), _raw)


class ContentRegistry:
    """Kinds by name."""

    def __init__(self, *kinds: ContentKind):
        self._kinds = {k.name: k for k in kinds or (COURSE, BOOK, DATASET, RAW)}

    def register(self, kind: ContentKind | TableKind) -> None:
        self._kinds[kind.name] = kind

    def get(self, name: str) -> ContentKind | TableKind:
        if name not in self._kinds:
            raise NotFound(name)
        return self._kinds[name]

    def names(self) -> list[str]:
        return sorted(self._kinds)


def documents(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "json string")


