"""Chunked containers: a folder of chunks that executors write, and an index that makes them one table of numbered rows.

A chunk is a run of rows of one partition. Each of its columns is compressed by itself, so a reader fetches the columns
and the chunks that it needs and no others. Chunks lie in Parquet files, one row a chunk, which Spark writes and reads: any
store that Spark reaches will do, a retried or a failed task leaves nothing, and bodies never pass the driver. What the
driver writes is the index: a few numbers a chunk, which a scan of the chunks' small columns gives it.

    path/chunks-<id>/part-*.parquet   run, part, seq, n, and c0, c1, ... (a column's chunk: length, CRC-32, compressed IPC stream)
    path/index-<version>              header, list of chunks, check sum; appears by a rename, once its chunks are there

A write that fails before the rename leaves the table as it was, and its own chunks are deleted; two writers of one version
can't both succeed. Appending adds a folder and an index, so a reader keeps the version that it opened.

Encryption: every run of chunks has a key of its own, kept in the index under a password or a recipient's public key.
Spark's AES-GCM seals each column of each chunk with a nonce of its own, and authenticates container, run, partition,
sequence, rows and column with it: chunks that change places, or whose numbers of rows were changed, don't open. The
index has a MAC under the key of its last run; ``verify`` tells whether every listed chunk is there.

The format "sparkprep_chunks" gives Spark one input partition a chunk and a column ``_row``, the number of the row;
filters on it choose chunks in planning. It opens files from Python workers, so it takes stores that Arrow knows.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

from sparkprep.core import need
from sparkprep.errors import ChecksumMismatch, DecryptionFailed, EmptyDataset, FormatError, InvalidConfig
from sparkprep.sources import crypto
from sparkprep.sources.container import Compression, compress, decompress
from sparkprep.sources.storage import HadoopStorage, arrow_uri, qualified

MAGIC, ROWS, ROW = b"SPCH", 65536, "_row"
FORMAT = "sparkprep_chunks"
_ENTRY = struct.Struct("<IQQQQ")
_BODY = struct.Struct("<QI")
_INDEX = re.compile(r"index-(\d{8})$")
#: A chunk is a row group, so that files are read by the chunk.
_PARQUET = {"compression": "none", "parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}


@dataclass(frozen=True)
class Chunk:
    run: int
    part: int
    seq: int
    num_rows: int
    row_offset: int


@dataclass(frozen=True)
class Index:
    """What a version of a container consists of. keys: of each run its sealed key, or none."""

    container: str
    version: int
    schema: pa.Schema
    compression: Compression
    folders: list[str]
    keys: list[bytes]
    sealing: str
    chunks: list[Chunk]

    @property
    def num_rows(self) -> int:
        return self.chunks[-1].row_offset + self.chunks[-1].num_rows if self.chunks else 0

    def dumps(self, secret: bytes = b"") -> bytes:
        text = lambda x: base64.b64encode(x).decode()
        head = {"container": self.container, "version": self.version, "schema": text(self.schema.serialize().to_pybytes()), "compression": int(self.compression), "folders": self.folders, "keys": [text(k) for k in self.keys], "sealing": self.sealing}
        head = json.dumps(head).encode()
        entries = zlib.compress(b"".join(_ENTRY.pack(c.run, c.part, c.seq, c.num_rows, c.row_offset) for c in self.chunks))
        data = MAGIC + struct.pack("<IQ", len(head), len(entries)) + head + entries
        data += hmac.new(secret, data, hashlib.sha256).digest()
        return data + struct.pack("<I", zlib.crc32(data))

    @staticmethod
    def loads(data: bytes) -> Index:
        if data[:4] != MAGIC:
            raise FormatError("not a chunked container")
        if len(data) < 52 or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ChecksumMismatch("the index is damaged")
        n_head, n_entries = struct.unpack_from("<IQ", data, 4)
        head = json.loads(data[16 : 16 + n_head])
        entries = zlib.decompress(data[16 + n_head : 16 + n_head + n_entries])
        raw = base64.b64decode
        return Index(head["container"], head["version"], pa.ipc.read_schema(pa.py_buffer(raw(head["schema"]))), Compression(head["compression"]), head["folders"], [raw(k) for k in head["keys"]], head["sealing"], [Chunk(*x) for x in _ENTRY.iter_unpack(entries)])

    def authentic(self, data: bytes, secret: bytes) -> bool:
        return hmac.compare_digest(data[-36:-4], hmac.new(secret, data[:-36], hashlib.sha256).digest())

    def find(self, row: int) -> int:
        """The chunk that holds a row, by bisection; -1 if none does."""
        i = bisect_right(self.chunks, row, key=lambda c: c.row_offset) - 1
        return i if i >= 0 and row < self.chunks[i].row_offset + self.chunks[i].num_rows else -1

    def between(self, start: int, stop: int) -> list[Chunk]:
        first = max(0, bisect_right(self.chunks, start, key=lambda c: c.row_offset) - 1)
        last = bisect_right(self.chunks, stop - 1, key=lambda c: c.row_offset)
        return [c for c in self.chunks[first:last] if c.row_offset < stop and c.row_offset + c.num_rows > start]


# ------------------------------------------------------------------ bodies
def seal_body(column: pa.ChunkedArray, field: pa.Field, how: Compression) -> bytes:
    """Length, CRC-32 and compressed IPC stream of one column of a chunk."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([field])) as out:
        out.write_table(pa.table([column.combine_chunks()], pa.schema([field])))
    plain = sink.getvalue().to_pybytes()
    body = compress(plain, how)
    return _BODY.pack(len(plain), zlib.crc32(body)) + body


def open_body(data: bytes, how: Compression) -> pa.ChunkedArray:
    size, crc = _BODY.unpack_from(data)
    body = data[_BODY.size :]
    if zlib.crc32(body) != crc:
        raise ChecksumMismatch("a chunk is damaged")
    return pa.ipc.open_stream(decompress(body, how, size)).read_all().column(0)


def _bodies(run: int, schema: pa.Schema, chunk_rows: int, how: Compression):
    """(run, part, seq, n, c0, ...): the rows of a partition, cut into chunks."""
    names = ["run", "part", "seq", "n", *(f"c{i}" for i in range(len(schema)))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit(table: pa.Table) -> pa.RecordBatch:
            table = table.cast(schema)
            bodies = [seal_body(table.column(i), f, how) for i, f in enumerate(schema)]
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (run, part, seq, table.num_rows)), *(pa.array([x], pa.binary()) for x in bodies)], names)

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                size += batch.num_rows
            while size >= chunk_rows:
                whole = pa.concat_tables(held)
                yield emit(whole.slice(0, chunk_rows))
                held, size, seq = [whole.slice(chunk_rows)], size - chunk_rows, seq + 1
        if size:
            yield emit(pa.concat_tables(held))

    return cut


def _rows(how: Compression, schema: pa.Schema, trims: dict[tuple, tuple[int, int]]):
    """Parse fetched chunks; of those in trims only the rows between two places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, at in enumerate(zip(*(batch.column(c).to_pylist() for c in ("run", "part", "seq")), strict=True)):
                columns = [open_body(batch.column(4 + k)[i].as_py(), how) for k in range(len(schema))]
                low, high = trims.get(at, (0, batch.column("n")[i].as_py()))
                if columns:
                    yield from pa.table(columns, schema).slice(low, high - low).to_batches()

    return run


def _place(container: str, column: int) -> Column:
    """What AES-GCM authenticates with a column of a chunk."""
    return F.concat_ws("/", F.lit(container), "run", "part", "seq", "n", F.lit(str(column))).cast("binary")


def _chunk_schema(columns: Sequence[int]) -> T.StructType:
    return T.StructType([*(T.StructField(c, T.LongType()) for c in ("run", "part", "seq", "n")), *(T.StructField(f"c{i}", T.BinaryType()) for i in columns)])


def _keyed(chunks: DataFrame, keys: dict[int, bytes]) -> DataFrame:
    """Each chunk with the key of its run: one row a run, and no literal in the plan."""
    return chunks.join(F.broadcast(chunks.sparkSession.createDataFrame(list(keys.items()), "run long, key binary")), "run")


# ------------------------------------------------------------------ writing
def _store(spark: SparkSession, path: str) -> HadoopStorage:
    return HadoopStorage(spark, qualified(path))


def versions(store: HadoopStorage) -> list[str]:
    """The names of the indexes, the newest last."""
    return [k for k in store.glob("index-*") if _INDEX.fullmatch(k)]


def newest(store: HadoopStorage, path: str) -> tuple[Index, bytes]:
    found = versions(store)
    if not found:
        raise EmptyDataset(f"no chunked container at {path}")
    data = store.get(found[-1])
    return Index.loads(data), data


def write_chunks(df: DataFrame, path: str, chunk_rows: int = ROWS, compression: Compression = Compression.ZSTD_3, mode: str = "overwrite", password: str | None = None, recipient: bytes | None = None) -> Index:
    """Write the rows of df, in the order of its partitions, as a new container, or behind those of an old one.

    mode: overwrite, append (schema and sealing must agree), or error if there is one. Containers with a password or for a recipient are
    encrypted; each run has a key of its own."""
    if chunk_rows < 1:
        raise InvalidConfig("a chunk has one row at least")
    if mode not in ("overwrite", "append", "error"):
        raise InvalidConfig(f"mode {mode} is not one of overwrite, append, error")
    if not df.columns:
        raise EmptyDataset("a table without columns")
    spark = df.sparkSession
    store, schema = _store(spark, path), df.limit(0).toArrow().schema
    before = versions(store)
    if before and mode == "error":
        raise InvalidConfig(f"there is a container at {path}")
    old = newest(store, path)[0] if before and mode == "append" else None
    if old and not old.schema.equals(schema):
        raise InvalidConfig("what is appended must have the container's schema")
    sealing = "password" if password is not None else "recipient" if recipient is not None else ""
    if old and old.sealing != sealing:
        raise InvalidConfig("what is appended must be sealed as the container is")
    how = old.compression if old else compression
    version = int(_INDEX.fullmatch(before[-1])[1]) + 1 if before else 0
    name, folder, run = old.container if old else uuid.uuid4().hex, f"chunks-{uuid.uuid4().hex}", len(old.folders) if old else 0
    key = os.urandom(crypto.KEY) if sealing else b""
    index = Index(name, version, schema, how, [*(old.folders if old else []), folder], [*(old.keys if old else []), *([_seal(spark, key, password, recipient)] if sealing else [])], sealing, old.chunks if old else [])
    columns = range(len(schema))
    bodies = df.mapInArrow(_bodies(run, schema, chunk_rows, how), _chunk_schema(columns))
    if sealing:
        bodies = _keyed(bodies, {run: key}).select("run", "part", "seq", "n", *(F.aes_encrypt(f"c{i}", "key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _place(name, i)).alias(f"c{i}") for i in columns))
    try:
        bodies.write.options(**_PARQUET).parquet(f"{store.root}/{folder}")
        sizes = spark.read.schema(_chunk_schema([])).parquet(f"{store.root}/{folder}").orderBy("part", "seq").collect()  # a few numbers a chunk
        chunks, row = list(index.chunks), index.num_rows
        for r in sizes:
            chunks.append(Chunk(run, r.part, r.seq, r.n, row))
            row += r.n
        index = replace(index, chunks=chunks)
        store.put(f"new-{folder}", index.dumps(key))
        store.rename(f"new-{folder}", f"index-{version:08d}")
    except Exception:
        store.delete(f"new-{folder}")
        store.delete(folder, True)
        raise
    if mode == "overwrite":
        for gone in before:
            for f in Index.loads(store.get(gone)).folders:
                store.delete(f, True)
            store.delete(gone)
    return index


def _seal(spark: SparkSession, key: bytes, password: str | None, recipient: bytes | None) -> bytes:
    return crypto.encrypt_password(spark, key, password) if password is not None else crypto.encrypt_recipient(spark, key, recipient)


# ------------------------------------------------------------------ reading
class Chunked:
    """A chunked container, opened without reading its chunks."""

    def __init__(self, spark: SparkSession, path: str, password: str | None = None, private: bytes | None = None, version: int | None = None):
        self.spark, self.path, self.store = spark, path, _store(spark, path)
        if version is None:
            self.index, data = newest(self.store, path)
        else:
            data = self.store.get(f"index-{version:08d}")
            self.index = Index.loads(data)
        self.keys: dict[int, bytes] = {}
        if self.index.sealing:
            if (password if self.index.sealing == "password" else private) is None:
                raise InvalidConfig("the container is encrypted: the password or key is needed")
            unseal = (lambda k: crypto.decrypt_password(spark, k, password)) if self.index.sealing == "password" else (lambda k: crypto.decrypt_recipient(spark, k, private))
            self.keys = {i: unseal(k) for i, k in enumerate(self.index.keys)}
            if not self.index.authentic(data, self.keys[len(self.keys) - 1]):
                raise DecryptionFailed("the index was changed")
        self.chunks, self.num_rows, self.schema = self.index.chunks, self.index.num_rows, self.index.schema
        self.find = self.index.find

    def _files(self, run: int, columns: Sequence[int]) -> DataFrame:
        return self.spark.read.schema(_chunk_schema(columns)).parquet(f"{self.store.root}/{self.index.folders[run]}")

    def _bodies(self, chunks: list[Chunk], columns: Sequence[int]) -> DataFrame:
        """The chunks asked for: whole stretches of (part, seq) of each run, as filters that reach the files."""
        out = None
        for run in sorted({c.run for c in chunks}):
            own = [c for c in chunks if c.run == run]
            a, b = own[0], own[-1]
            found = self._files(run, columns).filter(F.col("part").between(a.part, b.part))
            found = found.filter(((F.col("part") > a.part) | (F.col("seq") >= a.seq)) & ((F.col("part") < b.part) | (F.col("seq") <= b.seq)))
            out = found if out is None else out.unionByName(found)
        if self.keys:
            out = _keyed(out, self.keys).select("run", "part", "seq", "n", *(F.aes_decrypt(f"c{i}", "key", F.lit("GCM"), F.lit("DEFAULT"), _place(self.index.container, i)).alias(f"c{i}") for i in columns))
        return out

    def _read(self, start: int, stop: int, columns: Sequence[str] | None) -> DataFrame:
        names = self.schema.names if columns is None else list(columns)
        empty = self.spark.createDataFrame([], from_arrow_schema(self.schema))
        need(empty, *names)
        chunks = self.index.between(max(0, start), min(stop, self.num_rows))
        if not chunks:
            return empty.select(*names)
        schema = pa.schema([self.schema.field(n) for n in names])
        trims = {(c.run, c.part, c.seq): (max(0, start - c.row_offset), min(c.num_rows, stop - c.row_offset)) for c in (chunks[0], chunks[-1])}
        bodies = self._bodies(chunks, [self.schema.names.index(n) for n in names])
        return bodies.mapInArrow(_rows(self.index.compression, schema, trims), from_arrow_schema(schema))

    def rows(self, columns: Sequence[str] | None = None) -> DataFrame:
        return self._read(0, self.num_rows, columns)

    def get_chunk(self, i: int, columns: Sequence[str] | None = None) -> DataFrame:
        c = self.chunks[i]
        return self._read(c.row_offset, c.row_offset + c.num_rows, columns)

    def get_rows(self, start: int, count: int, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows of a range; only chunks that overlap it are read."""
        return self._read(start, start + count, columns)

    def verify(self) -> None:
        """Raise unless the files hold exactly the chunks of the index."""
        for run in range(len(self.index.folders)):
            want = {(c.part, c.seq): c.num_rows for c in self.chunks if c.run == run}
            found = {(r.part, r.seq): r.n for r in self._files(run, []).collect()}  # a few numbers a chunk
            if found != want:
                raise ChecksumMismatch(f"run {run} has {len(found)} chunks, or others than the {len(want)} of its index")


# ------------------------------------------------------------------ as a format
@dataclass
class ChunkPartition(InputPartition):
    file: str
    seq: int
    row_offset: int
    low: int
    high: int


class ChunkReader(DataSourceReader):
    """One input partition a chunk. Filters on the row number choose chunks in planning, and are applied there and in the task."""

    def __init__(self, uri: str, index: Index, schema: T.StructType):
        self.uri, self.index, self.names = uri, index, schema.names
        self.low, self.high, self.wanted = 0, index.num_rows, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != (ROW,) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)):
                yield f
            elif isinstance(f, In):
                self.wanted = set(f.value) if self.wanted is None else self.wanted & set(f.value)
                yield f
            else:
                at = f.value
                low = {EqualTo: at, GreaterThan: at + 1, GreaterThanOrEqual: at}.get(type(f), 0)
                high = {EqualTo: at + 1, LessThan: at, LessThanOrEqual: at + 1}.get(type(f), self.index.num_rows)
                self.low, self.high = max(self.low, low), min(self.high, high)

    def partitions(self) -> list[ChunkPartition]:
        chunks = self.index.between(self.low, self.high) if self.low < self.high else []
        if self.wanted is not None:
            at = {self.index.find(int(r)) for r in self.wanted if r is not None}
            chunks = [c for c in chunks if self.index.find(c.row_offset) in at]
        system, root = fs.FileSystem.from_uri(self.uri)
        files = {}
        for run in {c.run for c in chunks}:
            for f in system.get_file_info(fs.FileSelector(f"{root}/{self.index.folders[run]}")):
                if m := re.match(r"part-(\d+)-.*\.parquet$", f.base_name):
                    files[run, int(m[1])] = f.path
        return [ChunkPartition(files[c.run, c.part], c.seq, c.row_offset, max(0, self.low - c.row_offset), min(c.num_rows, self.high - c.row_offset)) for c in chunks]

    def read(self, partition: ChunkPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for if there are no partitions
            return
        system, _ = fs.FileSystem.from_uri(self.uri)
        names = [n for n in self.names if n != ROW]
        columns = [f"c{self.index.schema.names.index(n)}" for n in names]
        with pq.ParquetFile(partition.file, filesystem=system) as file:
            at, group = partition.seq, 0
            while at >= (size := file.metadata.row_group(group).num_rows):
                at, group = at - size, group + 1
            row = file.read_row_group(group, columns=["seq", *columns]).slice(at, 1)
        if row.column("seq")[0].as_py() != partition.seq:
            raise ChecksumMismatch(f"{partition.file} has no chunk {partition.seq} at its place")
        n = partition.high - partition.low
        held = {c: open_body(row.column(f"c{self.index.schema.names.index(c)}")[0].as_py(), self.index.compression).slice(partition.low, n) for c in names}
        start = partition.row_offset + partition.low
        held[ROW] = pa.chunked_array([pa.array(range(start, start + n), pa.int64())])
        yield from pa.table([held[c] for c in self.names], self.names).to_batches()


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _index(self) -> Index:
        system, root = fs.FileSystem.from_uri(self.options["uri"])
        found = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if _INDEX.fullmatch(f.base_name))
        if not found:
            raise EmptyDataset(f"no chunked container at {self.options['uri']}")
        with system.open_input_stream(found[-1]) as f:
            index = Index.loads(f.read())
        if index.sealing:
            raise InvalidConfig("encrypted containers are read by Chunked")
        return index

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(ROW, T.LongType()), *from_arrow_schema(self._index().schema)])

    def reader(self, schema: T.StructType) -> ChunkReader:
        return ChunkReader(self.options["uri"], self._index(), schema)


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A container by spark.read, with the number of each row as _row. columns: those to fetch."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkSource)
    reader = spark.read.format(FORMAT).option("uri", arrow_uri(spark, path))
    if columns is not None:
        schema = T.StructType([T.StructField(ROW, T.LongType()), *from_arrow_schema(Chunked(spark, path).schema)])
        need(spark.createDataFrame([], schema), *columns)
        reader = reader.schema(T.StructType([schema[c] for c in columns]))
    return reader.load()


class ChunkBatches:
    """A container as a source of batches, one partition a chunk: what batches.register makes a format, or a stream that new chunks join."""

    def __init__(self, spark: SparkSession, path: str):
        self.uri = arrow_uri(spark, path)
        self.schema = from_arrow_schema(ChunkSource({"uri": self.uri})._index().schema)

    def _reader(self) -> ChunkReader:
        return ChunkReader(self.uri, ChunkSource({"uri": self.uri})._index(), self.schema)

    def partitions(self) -> int:
        return len(self._reader().index.chunks)

    def batches(self, partition: int) -> Iterator[pa.RecordBatch]:
        reader = self._reader()
        chunk = reader.index.chunks[partition]
        reader.low, reader.high = chunk.row_offset, chunk.row_offset + chunk.num_rows
        yield from reader.read(reader.partitions()[0])
