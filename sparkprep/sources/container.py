"""A single-file container: header, metadata, schema, Arrow payload, and optional signature and license.

Layout: 32-byte header | metadata (JSON) | schema (IPC) | encryption mode (1 byte, if encrypted) | payload |
signature (96 bytes) | license | CRC-32 of all before. All integers are little-endian. One container is one file for a
table that fits on the driver; larger ones are folders of chunks (``chunks``).
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from enum import IntEnum

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.errors import ChecksumMismatch, EmptyDataset, FormatError, InvalidConfig, LicenseExpired
from sparkprep.sources import crypto

MAGIC, VERSION, HEADER = b"SPDF", (1, 2), struct.Struct("<4sBBHIIIBBHQ")
ENCRYPTED, SIGNED, LICENSED = 1, 2, 8

# Tags of what a container holds.
DatasetType = IntEnum("DatasetType", {"TABULAR": 0x01, "TIME_SERIES": 0x02, "GRAPH": 0x03, "SPATIAL": 0x04, "TEXT_CORPUS": 0x10, "TEXT_CLASSIFICATION": 0x11, "TEXT_PAIRS": 0x12, "SEQUENCE_LABELING": 0x13, "QUESTION_ANSWERING": 0x14, "SUMMARIZATION": 0x15, "TRANSLATION": 0x16, "IMAGE_CLASSIFICATION": 0x20, "OBJECT_DETECTION": 0x21, "SEGMENTATION": 0x22, "IMAGE_PAIRS": 0x23, "VIDEO": 0x24, "AUDIO_CLASSIFICATION": 0x30, "SPEECH_RECOGNITION": 0x31, "SPEAKER_IDENTIFICATION": 0x32, "USER_ITEM_RATINGS": 0x40, "IMPLICIT_FEEDBACK": 0x41, "SEQUENTIAL_RECS": 0x42, "IMAGE_TEXT": 0x50, "AUDIO_TEXT": 0x51, "VIDEO_TEXT": 0x52, "CUSTOM": 0xFF})
Compression = IntEnum("Compression", {"NONE": 0, "ZSTD_3": 1, "ZSTD_19": 2, "LZ4": 3})


@dataclass
class Metadata:
    name: str | None = None
    version: str | None = None
    license: str | None = None
    tags: list[str] = field(default_factory=list)
    description: str | None = None
    citation: str | None = None
    sha256: str | None = None


@dataclass(frozen=True)
class License:
    """71 fixed bytes, the length of the terms, and the terms."""

    license_id: bytes
    licensee_hash: bytes
    issued_at: int
    expires_at: int = 0
    flags: int = 0
    seat_limit: int = 0
    query_limit: int = 0
    terms: bytes = b""

    FIXED = struct.Struct("<16s32sQQBHII")

    @classmethod
    def issue(cls, licensee: str, days: int | None = None, now: int | None = None, **terms) -> License:
        at = int(time.time()) if now is None else now
        # Fixed value: flag 2 enforces the end.
        flags = terms.pop("flags", 0) | (2 if days is not None else 0)
        return cls(uuid.uuid4().bytes, hashlib.sha256(licensee.encode()).digest(), at, at + 86400 * days if days is not None else 0, flags, **terms)

    def to_bytes(self) -> bytes:
        return self.FIXED.pack(self.license_id, self.licensee_hash, self.issued_at, self.expires_at, self.flags, self.seat_limit, self.query_limit, len(self.terms)) + self.terms

    @classmethod
    def from_bytes(cls, data: bytes) -> License:
        *fixed, n = cls.FIXED.unpack_from(data)
        return cls(*fixed, terms=data[cls.FIXED.size : cls.FIXED.size + n])

    def verify(self, now: int | None = None) -> None:
        if self.flags & 2 and self.expires_at and (int(time.time()) if now is None else now) > self.expires_at:
            raise LicenseExpired("the license has expired")


def compress(data: bytes, how: Compression) -> bytes:
    if how == Compression.NONE:
        return data
    codec = pa.Codec("lz4") if how == Compression.LZ4 else pa.Codec("zstd", 19 if how == Compression.ZSTD_19 else 3)
    return codec.compress(data, asbytes=True)


def decompress(data: bytes, how: Compression, size: int) -> bytes:
    return data if how == Compression.NONE else pa.Codec("lz4" if how == Compression.LZ4 else "zstd").decompress(data, size, asbytes=True)


def _ipc(schema: pa.Schema, batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _fits(value: int, bits: int, what: str) -> int:
    if value >= 1 << bits:
        raise FormatError(f"{what} is too large for its field")
    return value


def dumps(table: pa.Table, kind: DatasetType = DatasetType.TABULAR, compression: Compression = Compression.ZSTD_3, metadata: Metadata | None = None, spark: SparkSession | None = None, password: str | None = None, recipient: bytes | None = None, signer: crypto.KeyPair | None = None, license: License | None = None) -> bytes:
    """The bytes of a container."""
    if not table.num_columns:
        raise EmptyDataset("a table without columns")
    if (password or recipient or signer) and spark is None:
        raise InvalidConfig("encryption and signing need a session")
    payload, schema = _ipc(table.schema, table.to_batches()), _ipc(table.schema, [])
    meta = json.dumps(asdict(replace(metadata or Metadata(), sha256=hashlib.sha256(payload).hexdigest()))).encode()
    body, mode, flags = compress(payload, compression), b"", 0
    if password is not None:
        body, mode, flags = crypto.encrypt_password(spark, body, password), b"\x00", flags | ENCRYPTED
    elif recipient is not None:
        body, mode, flags = crypto.encrypt_recipient(spark, body, recipient), b"\x01", flags | ENCRYPTED
    flags |= (SIGNED if signer else 0) | (LICENSED if license else 0)
    head = HEADER.pack(MAGIC, *VERSION, kind, _fits(len(meta), 32, "metadata"), _fits(len(body), 32, "payload"), _fits(len(payload), 32, "payload"), compression, flags, _fits(len(schema), 16, "schema"), table.num_rows)
    data = head + meta + schema + mode + body
    if signer:
        data += crypto.sign(spark, data, signer)
    if license:
        data += license.to_bytes()
    return data + struct.pack("<I", zlib.crc32(data))


@dataclass(frozen=True)
class Loaded:
    table: pa.Table
    kind: DatasetType
    metadata: Metadata
    license: License | None
    signer: bytes | None


def loads(data: bytes, spark: SparkSession | None = None, password: str | None = None, private: bytes | None = None, trusted: bytes | None = None, now: int | None = None) -> Loaded:
    """Check and open a container."""
    if len(data) < HEADER.size + 4:
        raise FormatError("too short")
    magic, major, minor, kind, n_meta, n_body, n_plain, how, flags, n_schema, _ = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise FormatError("not a container")
    if major > VERSION[0]:
        raise FormatError(f"version {major}.{minor} is not supported")
    if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ChecksumMismatch("the checksum does not match")
    at = HEADER.size
    meta = Metadata(**json.loads(data[at : at + n_meta]))
    at += n_meta + n_schema
    mode = None
    if flags & ENCRYPTED:
        mode = data[at]
        at += 1
    body, end = data[at : at + n_body], at + n_body
    signer = None
    if flags & SIGNED:
        if spark is None:
            raise InvalidConfig("checking a signature needs a session")
        crypto.verify(spark, data[:end], data[end : end + 96], trusted)
        signer, end = data[end + 64 : end + 96], end + 96
    license = License.from_bytes(data[end:-4]) if flags & LICENSED else None
    if license:
        license.verify(now)
    if mode is not None:
        if (password if mode == 0 else private) is None or spark is None:
            raise InvalidConfig("the container is encrypted: a session and the password or key are needed")
        body = crypto.decrypt_password(spark, body, password) if mode == 0 else crypto.decrypt_recipient(spark, body, private)
    payload = decompress(body, Compression(how), n_plain)
    return Loaded(pa.ipc.open_stream(payload).read_all(), DatasetType(kind), meta, license, signer)


def write_container(df: DataFrame, path: str, **options) -> None:
    """Write a table that fits on the driver as one container."""
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(dumps(df.toArrow(), spark=df.sparkSession, **options))


def read_container(spark: SparkSession, path: str, **options) -> DataFrame:
    """The table of a container: one file, or a folder of chunks."""
    from sparkprep.sources import chunks

    if chunks.versions(chunks._store(spark, path)):
        return chunks.Chunked(spark, path, **options).rows()
    data = spark.read.format("binaryFile").load(path).select("content").first()
    if data is None:
        raise EmptyDataset(f"no container at {path}")
    return spark.createDataFrame(loads(bytes(data.content), spark, **options).table)


_PACKED = "part long, seq long, n long, container binary"


def packed(df: DataFrame, most: int = 65536, kind: DatasetType = DatasetType.TABULAR, compression: Compression = Compression.ZSTD_3) -> DataFrame:
    """(part, seq, n, container): the rows of df as containers of at most so many rows, each made where its rows are."""
    schema = df.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                table = pa.Table.from_batches([batch.slice(at, most)]).cast(schema)
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (part, seq, table.num_rows)), pa.array([dumps(table, kind, compression)], pa.binary())], ["part", "seq", "n", "container"])
                seq += 1

    return df.mapInArrow(run, _PACKED)


def unpacked(containers: DataFrame, schema: T.StructType, column: str = "container") -> DataFrame:
    """The rows of a column of containers, which have that schema; a damaged one raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield from loads(x.as_py()).table.to_batches()

    return containers.select(column).mapInArrow(run, schema)


def intact(containers: DataFrame, column: str = "container") -> DataFrame:
    """containers with intact: whether its checksum and form are those that were written."""

    def check(data: bytes) -> bool:
        try:
            loads(data)
        except (ChecksumMismatch, FormatError):
            return False
        return True

    at, schema = containers.columns.index(column), T.StructType([*containers.schema, T.StructField("intact", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([check(x.as_py()) for x in batch.column(at)], pa.bool_())], schema.names)

    return containers.mapInArrow(run, schema)


def content_hash(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(column), 256))
