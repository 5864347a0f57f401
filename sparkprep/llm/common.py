"""Shared folders, Arrow text buffers and vectorised word hashing.

Text is handled as the UTF-8 buffer of an Arrow column, so that words, lines and shingles of a
whole batch are found by a handful of numpy calls. Work is cut into slices of a few MB of text.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
PIECE = 2 << 20
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one for local runs."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """The number of tables written so far; two marks enclose what was written between them."""
    return len(_made)


def discard(since: int, until: int) -> None:
    """Delete the scratch tables between two marks; whatever was computed from them has been written."""
    for spark, path in _made[since:until]:
        delete_path(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ------------------------------------------------------------------ text buffers
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_pow = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64), _BASE, np.uint64))])
    return _pow


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most that many bytes of text, or single rows."""
    _, off = utf8(batch.column(text))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, words per row) of the maximal runs outside 0x20 and 0x09-0x0D."""
    if lower:
        data = _LOWER[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return data, empty, empty, np.zeros(len(off) - 1, np.int64)
    dark = ~_SPACE[data]
    first, last = dark.copy(), dark.copy()
    first[1:] &= ~dark[:-1]
    last[:-1] &= ~dark[1:]
    edge = off[:-1][off[:-1] < len(data)]
    first[edge] = dark[edge]
    edge = off[1:][off[1:] > 0] - 1
    last[edge] = dark[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, starts, ends, np.diff(np.searchsorted(starts, off))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans ascend and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        if ends[i] - starts[i] > PIECE:  # one long span, piece by piece: its polynomial is a sum
            total, factor, n_bytes = 0, 1, int(ends[i] - starts[i])
            for at in range(int(starts[i]), int(ends[i]), PIECE):
                part = data[at : min(at + PIECE, int(ends[i]))]
                with np.errstate(over="ignore"):
                    total += int((_BYTE[part] * _powers(PIECE)[: len(part)]).sum(dtype=np.uint64)) * factor
                factor = factor * pow(int(_BASE), PIECE, 1 << 64) % (1 << 64)
            out[i] = mix(np.array([(total + n_bytes * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0]
            i += 1
            continue
        s, size = starts[i:j], ends[i:j] - starts[i:j]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        total = int(size.sum())
        at = np.arange(total) - np.repeat(begin, size)
        with np.errstate(over="ignore"):
            value = _BYTE[data[np.repeat(s, size) + at]] * _powers(int(size.max(initial=0)))[at]
            some = size > 0
            sums = np.zeros(j - i, np.uint64)
            if total:
                sums[some] = np.add.reduceat(value, begin[some])
            out[i:j] = mix(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def shingle_hashes(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, shingles per row): k words in a row; of fewer words the whole sequence is one."""
    n = len(h)
    begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    with np.errstate(over="ignore"):
        acc = np.zeros(n, np.uint64)
        for i in range(k):
            if n > i:
                acc[: n - i] = (acc[: n - i] ^ h[i:]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(i + 1)
                if i:
                    acc[n - i :] = 0
        acc = mix(acc)
        each = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
        keep = np.zeros(n, bool)
        full = np.flatnonzero(counts >= k)
        at = np.repeat(begin[full] - np.concatenate([[0], np.cumsum(each[full])[:-1]]), each[full]) + np.arange(int(each[full].sum()))
        keep[at] = True
        for r in np.flatnonzero((counts > 0) & (counts < k)):
            x = np.uint64(0)
            for y in h[begin[r] : begin[r + 1]]:
                x = (x ^ y) * np.uint64(0xA24BAED4963EE407) + np.uint64(7)
            acc[begin[r]] = mix(np.array([x + counts[r].astype(np.uint64)], np.uint64))[0]
            keep[begin[r]] = True
    return acc[keep], each


def hadoop_safe(name: str) -> str:
    return re.sub(r"[^\w.-]", "_", name)
