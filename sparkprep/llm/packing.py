"""Packing by concatenating and cutting.

Pass one tokenizes each partition's documents and notes, per document, the tokens before it in its
partition; the result is written once, so partitions are fixed from there on. The partitions' token
totals (one number each) are summed into global offsets. Pass two cuts the stream of all tokens into
windows of fixed width: a document yields one record per window it touches, and the records at both
ends of a partition share their sequence with the neighbouring partitions. Only the last sequence of
all has padding.

Defined cases: a null or empty text is the end token alone; texts of any length are cut into as many
pieces as they need; repeated ids and rows are packed each on their own; an empty table gives no rows; null ids are kept; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.common import materialize, slices, table

#: Beyond these code points the two tokenizer libraries may follow different Unicode tables.
_WIDE = re.compile("[^\u0000-ɏ‐-‧]")
_SPECIAL = "<|endoftext|>"
_loaded: dict[str, tuple] = {}


def encoder(vocabulary: str):
    """Texts to ids of the byte-level BPE in a tokenizers file.

    The same merges are run by the faster of two libraries where both surely agree: tiktoken, fed with the
    ranks read from the file's own vocabulary, for texts of Latin script; tokenizers itself for all others.
    """
    if vocabulary not in _loaded:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(vocabulary)
        to_byte = {}
        free = 0
        for b in range(256):  # the printable alphabet of byte-level BPE
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                to_byte[chr(b)] = b
            else:
                to_byte[chr(256 + free)] = b
                free += 1
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in slow.get_vocab(with_added_tokens=False).items() if piece != _SPECIAL}
        _loaded[vocabulary] = slow, tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow, fast = _loaded[vocabulary]

    def encode(text: str) -> np.ndarray:
        if _SPECIAL in text or (not text.isascii() and _WIDE.search(text)):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.int64)
        return fast.encode_to_numpy(text).astype(np.int64)

    return encode


def tokenize(docs: DataFrame, vocabulary: str, end_id: int, key: str, text: str) -> DataFrame:
    """Per document: key, part, before (tokens ahead of it in its partition), n and ids (little-endian 32-bit)."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, text):
                ids, n = [], []
                for x in batch.column(text).to_pylist():
                    got = np.append(encode(x or ""), end_id).astype("<u4")
                    ids.append(got.tobytes())
                    n.append(len(got))
                ahead = before + np.cumsum([0, *n])
                before = int(ahead[-1])
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([part] * len(n), pa.int32()), pa.array(ahead[:-1]), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, width: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (binary)."""
    spark = docs.sparkSession
    tokens = materialize(tokenize(docs, vocabulary, end_id, key, text), "pack")
    totals = sorted((r.part, r.total) for r in tokens.groupBy("part").agg(F.max(F.col("before") + F.col("n")).alias("total")).collect())
    offsets, at = [], 0
    for part, total in totals:  # one number per partition
        offsets.append((part, at))
        at += total
    sent = spark.sparkContext.broadcast(dict(offsets))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = sent.value
        for batch in batches:
            keys, which = batch.column(key), []
            out: list[list] = [[] for _ in range(7)]
            rows = zip(*(batch.column(c).to_pylist() for c in ("part", "before", "n")), strict=True)
            for i, (part, before, n) in enumerate(rows):
                ids, begin, start = batch.column("ids")[i].as_py(), base[part] + before, 0
                while start < n:
                    sequence, offset = divmod(begin + start, width)
                    length = min(width - offset, n - start)
                    piece = ids[4 * start : 4 * (start + length)]
                    for column, x in zip(out, (start, length, zlib.crc32(piece), n, sequence, offset, piece), strict=True):
                        column.append(x)
                    which.append(i)
                    start += length
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())], schema.names)

    return tokens.mapInArrow(cut, schema)


def padded_length(tokens: int, width: int = 1024) -> int:
    """What a sequence takes in a batch: the width, or its own length at a power of two."""
    return tokens if tokens & (tokens - 1) == 0 else width


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
