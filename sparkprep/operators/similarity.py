"""Contamination of a table of texts by reference texts, as an equi-join on character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.core import materialize, need


def char_grams(text: str | None, n: int) -> set[str]:
    """The distinct n-grams of the lower-cased text without white space; a shorter text has none."""
    bare = "".join((text or "").split()).lower()
    return {bare[i : i + n] for i in range(len(bare) - n + 1)}


def overlap(candidate: str | None, reference: str | None, n: int) -> float:
    """The share of the candidate's n-grams that the reference has."""
    own = char_grams(candidate, n)
    return len(own & char_grams(reference, n)) / len(own) if own else 0.0


def _hashes(text: str | None, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of code points, in their order, repeated ones too."""
    bare = "".join((text or "").split()).lower()
    points = np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(points) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h ^= points[i : len(points) - n + 1 + i]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


#: Words of 64 bits of the filter of a reference: so many at most, whatever the size of the reference, and BITS bits an n-gram below that.
WORDS, BITS = 1 << 22, 32


def gram_filter(found: DataFrame, gram: str = "gram", words: int | None = None) -> np.ndarray:
    """A Bloom filter of hashed n-grams: executors set two bits of one word for each, and what is brought here and sent to all tasks is at
    most WORDS numbers."""
    n = found.count()
    words = words or min(WORDS, max(64, 1 << (n * BITS // 64).bit_length()))
    h = F.col(gram)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))
    word = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1))
    both = bit(h.bitwiseAND(F.lit(63))).bitwiseOR(bit(F.shiftrightunsigned(h, 58)))
    filled = found.groupBy(word.alias("word")).agg(F.bit_or(both).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return out


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash."""
    word = bits[((h >> np.uint64(6)) & np.uint64(len(bits) - 1)).astype(np.int64)]
    return ((word >> (h & np.uint64(63))) & (word >> (h >> np.uint64(58))) & np.uint64(1)).astype(bool)


def grams(df: DataFrame, key: str, text: str, n: int, among: np.ndarray | None = None) -> DataFrame:
    """(key, row, gram, total): a row for each distinct n-gram, hashed, of each row of df; total is their number in the text.

    among: a filter; n-grams that it doesn't hold are left out (total still counts them), and texts without any that it may hold
    are passed over before their n-grams are sorted."""
    need(df, key, text)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("row", "gram", "total"))])
    sent = None if among is None else df.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sent is None else sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                at, gram, total = [], [np.zeros(0, np.uint64)], []
                for i, x in enumerate(part.column("_text").to_pylist()):
                    h = _hashes(x, n)
                    if not len(h) or (bits is not None and not may_hold(bits, h).any()):
                        continue
                    h = np.unique(h)
                    own = h if bits is None else h[may_hold(bits, h)]
                    at.append(np.full(len(own), i))
                    total.append(np.full(len(own), len(h)))
                    gram.append(own)
                if at:
                    place = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays([part.column("_key").take(place), part.column("_row").take(place), pa.array(np.concatenate(gram).view(np.int64)), pa.array(np.concatenate(total))], schema.names)

    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row")).mapInArrow(run, schema)


def contamination(train: DataFrame, reference: DataFrame, key: str, ref_key: str, text: str = "text", ref_text: str = "text", n: int = 10) -> DataFrame:
    """(key, ref_key, overlap): for each key that shares any n-gram, the reference with the largest share; ties to the smaller key.

    A Bloom filter of the reference's n-grams, of bounded size, passes over those of the texts where these are read, so that little more than shared
    ones are joined; the join removes what it passes wrongly. Rows that repeat a key are compared each on their own, and so are those of the reference."""
    other = materialize(grams(reference, ref_key, ref_text, n).select(F.col(ref_key).alias("_ref"), F.col("row").alias("_other"), F.col("gram").alias("_gram")))
    own = grams(train, key, text, n, among=gram_filter(other, "_gram"))
    shared = own.join(other, F.col("gram") == F.col("_gram")).groupBy(key, "row", "_ref", "_other", "total").agg(F.count("*").alias("_n"))
    # Of equal shares the smaller reference key: the maximum of (share, -rank) as a minimum of (-share, key).
    best = shared.groupBy(key).agg(F.min(F.struct((-F.col("_n") / F.col("total")).alias("s"), F.col("_ref").alias("r"))).alias("b"))
    return best.select(key, F.col("b.r").alias(ref_key), (-F.col("b.s")).alias("overlap"))


def decontaminate(train: DataFrame, reference: DataFrame, key: str, ref_key: str, threshold: float = 0.5, **kwargs) -> DataFrame:
    """The rows of train whose best overlap is not above the threshold."""
    flagged = contamination(train, reference, key, ref_key, **kwargs).filter(F.col("overlap") > threshold).select(key)
    return train.join(flagged, key, "left_anti")
