"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Its size follows the document's, and the
share of one sketch found in another estimates containment even between very unequal documents. If no hash is below the
fraction, the smallest one stands in, so that no text with words has an empty sketch; as it is not below the fraction, merge()
can tell it and drops it as soon as there is a hash that is, so the merged sketches of documents are the sketch of their
union, always. Containment of a stand-in in a sketch that does not have it can't be told, and is not a number.

A fingerprint is the sorted hashes, 32 bits each, as hex. Shingles are runs of five words after A-Z are
lower-cased; a text of fewer words is one shingle.

Defined cases: a null text is empty; a text without words has the empty fingerprint, which is alike 1 to
another empty one and 0 to any other; equal texts have equal fingerprints; rows that repeat an id, and rows of null id (they
come last), are ordered by their texts, and each is compared with the next; a single row is its own next; an empty table
gives no rows; other columns are ignored (names that begin with ``__sp_`` are reserved).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.common import SLICE_BYTES, hash_spans, partitions, shingle_hashes, slices, table, utf8, words

SHINGLE = 5
FRACTION = 0.25
SEGMENTS = 4


def sketches(texts: pa.Array, k: int = SHINGLE, fraction: float = FRACTION) -> list[np.ndarray]:
    """The sorted 32-bit sketch of each text."""
    out = []
    limit = np.uint64(int(fraction * (1 << 32)))
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        data, starts, ends, counts = words(*utf8(part.column("text")))
        h, each = shingle_hashes(hash_spans(data, starts, ends), counts, k)
        h >>= np.uint64(32)
        stop = np.cumsum(each)
        for a, b in zip(stop - each, stop, strict=True):
            own = h[a:b]
            low = own[own < limit]
            if not len(low) and b > a:
                low = own.min(keepdims=True)
            out.append(np.unique(low).astype(np.uint32))
    return out


def text_of(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def merge(*parts: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of documents taken together."""
    every = np.unique(np.concatenate(parts))
    low = every[every < int(fraction * (1 << 32))]
    return low if len(low) else every[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """The estimated share of a's shingles that b has; nan if a has a stand-in only and b does not have it."""
    if not len(a):
        return 1.0
    share = len(np.intersect1d(a, b, assume_unique=True)) / len(a)
    return float("nan") if not share and len(b) and a[0] >= int(fraction * (1 << 32)) else share


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """(key, fingerprint) of every row."""
    schema = T.StructType([docs.schema[key], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(map(text_of, sketches(batch.column(text), k, fraction)), pa.string())], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def edited(text: str, other: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of the other text."""
    third = len(text) // 3
    return text[: len(text) - third] + other[:third]


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """Compare every document with its edited text and with the next document in descending key order.

    The order is cut into segments at quantiles of the key. One small pass over keys finds the first key
    of each segment; that document is also sent to the segment before (the first of all to the last), so
    whole texts are shuffled once. Equal keys are ordered by text; null keys stand last, in one segment.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    parts = SEGMENTS * n  # several small segments per task even out what hashing deals unevenly
    steps = [i / parts for i in range(1, parts)]
    cuts = []
    if steps:
        cuts = docs.agg(F.percentile_approx(F.col(key), F.array(*map(F.lit, steps)), F.lit(max(10000, 20 * parts)))).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # Segment i holds the keys in (cuts[i], cuts[i - 1]]; nulls are last.
    # The number of cuts that are not below the key, by binary search.
    bounds, jumps = F.lit(cuts), [1 << b for b in reversed(range(len(cuts).bit_length()))]
    step = lambda at, jump: F.when((at + jump <= len(cuts)) & (F.get(bounds, at + jump - 1) >= F.col(key)), at + jump).otherwise(at)
    found = F.aggregate(F.lit(jumps), F.lit(0), step) if cuts else F.lit(0)
    segment = F.when(F.col(key).isNull(), F.lit(len(cuts) + 1)).otherwise(found)
    placed = docs.select(F.col(key), F.col(text), segment.alias("__sp_segment"))
    heads = sorted(placed.groupBy("__sp_segment").agg(F.max(key).alias("head")).collect(), key=lambda r: r[0])  # one row a segment
    to = [(heads[i]["head"], heads[i - 1]["__sp_segment"]) for i in range(len(heads))]
    kind = docs.schema[key].dataType
    moves = spark.createDataFrame(to, T.StructType([T.StructField("__sp_head", kind), T.StructField("__sp_to", T.IntegerType())]))
    extra = placed.join(F.broadcast(moves), F.col(key).eqNullSafe(F.col("__sp_head"))).select(key, text, F.col("__sp_to").alias("__sp_segment"), F.lit(True).alias("__sp_extra"))
    both = placed.withColumn("__sp_extra", F.lit(False)).unionByName(extra)
    both = both.repartition(n, "__sp_segment").sortWithinPartitions("__sp_segment", "__sp_extra", F.desc_nulls_last(key), text)
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])
    key_type = docs.select(key).limit(0).toArrow().schema.field(0).type

    def compare(keys: list, texts: list[str]) -> pa.RecordBatch:
        """All but the last of the texts, each with the next."""
        after = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own = sketches(pa.array(texts, pa.large_string()), k, fraction)
        other = sketches(pa.array(after, pa.large_string()), k, fraction)
        m = len(after)
        columns = [pa.array(keys[:m], key_type), pa.array([len(t) for t in texts[:m]], pa.int64())]
        columns += [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in after]), pa.array([text_of(s) for s in own[:m]]), pa.array([text_of(s) for s in other])]
        columns += [pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, texts, size, closed = None, [], [], 0, False
        for batch in batches:
            for part in slices(batch, text):
                for x, t, s, more in zip(*(part.column(c).to_pylist() for c in (key, text, "__sp_segment", "__sp_extra")), strict=True):
                    if s != now:
                        if len(texts) > 1:
                            yield compare(keys, texts)
                        now, keys, texts, size, closed = s, [], [], 0, False
                    if closed:  # further rows of the key that heads the next segment
                        continue
                    closed = more
                    keys.append(x)
                    texts.append(t or "")
                    size += len(texts[-1])
                    if size >= SLICE_BYTES and len(texts) > 1:
                        yield compare(keys, texts)
                        keys, texts, size = keys[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield compare(keys, texts)

    return both.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
