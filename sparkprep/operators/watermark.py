"""Watermarks in the lowest bits of floating-point columns: embedding, extraction, and signs of foreign ones."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.core import Order, materialize, need, with_row_id
from sparkprep.errors import InvalidConfig

BITS = 256
LAG = 256
# Where autocorrelation starts to count, and the least confidence of an extraction.
AUTOCORRELATION_LIMIT, CONFIDENCE_LIMIT = 0.7, 0.80


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def pattern(buyer: bytes, seller: bytes) -> np.ndarray:
    """The 256 bits of buyer XOR seller, most significant first."""
    if len(buyer) != 32 or len(seller) != 32:
        raise InvalidConfig("hashes and keys have 32 bytes")
    return np.unpackbits(np.frombuffer(buyer, np.uint8) ^ np.frombuffer(seller, np.uint8))


def embed(df: DataFrame, buyer: bytes, seller: bytes, columns: Sequence[str], order_by: Order | Sequence[Order]) -> DataFrame:
    """Put the pattern, cyclically by row, into the lowest bit of float columns; nulls stay null."""
    need(df, *columns)
    bits, names = pattern(buyer, seller), df.columns
    rows = with_row_id(df, order_by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = bits[batch.column("_row_id").to_numpy() % BITS]
            out = []
            for name in names:
                c = batch.column(name)
                if name in columns:
                    wide = np.uint32 if pa.types.is_float32(c.type) else np.uint64
                    raw = c.to_numpy(zero_copy_only=False).copy()
                    view = raw.view(wide)
                    view[:] = (view & ~wide(1)) | want.astype(wide)  # NaN stays NaN: only its payload changes
                    c = pa.array(raw, c.type, mask=c.is_null().to_numpy(zero_copy_only=False))
                out.append(c)
            yield pa.RecordBatch.from_arrays(out, names)

    return rows.mapInArrow(run, df.schema)


def low_bits(df: DataFrame, order_by: Order | Sequence[Order], columns: Sequence[str] | None = None) -> DataFrame:
    """(column, row, bit) of the values that are not null; rows are numbered within all rows."""
    names = list(columns) if columns is not None else float_columns(df)
    need(df, *names)
    rows = with_row_id(df.select("*"), order_by).select("_row_id", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_row_id")
            for name in names:
                c = batch.column(name)
                good = c.is_valid()
                v = c.filter(good).to_numpy(zero_copy_only=False)
                bit = v.view(np.uint32 if v.dtype == np.float32 else np.uint64) & (np.uint32(1) if v.dtype == np.float32 else np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), ids.filter(good), pa.array(bit.astype(np.int32))], ["column", "row", "bit"])

    return rows.mapInArrow(run, "column string, row long, bit int")


def analyze(df: DataFrame, order_by: Order | Sequence[Order]) -> DataFrame:
    """Per float column: lsb_entropy, chi_square_pvalue, ks_pvalue, autocorrelation_256, anomalous.

    The lag is an equi-join of a row with the row 256 before; a column without nulls is numbered as its values are."""
    bits = materialize(low_bits(df, order_by))
    stats = bits.groupBy("column").agg(F.count("*").alias("n"), F.sum("bit").alias("ones"))
    p = F.col("ones") / F.col("n")
    part = lambda x: F.when(x > 0, -x * F.log2(F.when(x > 0, x))).otherwise(0.0)
    half = F.col("n") / 2
    chi = F.pow(F.col("ones") - half, F.lit(2)) / half * 2
    before = bits.select(F.col("column").alias("_c"), (F.col("row") + LAG).alias("_r"), F.col("bit").alias("_b"))
    value = lambda b: 2 * F.col(b) - 1 - (2 * F.col("ones") / F.col("n") - 1)
    pairs = bits.join(before, (F.col("column") == F.col("_c")) & (F.col("row") == F.col("_r"))).select("column", "bit", "_b").join(F.broadcast(stats), "column")
    lagged = pairs.groupBy("column").agg((F.sum(value("bit") * value("_b")) / F.count("*")).alias("_cov"))
    mean = 2 * p - 1
    variance = 1 - mean * mean
    rows = stats.join(lagged, "column", "left")
    auto = F.when((F.col("n") < 2 * LAG) | (variance < 1e-10), 0.0).otherwise(F.least(F.greatest(F.coalesce(F.col("_cov"), F.lit(0.0)) / F.when(variance >= 1e-10, variance), F.lit(-1.0)), F.lit(1.0)))
    ks = F.abs(p - 0.5) * F.sqrt(F.col("n").cast("double"))
    rows = rows.select("column", "n", (part(p) + part(1 - p)).alias("lsb_entropy"), F.exp(-chi / 2).alias("chi_square_pvalue"), F.exp(-2 * ks * ks).alias("ks_pvalue"), auto.alias("autocorrelation_256"))
    return rows.withColumn("anomalous", F.col("autocorrelation_256") > AUTOCORRELATION_LIMIT)


def confidence(autocorrelation: float) -> float:
    # The steps from autocorrelation to confidence.
    if autocorrelation > 0.9:
        out = 0.99
    elif autocorrelation > AUTOCORRELATION_LIMIT:
        out = 0.80 + 0.6 * (autocorrelation - AUTOCORRELATION_LIMIT)
    elif autocorrelation > 0.3:
        out = 0.50 + 0.5 * autocorrelation
    else:
        out = autocorrelation
    return min(1.0, max(0.0, out))


def detect(df: DataFrame, order_by: Order | Sequence[Order]) -> dict:
    """Overall entropy, autocorrelation, confidence and the columns that look marked."""
    rows = analyze(df, order_by).collect()  # one row per column
    if not rows:
        return {"overall_lsb_entropy": 1.0, "overall_autocorrelation": 0.0, "confidence": 0.0, "anomalous_columns": [], "columns": []}
    auto = sum(r.autocorrelation_256 for r in rows) / len(rows)
    return {"overall_lsb_entropy": sum(r.lsb_entropy for r in rows) / len(rows), "overall_autocorrelation": auto, "confidence": confidence(auto), "anomalous_columns": sorted(r.column for r in rows if r.anomalous), "columns": [r.asDict() for r in rows]}


def extract(df: DataFrame, seller: bytes, order_by: Order | Sequence[Order], columns: Sequence[str] | None = None) -> tuple[bytes, float] | None:
    """(buyer hash, confidence) by majority over the 256 places, if the bits agree well enough; 256 bits are needed at least."""
    votes = low_bits(df, order_by, columns).groupBy((F.col("row") % BITS).alias("place")).agg(F.sum("bit").alias("ones"), F.count("*").alias("n")).collect()
    total = sum(r.n for r in votes)
    if total < BITS or len(votes) < BITS:
        return None
    bits = np.zeros(BITS, np.uint8)
    agree = 0
    for r in votes:
        bits[r.place] = 2 * r.ones > r.n
        agree += max(r.ones, r.n - r.ones)
    sure = agree / total
    if sure < CONFIDENCE_LIMIT:
        return None
    return bytes(np.packbits(bits) ^ np.frombuffer(seller, np.uint8)), sure


def verify(df: DataFrame, buyer: bytes, seller: bytes, order_by: Order | Sequence[Order], columns: Sequence[str] | None = None) -> bool:
    found = extract(df, seller, order_by, columns)
    return found is not None and found[0] == buyer


def evidence(df: DataFrame, buyer: bytes, order_by: Order | Sequence[Order]) -> dict:
    """What was found, with a hash of the contents that does not depend on the order of rows."""
    found = detect(df, order_by)
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    sums = df.agg(F.count("*"), *[F.sum(F.conv(F.substring(F.sha2(text, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]).first()
    return {"dataset_hash": hashlib.sha256(repr(tuple(sums)).encode()).hexdigest(), "buyer_hash": buyer.hex(), "confidence": found["confidence"], "analyzed_at": int(time.time()), "columns": found["columns"]}
