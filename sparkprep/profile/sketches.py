"""Mergeable quantile sketches as tables, and drift between them.

A DDSketch is rows (column, sign, bucket, n): counting by logarithmic bucket is exact, associative and done by
partial aggregation. A t-digest is an array of centroids per column, built per partition and merged in a tree
of bounded groups. Sketches are stored as Parquet, or as bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.core import numeric_columns
from sparkprep.errors import InvalidConfig, ParseError


def gamma(alpha: float) -> float:
    alpha = min(0.5, max(0.0001, alpha))
    return (1 + alpha) / (1 - alpha)


def _long(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        raise InvalidConfig("no numeric columns")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in names])
    long = df.select(F.explode(cells).alias("x")).select("x.column", "x.value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))


def ddsketch(df: DataFrame, columns: Sequence[str] | None = None, alpha: float = 0.01) -> DataFrame:
    """(column, sign, bucket, n, min, max, alpha) of finite values."""
    ln = math.log(gamma(alpha))
    v = F.col("value")
    bucket = F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.ln(F.abs(F.when(v != 0, v))) / F.lit(ln))).cast("int")
    rows = _long(df, columns).groupBy("column", F.signum(v).cast("int").alias("sign"), bucket.alias("bucket"))
    return rows.agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max")).withColumn("alpha", F.lit(float(alpha)))


def merge_ddsketches(*sketches: DataFrame) -> DataFrame:
    """Add sketches of one alpha."""
    alphas = {r.alpha for s in sketches for r in s.select("alpha").distinct().limit(2).collect()}
    if len(alphas) > 1:
        raise InvalidConfig("sketches of different accuracy can't be merged")
    both = sketches[0]
    for s in sketches[1:]:
        both = both.unionByName(s)
    return both.groupBy("column", "sign", "bucket").agg(F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"), F.first("alpha").alias("alpha"))


def dd_quantiles(sketch: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(column, q, value): buckets are walked from the most negative up, a few hundred rows per column."""
    value_order = F.col("sign") * F.when(F.col("sign") == 0, 0).otherwise(F.col("bucket") + F.lit(100_000))
    w = Window.partitionBy("column").orderBy(value_order)
    whole = Window.partitionBy("column")
    g = (1 + F.col("alpha")) / (1 - F.col("alpha"))
    point = F.col("sign") * 2 * F.pow(g, F.col("bucket").cast("double")) / (g + 1)
    rows = sketch.withColumn("_upto", F.sum("n").over(w)).withColumn("_total", F.sum("n").over(whole)).withColumn("_lo", F.min("min").over(whole)).withColumn("_hi", F.max("max").over(whole)).withColumn("_point", point)
    rows = rows.withColumn("q", F.explode(F.array(*[F.lit(float(min(1, max(0, q)))) for q in quantiles])))
    rank = F.ceil(F.col("q") * F.col("_total"))
    hit = rows.filter((F.col("_upto") >= rank) & (F.col("_upto") - F.col("n") < F.greatest(rank, F.lit(1))))
    return hit.select("column", "q", F.when(F.col("q") == 0, F.col("_lo")).when(F.col("q") == 1, F.col("_hi")).otherwise(F.col("_point")).alias("value"))


# ------------------------------------------------------------------ t-digest
def compress(means: np.ndarray, weights: np.ndarray, compression: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted centroids whose middles fall into one unit of the scale function."""
    order = np.argsort(means, kind="stable")
    means, weights = means[order], weights[order]
    middle = (np.cumsum(weights) - weights / 2) / weights.sum()
    unit = np.floor(compression / (2 * math.pi) * (np.arcsin(2 * middle - 1) + math.pi / 2))
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    w = np.add.reduceat(weights, first)
    return np.add.reduceat(means * weights, first) / w, w


_DIGEST = "column string, means array<double>, weights array<double>, min double, max double"


def _digest(column: str, parts: list[tuple], compression: float) -> dict:
    m, w = compress(np.concatenate([np.asarray(p[0], float) for p in parts]), np.concatenate([np.asarray(p[1], float) for p in parts]), compression)
    return {"column": column, "means": m.tolist(), "weights": w.tolist(), "min": min(p[2] for p in parts), "max": max(p[3] for p in parts)}


def tdigest(df: DataFrame, columns: Sequence[str] | None = None, compression: float = 100.0) -> DataFrame:
    """(column, means, weights, min, max): a digest per column."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple]] = {}
        for batch in batches:
            for name, x in batch.groupby("column")["value"]:
                v = x.to_numpy()
                parts = held.setdefault(name, [])
                parts.append((v, np.ones(len(v)), v.min(), v.max()))
                d = _digest(name, parts, compression)
                held[name] = [(d["means"], d["weights"], d["min"], d["max"])]
        rows = [{"column": k, "means": list(p[0][0]), "weights": list(p[0][1]), "min": p[0][2], "max": p[0][3]} for k, p in held.items()]
        if rows:
            yield pd.DataFrame(rows)

    return merge_tdigests(_long(df, columns).mapInPandas(local, _DIGEST), compression)


def merge_tdigests(digests: DataFrame, compression: float = 100.0) -> DataFrame:
    """One digest per column, merged in two levels so that no task takes all parts of a large input."""

    def join(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_digest(key[-1], list(x[["means", "weights", "min", "max"]].itertuples(index=False, name=None)), compression)])

    salted = digests.withColumn("_salt", F.pmod(F.xxhash64("means", "min", "max"), F.lit(64)))
    first = salted.groupBy("_salt", "column").applyInPandas(join, _DIGEST)
    return first.groupBy("column").applyInPandas(join, _DIGEST)


def td_quantiles(digests: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(column, q, value), interpolated between the middles of centroids."""
    qs = [min(1.0, max(0.0, q)) for q in quantiles]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                w = np.asarray(r.weights, float)
                at = np.concatenate([[0.0], np.cumsum(w) - w / 2, [w.sum()]]) / w.sum()
                for q, v in zip(qs, np.interp(qs, at, np.concatenate([[r.min], r.means, [r.max]])), strict=True):
                    rows.append((r.column, q, float(v)))
            yield pd.DataFrame(rows, columns=["column", "q", "value"])

    return digests.mapInPandas(run, "column string, q double, value double")


# ------------------------------------------------------------------ either kind
KINDS = ("ddsketch", "tdigest")


def sketch(df: DataFrame, kind: str = "ddsketch", columns: Sequence[str] | None = None) -> DataFrame:
    if kind not in KINDS:
        raise InvalidConfig(f"kind is one of {', '.join(KINDS)}")
    return (ddsketch if kind == "ddsketch" else tdigest)(df, columns)


def kind_of(sketched: DataFrame) -> str:
    return "ddsketch" if "bucket" in sketched.columns else "tdigest"


def merge(*parts: DataFrame) -> DataFrame:
    """Sketches of one kind taken together."""
    kinds = {kind_of(p) for p in parts}
    if len(kinds) != 1:
        raise InvalidConfig("sketches of two kinds can't be merged")
    return merge_ddsketches(*parts) if kinds == {"ddsketch"} else merge_tdigests(reduce(DataFrame.unionByName, parts))


def quantiles(sketched: DataFrame, at: Sequence[float]) -> DataFrame:
    return (dd_quantiles if kind_of(sketched) == "ddsketch" else td_quantiles)(sketched, at)


def to_bytes(sketched: DataFrame) -> bytes:
    """A sketch (some hundred numbers a column) as an Arrow stream that names its kind."""
    rows = sketched.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema.with_metadata({"sketch": kind_of(sketched)})) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def from_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    try:
        rows = pa.ipc.open_stream(data).read_all()
    except pa.ArrowInvalid as e:
        raise ParseError("not a sketch") from e
    if (rows.schema.metadata or {}).get(b"sketch", b"").decode() not in KINDS:
        raise ParseError("not a sketch")
    return spark.createDataFrame(rows)


# ------------------------------------------------------------------ drift between sketches
def compare(reference: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Quantile tables (column, q, value) of both sides -> (column, statistic, severity): the largest relative difference."""
    a, b = reference.select("column", "q", F.col("value").alias("r")), current.select("column", "q", F.col("value").alias("c"))
    eps = 2.220446049250313e-16
    diff = F.when(F.abs("r") > eps, F.abs((F.col("c") - F.col("r")) / F.when(F.abs("r") > eps, F.col("r")))).when(F.abs("c") > eps, 1.0).otherwise(0.0)
    both = a.join(b, ["column", "q"], "full").groupBy("column").agg(F.coalesce(F.max(diff), F.lit(0.0)).alias("statistic"))
    return both.withColumn("severity", sketch_severity(F.col("statistic"), threshold))


# Severities below multiples of the threshold.
SEVERITIES = ((1, "None"), (2, "Low"), (5, "Medium"), (10, "High"))


def sketch_severity(x: Column, threshold: float) -> Column:
    out = F
    for times, name in SEVERITIES:
        out = out.when(x < times * threshold, name)
    return out.otherwise("Critical")


def severity_of(x: float, threshold: float) -> str:
    """The same of one number."""
    return next((name for times, name in SEVERITIES if x < times * threshold), "Critical")


def steps(n: int = 20) -> list[float]:
    n = max(5, n)
    return [i / n for i in range(1, n)]
