"""Distribution drift between two tables: Kolmogorov-Smirnov, chi-squared, PSI and Jensen-Shannon tests.

Both tables are unpivoted to (column, side, value) and counted by value once; every test is an aggregate over
those counts, for all columns in one job.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.core import materialize, running_totals
from sparkprep.errors import EmptyDataset, InvalidConfig, SchemaMismatch

SEVERITIES = ("None", "Low", "Medium", "High", "Critical")
TESTS = ("ks", "chi2", "psi", "js")
# Bins and smoothing of the histogram tests, and severity limits.
PSI_BINS, JS_BINS, CHI_BINS, SMOOTH = 10, 20, (5, 20), 0.5
P_LIMITS = (0.05, 0.01, 0.001, 0.0001)
PSI_LIMITS = (0.1, 0.2, 0.25, 0.5)
JS_LIMITS = (0.05, 0.1, 0.2, 0.4)


def severity_rising(value: Column, limits: Sequence[float]) -> Column:
    """None below the first limit, then one step for each limit reached."""
    out = F.lit(SEVERITIES[len(limits)])
    for name, limit in reversed(list(zip(SEVERITIES, limits, strict=False))):
        out = F.when(value < limit, name).otherwise(out)
    return out


def severity_p(p: Column, alpha: float) -> Column:
    out = F.lit("None")
    for name, limit in zip(SEVERITIES[1:], P_LIMITS, strict=True):  # the smallest limit that holds wins
        out = F.when(p <= limit, name).otherwise(out)
    return F.when(p <= alpha, out).otherwise("None")


def ks_p_value(z: Column) -> Column:
    """The asymptotic probability of a larger statistic."""
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * z * z))
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(z <= 0, 1.0).when(z > 3, 0.0).otherwise(F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0)))


def erf(x: Column) -> Column:
    """The rational approximation 7.1.26 of Abramowitz and Stegun."""
    # Its coefficients.
    a1, a2, a3, a4, a5, p = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429, 0.3275911
    t = 1 / (1 + p * F.abs(x))
    poly = t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5))))
    return F.when(x < 0, -1.0).otherwise(1.0) * (1 - poly * F.exp(-x * x))


def normal_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / math.sqrt(2)))


def chi2_p_value(x: Column, df: Column) -> Column:
    """Wilson and Hilferty's approximation."""
    k = F.greatest(df, F.lit(1)).cast("double")
    c = 2 / (9 * k)
    return F.when(df <= 0, 1.0).otherwise(1 - normal_cdf((F.cbrt(x / k) - (1 - c)) / F.sqrt(c)))


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType,)) and not isinstance(f.dataType, T.DecimalType)]


def value_counts(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, r, c): how often each value occurs on either side; nulls are left out."""
    def long(df: DataFrame, side: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("double").alias("value")) for x in columns])
        return df.select(F.explode(cells).alias("x")).select("x.column", "x.value", F.lit(int(side == "r")).alias("r"), F.lit(int(side == "c")).alias("c")).filter("value IS NOT NULL")

    both = long(reference, "r").unionByName(long(current, "c"))
    return both.groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ks(counts: DataFrame) -> DataFrame:
    """(column, statistic, p_value, _nr, _nc) from value counts: running counts on both sides, compared value by value."""
    finite = counts.filter(_finite(F.col("value")))
    n = finite.groupBy("column").agg(F.sum("r").alias("_nr"), F.sum("c").alias("_nc"))
    upto = running_totals(finite, "column", "value", {"_ur": "r", "_uc": "c"}).join(n, "column")
    stat = upto.groupBy("column", "_nr", "_nc").agg(F.max(F.abs(F.col("_ur") / F.nullif("_nr", F.lit(0)) - F.col("_uc") / F.nullif("_nc", F.lit(0)))).alias("statistic"))
    z = F.col("statistic") * F.sqrt(F.col("_nr") / (F.col("_nr") + F.col("_nc")) * F.col("_nc"))
    return stat.withColumn("p_value", ks_p_value(z)).filter("_nr > 0 AND _nc > 0")


def histogram(counts: DataFrame, bins: Column | int) -> DataFrame:
    """(column, bin, r, c, _nr, _nc, _bins), all bins dense; equal widths over the pooled finite range.

    The last bin is closed, values that aren't finite are in bin 0, and a constant column has one bin."""
    v = F.col("value")
    stats = counts.groupBy("column").agg(F.min(F.when(_finite(v), v)).alias("_lo"), F.max(F.when(_finite(v), v)).alias("_hi"), F.sum("r").alias("_nr"), F.sum("c").alias("_nc"))
    stats = stats.withColumn("_bins", F.lit(bins) if isinstance(bins, int) else bins)
    stats = stats.withColumn("_used", F.when(F.col("_hi") - F.col("_lo") < 2.220446049250313e-16, 1).otherwise(F.col("_bins")))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_bins")
    one = F.col("_used") == 1
    at = F.when(one | ~_finite(v), 0).otherwise(F.least(F.floor((v - F.col("_lo")) / F.when(~one, width)), F.col("_bins") - 1)).cast("int")
    filled = counts.join(F.broadcast(stats), "column").groupBy("column", at.alias("bin")).agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    dense = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_used") - 1)))
    return dense.join(filled, ["column", "bin"], "left").fillna(0, ["r", "c"])


def chi2(counts: DataFrame) -> DataFrame:
    bins = F.least(F.greatest(F.ceil(F.sqrt(F.col("_nr"))), F.lit(CHI_BINS[0])), F.lit(CHI_BINS[1])).cast("int")
    h = histogram(counts, bins)
    row, total = F.col("r") + F.col("c"), F.col("_nr") + F.col("_nc")
    expected = lambda n: row * F.col(n) / total
    part = lambda x, n: F.when(expected(n) > 0, F.pow(F.col(x) - expected(n), F.lit(2)) / F.when(expected(n) > 0, expected(n))).otherwise(0.0)
    stat = h.groupBy("column").agg(F.sum(part("r", "_nr") + part("c", "_nc")).alias("statistic"), F.greatest(F.count_if(row > 0) - 1, F.lit(0)).alias("df"))
    return stat.withColumn("p_value", chi2_p_value(F.col("statistic"), F.col("df")))


def _shares(h: DataFrame, bins: int) -> tuple[Column, Column]:
    return tuple((F.col(x) + SMOOTH) / (F.col(n) + SMOOTH * bins) for x, n in (("r", "_nr"), ("c", "_nc")))


def psi(counts: DataFrame) -> DataFrame:
    h = histogram(counts, PSI_BINS)
    p, q = _shares(h, PSI_BINS)
    return h.groupBy("column").agg(F.sum((q - p) * F.ln(q / p)).alias("statistic"))


def js(counts: DataFrame) -> DataFrame:
    h = histogram(counts, JS_BINS)
    p, q = _shares(h, JS_BINS)
    m = (p + q) / 2
    return h.groupBy("column").agg((F.sum(p * F.ln(p / m) + q * F.ln(q / m)) / 2 / math.log(2)).alias("statistic"))


def detect(reference: DataFrame, current: DataFrame, tests: Sequence[str] = ("ks",), alpha: float = 0.05, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, test, statistic, p_value, severity, drifted) of every numeric column and test."""
    if [(f.name, f.dataType) for f in reference.schema] != [(f.name, f.dataType) for f in current.schema]:
        raise SchemaMismatch("the tables must have one schema")
    for t in tests:
        if t not in TESTS:
            raise InvalidConfig(f"no test {t!r}; there are {', '.join(TESTS)}")
    names = list(columns) if columns is not None else _numeric(reference)
    if not names or not tests:
        raise InvalidConfig("nothing to test")
    counts = materialize(value_counts(reference, current, names))
    sides = counts.agg(F.sum("r"), F.sum("c")).first()
    if not sides[0] or not sides[1]:
        raise EmptyDataset("a side has no values")
    out = None
    for t in tests:
        got = {"ks": ks, "chi2": chi2, "psi": psi, "js": js}[t](counts)
        if t in ("ks", "chi2"):
            got = got.withColumn("severity", severity_p(F.col("p_value"), alpha))
        else:
            got = got.withColumn("p_value", F.lit(None).cast("double")).withColumn("severity", severity_rising(F.col("statistic"), PSI_LIMITS if t == "psi" else JS_LIMITS))
        got = got.select("column", F.lit(t).alias("test"), "statistic", "p_value", "severity")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("drifted", F.col("severity") != "None")


@dataclass(frozen=True)
class DriftReport:
    rows: tuple[dict, ...]

    @property
    def drifted_columns(self) -> list[str]:
        return sorted({r["column"] for r in self.rows if r["drifted"]})

    @property
    def max_severity(self) -> str:
        return max((r["severity"] for r in self.rows), key=SEVERITIES.index, default="None")

    def has_drift(self) -> bool:
        return bool(self.drifted_columns)


def report(*args, **kwargs) -> DriftReport:
    return DriftReport(tuple(r.asDict() for r in detect(*args, **kwargs).collect()))  # one row per column and test
