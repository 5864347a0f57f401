"""Text quality as column expressions. Lengths are in bytes, as UTF-8."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.errors import ColumnNotFound

#: Names that are taken for the text of a table, in this order.
TEXT_NAMES = ("text", "content", "code", "source")


def lines(t: Column) -> Column:
    """The lines; a line feed at the end opens none, and a carriage return before a line feed is not part of a line."""
    body = F.regexp_replace(t, r"\n\z", "")
    return F.when(F.octet_length(t) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\r\z", "")))


def alnum_ratio_score(t: Column) -> Column:
    """1 where letters and digits are 0.3 or more per byte, 0 below 0.2."""
    ratio = F.length(F.regexp_replace(t, r"[^\p{IsAlphabetic}\p{N}]", "")) / F.octet_length(t)
    return F.when(F.octet_length(t) == 0, 0.0).when(ratio < 0.2, 0.0).when(ratio < 0.3, ratio).otherwise(1.0)


def _line_counts(t: Column, use: Callable[[Column, Column], Column]) -> Column:
    """use(lines, distinct lines)."""
    counted = measures(t)
    return use(counted["n"], counted["u"])


def _length_score(t: Column, n: Column) -> Column:
    mean = F.octet_length(t) / F.when(n > 0, n)
    return F.when(n == 0, 0.0).when(mean < 10, 0.2).when(mean > 200, 0.5).otherwise(1.0)


def _distinct_score(n: Column, u: Column) -> Column:
    share = u / F.when(n > 0, n)
    return F.when(n <= 1, 1.0).when(1 - share > 0.5, 0.2).otherwise(share)


def line_length_score(t: Column) -> Column:
    """1 for 10 to 200 bytes a line on average."""
    return _line_counts(t, lambda n, u: _length_score(t, n))


def duplicate_lines_score(t: Column) -> Column:
    """The share of distinct lines; 0.2 if fewer than half are."""
    return _line_counts(t, _distinct_score)


def _lines_of(text: str) -> list[str]:
    """What lines() gives."""
    out = text.removesuffix("\n").split("\n") if text else []
    return [x.removesuffix("\r") for x in out] if "\r" in text else out


@F.pandas_udf(T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("n", T.IntegerType()), T.StructField("u", T.IntegerType())]))
def measures(texts: pd.Series) -> pd.DataFrame:
    """What is counted of a text, in one pass whatever the number of scores: Shannon entropy of its bytes, in bits, by one histogram over
    (row, byte) per run of rows; its lines, and its distinct lines. Spark evaluates equal calls once."""
    raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    found = [None if t is None else _lines_of(t) for t in texts]
    out, at = np.full(len(raw), np.nan), 0
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and stop - at < 4096 and (size < 1 << 24 or stop == at):
            size += len(raw[stop] or b"")
            stop += 1
        sizes = np.array([len(x or b"") for x in raw[at:stop]])
        cells = np.frombuffer(b"".join(x or b"" for x in raw[at:stop]), np.uint8) + np.repeat(np.arange(stop - at) * 256, sizes)
        n = np.bincount(cells, minlength=256 * (stop - at)).reshape(-1, 256).astype(float)
        total = np.maximum(sizes, 1)
        out[at:stop] = np.where(sizes > 0, np.log2(total) - (n * np.log2(np.maximum(n, 1))).sum(1) / total, 0.0)
        at = stop
    count = lambda f: pd.array([None if x is None else f(x) for x in found], "Int32")
    return pd.DataFrame({"entropy": pd.Series(out).mask([x is None for x in raw]), "n": count(len), "u": count(lambda x: len(set(x)))})


def byte_entropy(t: Column) -> Column:
    """Shannon entropy of the bytes, in bits."""
    return measures(t)["entropy"]


def entropy_score(t: Column) -> Column:
    e = byte_entropy(t)
    return F.when(F.octet_length(t) == 0, 0.0).when(e < 2, 0.2).when(e > 6.5, 0.3).otherwise(1.0)


def composite_score(t: Column) -> Column:
    """The mean of the four scores."""
    by_lines = _line_counts(t, lambda n, u: _length_score(t, n) + _distinct_score(n, u))
    return (alnum_ratio_score(t) + by_lines + entropy_score(t)) / 4


def find_text_column(df: DataFrame) -> str:
    """The first usual name that is a string, else the first string column."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for name in TEXT_NAMES:
        if name in strings:
            return name
    if not strings:
        raise ColumnNotFound("text", df.columns)
    return strings[0]


def filter_text(df: DataFrame, column: str | None = None, min_score: float = 0.5, min_length: int = 0, max_length: int = 2**31 - 1) -> DataFrame:
    """Rows whose text has a length in range and a composite score of at least min_score; null text goes."""
    t = F.col(column or find_text_column(df))
    return df.filter(F.octet_length(t).between(min_length, max_length) & (composite_score(t) >= min_score))
