"""Fill-in-the-middle: texts are cut at two places and rearranged with sentinels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.core import need, uniform
from sparkprep.errors import InvalidConfig
from sparkprep.operators.columns import Transform


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<|fim_prefix|>"
    suffix: str = "<|fim_suffix|>"
    middle: str = "<|fim_middle|>"


def fim(column: str, key: str, rate: float = 0.5, layout: str = "psm", min_chars: int = 10, seed: int = 42, tokens: Sentinels | None = None) -> Transform:
    """Rewrite a share of the texts: prefix, suffix, middle ('psm') or suffix, prefix, middle ('spm').

    Which rows, and where they are cut, follows from the seed and the row's key. Null texts and those under
    min_chars bytes are kept."""
    if layout not in ("psm", "spm"):
        raise InvalidConfig("layout is 'psm' or 'spm'")
    t = tokens or Sentinels()

    def run(df: DataFrame) -> DataFrame:
        need(df, column, key)
        c, n = F.col(column), F.length(column)
        at = [F.floor(uniform(seed + i, key) * (n + 1)).cast("int") for i in (1, 2)]
        a, b = F.least(*at), F.greatest(*at)
        prefix, middle, suffix = F.substring(c, F.lit(1), a), F.substring(c, a + 1, b - a), F.substring(c, b + 1, n)
        parts = [F.lit(t.prefix), prefix, F.lit(t.suffix), suffix] if layout == "psm" else [F.lit(t.suffix), suffix, F.lit(t.prefix), prefix]
        chosen = (uniform(seed, key) < min(1.0, max(0.0, rate))) & (F.octet_length(c) >= min_chars)
        return df.withColumn(column, F.when(chosen, F.concat(*parts, F.lit(t.middle), middle)).otherwise(c))

    return run
