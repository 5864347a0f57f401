"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the
next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from sparkprep.llm import line_dedup, mixing, packing, quality, simjoin
from sparkprep.llm.common import discard, materialize, scratch_mark, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: list[tuple[int, int]] = []


def _frees_scratch(stage: Stage) -> Stage:
    """By the time a stage begins, the output of the one before has been written; the scratch tables of that one go."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if stage is not STAGES[0][1].__wrapped__:
            for marks in _scratch:
                discard(*marks)
        _scratch.clear()
        mark = scratch_mark()
        out = stage(spark, docs, sf_dir)
        _scratch.append((mark, scratch_mark()))
        return out

    return run


@_frees_scratch
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above the threshold of their language go."""
    return quality.keep(spark, docs, sf_dir)


@_frees_scratch
def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs in other documents go."""
    return line_dedup.keep(docs)


@_frees_scratch
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, one stays."""
    return simjoin.keep(docs)


@_frees_scratch
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights."""
    return mixing.repeat(docs, mixing.mix(docs, [5, 2, 1], 3))


@_frees_scratch
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with their token ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", drop_recurring_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: The first stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
