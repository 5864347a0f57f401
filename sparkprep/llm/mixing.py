"""Mixing sources to target weights by capped water-filling, in DataFrame expressions alone.

Targets: every source asks for a share of the budget by weight, is clamped at ``max_epochs`` times
its own size, and what the clamped sources leave is shared again by weight until no target is above
its cap. With sources sorted by cap / weight the clamped ones are a prefix, so the fixed point is
found from running sums over the table of sources (one row each) instead of by iteration.

Sampling: a source that needs r repetitions takes each document floor(r) times; the fractional part
takes the documents in the order of a seeded hash until the words wanted are reached. The order is
found in two levels: hash buckets per source are summed first, and only documents of one bucket are
ordered against each other, so a source with a third of all rows is never sorted in one task.

Defined cases: null text has size 0; the null source is a source of its own, last; sources or tables
without words have target 0 and take nothing; documents of equal hash are ordered by id, size and
text hash; repeated rows count separately (fully equal rows share one decision order, arbitrary between
them); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """The number of runs outside white space: positions where a word starts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], max_epochs: int, share: float = 1.0) -> DataFrame:
    """sizes(source, source_size) -> source, source_size, target. Weights repeat over the sources by code point, null last."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("level", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("level", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("offer", F.greatest(F.col("rest"), F.lit(0.0)) / F.col("rest_weight"))
    )
    water = F.max(F.when(F.col("offer") < F.col("level"), F.col("offer"))).over(everything)
    return s.select("source", "source_size", F.when(water.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * water)).alias("target"))


def mix(docs: DataFrame, weights: list[int], max_epochs: int = 3, seed: int = 17, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: its id, size, source_size, target, times and taken (words, repeats counted)."""
    rank = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    base = materialize(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), rank.alias("rank"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("crc")), "mix")
    base = base.withColumn("bucket", F.substring("rank", 1, BUCKET_DIGITS))
    buckets = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))).alias("b")
    at = at.join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "bucket", "ahead", "source_size", "target")
    joined = base.alias("d").join(at.alias("a"), F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.bucket") == F.col("a.bucket")))
    joined = joined.select("id", "d.source", "d.bucket", "size", "rank", "crc", "ahead", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    times = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    whole = F.floor(times + F.lit(1e-12))
    middle = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / F.lit(2.0)
    extra = (middle <= (times - whole) * F.col("source_size")) & (times - whole > F.lit(1e-12))
    out = joined.withColumn("times", (whole + F.when(extra, 1).otherwise(0)).cast("int"))
    return out.select(F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times", "crc")


def repeat(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents as often as mix() says; the columns of docs are kept. Rows that repeat a key are told apart by their texts; of
    rows that repeat both, one stands for all."""
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")))
    times = mixed.groupBy(F.col(key).alias("__sp_key"), F.col("crc").alias("__sp_crc")).agg(F.sum("times").cast("int").alias("__sp_times"), F.count("*").alias("__sp_rows")).filter("__sp_times > 0")
    rows = docs.withColumn("__sp_text", crc)
    if not times.filter("__sp_rows > 1").isEmpty():
        rows = rows.dropDuplicates([key, "__sp_text"])
    out = rows.join(times, F.col(key).eqNullSafe(F.col("__sp_key")) & (F.col("__sp_text") == F.col("__sp_crc")))
    return out.withColumn("__sp_copy", F.explode(F.sequence(F.lit(1), F.col("__sp_times")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), [5, 2, 1], 3)
    return mixed.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.round("target", 6).alias("target"), "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0)::BIGINT AS size,
         md5('17' || chr(31) || coalesce(doc_id::VARCHAR, '')) AS rank
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () AS budget,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_weight,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM w),
f AS (SELECT max(greatest(budget - used, 0) / rest_weight) AS water FROM l WHERE greatest(budget - used, 0) / rest_weight < cap / weight),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target FROM l, f),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS times,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2.0::DOUBLE AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
       (size * (floor(times + 1e-12::DOUBLE) + CASE WHEN times - floor(times + 1e-12::DOUBLE) > 1e-12::DOUBLE AND middle <= (times - floor(times + 1e-12::DOUBLE)) * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM j
"""
