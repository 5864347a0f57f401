"""Registered queries of the core library and their DuckDB equivalents.

Both sides cast counts to BIGINT and round doubles, so that neither types nor the order of sums differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.content import BOOK, Constraint, Field, Schema
from sparkprep.core import shared_dir
from sparkprep.functions import text as tx
from sparkprep.operators import columns as co
from sparkprep.operators import doctests, federated, fim, rows, similarity, splits, tensors, values, watermark
from sparkprep.profile import drift, imbalance, quality, sketches
from sparkprep.registry import Registry
from sparkprep.sources import chunks, container, files, hub
from sparkprep.sources.hub import LICENSES
from sparkprep.streaming import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CUT = "1998-06-01"


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def big(c, name: str):
    return F.coalesce(c, F.lit(0)).cast("bigint").alias(name)


# ------------------------------------------------------------------ projection, filter, order
@query("SELECT c_custkey AS id, TRY_CAST(c_name AS DOUBLE) AS name_number, c_acctbal::BIGINT AS balance, c_mktsegment FROM (SELECT c_custkey, c_name, trunc(c_acctbal) AS c_acctbal, c_mktsegment FROM customer)")
def select_rename_drop_cast(spark, d):
    chain = co.Chain(co.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), co.drop("c_nationkey", "unknown"), co.rename({"c_custkey": "id", "c_name": "name_number", "c_acctbal": "balance", "unknown": "x"}), co.cast({"name_number": "double", "balance": "bigint"}))
    return load(spark, d, "customer").transform(chain)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'")
def filter_predicate(spark, d):
    return load(spark, d, "lineitem").transform(co.where((F.col("l_quantity") < 10) & (F.col("l_returnflag") == "R"))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100")
def sort_topk(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").transform(rows.take(100, [F.col("o_totalprice").desc_nulls_last(), "o_orderkey"]))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 1000")
def skip_take(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").transform(rows.skip(1000, "o_orderkey")).transform(rows.take(50, "o_orderkey"))


@query("SELECT o_orderkey, o_custkey, (row_number() OVER (ORDER BY o_custkey NULLS LAST, o_orderkey) - 1)::BIGINT AS place FROM orders")
def sort_positions(spark, d):
    from sparkprep.core import with_row_id

    return with_row_id(load(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], "place")


@query("SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def union_all(spark, d):
    a = load(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return co.union_all(a, load(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


# ------------------------------------------------------------------ duplicates
@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def unique_first(spark, d):
    return load(spark, d, "documents").transform(rows.unique("text", "doc_id")).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS n FROM documents) WHERE n = 1")
def unique_last(spark, d):
    return load(spark, d, "documents").transform(rows.unique("text", "doc_id", keep="last")).select("doc_id", "lang")


@query("SELECT sum(n)::BIGINT AS rows, count(*)::BIGINT AS distinct_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY lang, source, text)")
def duplicate_rows(spark, d):
    found = rows.duplicate_rows(load(spark, d, "documents").select("lang", "source", "text"))
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in found.columns])


# ------------------------------------------------------------------ values
@query("SELECT p_partkey, round(CASE WHEN max(p_retailprice) OVER () = min(p_retailprice) OVER () THEN 0 ELSE (p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()) END, 6) AS p_retailprice FROM part")
def normalize_minmax(spark, d):
    return load(spark, d, "part").transform(values.normalize("minmax", ["p_retailprice"])).select("p_partkey", r6(F.col("p_retailprice"), "p_retailprice"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def normalize_zscore(spark, d):
    return load(spark, d, "customer").transform(values.normalize("zscore", ["c_acctbal"])).select("c_custkey", r6(F.col("c_acctbal"), "c_acctbal"))


@query("SELECT c_custkey, round(c_acctbal / sqrt(sum(c_acctbal * c_acctbal) OVER ()), 8) AS c_acctbal FROM customer")
def normalize_l2(spark, d):
    return load(spark, d, "customer").transform(values.normalize("l2", ["c_acctbal"])).select("c_custkey", F.round("c_acctbal", 8).alias("c_acctbal"))


_HOLES = "(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"


def _holes(spark, d):
    return load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


@query(f"SELECT event_id, coalesce(value, 0.5) AS value FROM {_HOLES}")
def fill_constant(spark, d):
    return _holes(spark, d).transform(values.fill_value("value", 0.5))


@query(f"SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {_HOLES}")
def fill_forward(spark, d):
    return _holes(spark, d).transform(values.fill_forward("value", "event_id"))


@query(f"SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {_HOLES}")
def fill_backward(spark, d):
    return _holes(spark, d).transform(values.fill_backward("value", "event_id"))


# ------------------------------------------------------------------ text
_SCORES = r"""
WITH t AS (SELECT doc_id, text, strlen(text) AS b, regexp_replace(text, '\n\z', '') AS body FROM documents),
l AS (SELECT *, CASE WHEN b = 0 THEN [] ELSE list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '\r\z', '')) END AS lines FROM t),
e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM (
        SELECT doc_id, byte, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte FROM t) GROUP BY doc_id, byte) GROUP BY doc_id),
s AS (SELECT l.doc_id, b, entropy,
        CASE WHEN b = 0 THEN 0 WHEN r < 0.2 THEN 0 WHEN r < 0.3 THEN r ELSE 1 END AS alnum_score,
        CASE WHEN n = 0 THEN 0 WHEN b / n < 10 THEN 0.2 WHEN b / n > 200 THEN 0.5 ELSE 1 END AS line_score,
        CASE WHEN n <= 1 THEN 1 WHEN 1 - u / n > 0.5 THEN 0.2 ELSE u / n END AS dup_score,
        CASE WHEN b = 0 THEN 0 WHEN entropy < 2 THEN 0.2 WHEN entropy > 6.5 THEN 0.3 ELSE 1 END AS entropy_score
      FROM (SELECT *, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::DOUBLE / nullif(b, 0) AS r, len(lines)::DOUBLE AS n, len(list_distinct(lines))::DOUBLE AS u FROM l) l LEFT JOIN e USING (doc_id))
"""


@query(_SCORES + "SELECT doc_id, round(alnum_score::DOUBLE, 6) AS alnum_score, round(line_score::DOUBLE, 6) AS line_score, round(dup_score::DOUBLE, 6) AS dup_score, round(entropy_score::DOUBLE, 6) AS entropy_score, round(coalesce(entropy, 0), 6) AS entropy FROM s")
def text_scores(spark, d):
    t = F.col("text")
    return load(spark, d, "documents").select("doc_id", r6(tx.alnum_ratio_score(t), "alnum_score"), r6(tx.line_length_score(t), "line_score"), r6(tx.duplicate_lines_score(t), "dup_score"), r6(tx.entropy_score(t), "entropy_score"), r6(tx.byte_entropy(t), "entropy"))


@query(_SCORES + "SELECT doc_id FROM s WHERE b BETWEEN 200 AND 20000 AND (alnum_score + line_score + dup_score + entropy_score) / 4 >= 0.8")
def filter_text(spark, d):
    return tx.filter_text(load(spark, d, "documents"), min_score=0.8, min_length=200, max_length=20000).select("doc_id")


@query("SELECT min(strlen(text))::BIGINT AS min_len, max(strlen(text))::BIGINT AS max_len, round(avg(strlen(text)), 6) AS mean_len, list_sort(list(strlen(text)))[(count(*) // 2) + 1]::BIGINT AS p50_len, list_sort(list(strlen(text)))[floor(count(*) * 0.95::DOUBLE)::BIGINT + 1]::BIGINT AS p95_len, list_sort(list(strlen(text)))[floor(least(count(*) * 0.99::DOUBLE, count(*) - 1))::BIGINT + 1]::BIGINT AS p99_len, count(*) FILTER (regexp_full_match(text, '\\s*'))::BIGINT AS empty_count, count(*) FILTER (starts_with(text, 'The'))::BIGINT AS preamble_count, count(*)::BIGINT AS total FROM documents")
def text_column_stats(spark, d):
    return quality.text_stats(load(spark, d, "documents"), "text", "The").withColumn("mean_len", F.round("mean_len", 6))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def content_hash(spark, d):
    return container.content_hash(load(spark, d, "documents"), "text").select("doc_id", "sha256", F.octet_length("text").cast("bigint").alias("bytes"))


@query("SELECT min(n)::BIGINT AS place FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS n, n_name, n_nationkey, n_regionkey FROM nation) WHERE n_name ILIKE '%an%' OR n_nationkey::VARCHAR LIKE '%an%'")
def search_first_hit(spark, d):
    place = rows.search(load(spark, d, "nation"), "AN", "n_nationkey")
    return spark.createDataFrame([(place,)], "place bigint")


# ------------------------------------------------------------------ profiles
_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS total_count, (count(*) - count({c}))::BIGINT AS null_count, round((count(*) - count({c})) / count(*), 6) AS null_ratio, count(DISTINCT {c} {'+ 0' if c == 'l_discount' else ''})::BIGINT AS unique_count, round(count(DISTINCT {c} {'+ 0' if c == 'l_discount' else ''}) / count({c}), 6) AS unique_ratio FROM lineitem" for c in _PROFILED))
def column_profile(spark, d):
    items = load(spark, d, "lineitem").select(*_PROFILED).withColumn("l_discount", F.col("l_discount") + 0.0)
    p = quality.column_profile(items)
    return p.select("column", big(F.col("total_count"), "total_count"), big(F.col("null_count"), "null_count"), r6(F.col("null_ratio"), "null_ratio"), big(F.col("unique_count"), "unique_count"), r6(F.col("unique_ratio"), "unique_ratio"))


def _rank_sql(c: str, t: str) -> str:
    return f"SELECT '{c}' AS \"column\", q1, median, q3, round(mean, 4) AS mean, round(sd, 4) AS std_dev, (SELECT count(*) FROM {t} WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::BIGINT AS outlier_count FROM (SELECT avg({c}) AS mean, stddev_pop({c}) AS sd, max(CASE WHEN n = c // 4 THEN {c} END) AS q1, max(CASE WHEN n = c // 2 THEN {c} END) AS median, max(CASE WHEN n = 3 * c // 4 THEN {c} END) AS q3 FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS n, count(*) OVER () AS c FROM {t}))"


@query(f"{_rank_sql('o_totalprice', 'orders')} UNION ALL SELECT 'value', * EXCLUDE (\"column\") FROM ({_rank_sql('value', 'events')})")
def quartiles_outliers(spark, d):
    a = quality.numeric_stats(load(spark, d, "orders"), ["o_totalprice"])
    both = a.unionByName(quality.numeric_stats(load(spark, d, "events"), ["value"]))
    return both.select("column", "q1", "median", "q3", F.round("mean", 4).alias("mean"), F.round("std_dev", 4).alias("std_dev"), big(F.col("outlier_count"), "outlier_count"))


@query("SELECT round(least(100, greatest(0, 100 - 30 * (SELECT avg(r) FROM (SELECT 1 - count(c_custkey) / count(*) AS r FROM customer UNION ALL SELECT 1 - count(c_mktsegment) / count(*) FROM customer)) - 5 * (SELECT count(*) FROM (SELECT 1 - count(DISTINCT c_custkey) / count(c_custkey) AS r FROM customer UNION ALL SELECT 1 - count(DISTINCT c_mktsegment) / count(c_mktsegment) FROM customer) WHERE r > 0.5))), 6) AS score")
def quality_score(spark, d):
    found = quality.check(load(spark, d, "customer").select("c_custkey", "c_mktsegment"))
    return spark.createDataFrame([(round(found.score, 6),)], "score double")


@query("SELECT s_suppkey, CASE WHEN s >= 95 THEN 'A' WHEN s >= 85 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 50 THEN 'D' ELSE 'F' END AS grade FROM (SELECT s_suppkey, (s_suppkey % 101)::DOUBLE AS s FROM supplier)")
def letter_grades(spark, d):
    return load(spark, d, "supplier").select("s_suppkey", quality.grade_column((F.col("s_suppkey") % 101).cast("double")).alias("grade"))


_CLASSES = "(SELECT toxic::VARCHAR AS c, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1)"


@query(f"SELECT sum(n)::BIGINT AS total, count(*)::BIGINT AS num_classes, arg_max(c, n) AS majority, arg_min(c, n) AS minority, round(max(n) / min(n), 6) AS ratio, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)), 6) AS normalized_entropy, round(1 - sum(n * n) / (sum(n) * sum(n)), 6) AS gini, CASE WHEN max(n) / min(n) < 1.5 THEN 'None' WHEN max(n) / min(n) < 3 THEN 'Low' WHEN max(n) / min(n) < 10 THEN 'Moderate' WHEN max(n) / min(n) < 100 THEN 'Severe' ELSE 'Extreme' END AS severity FROM {_CLASSES}")
def imbalance_metrics(spark, d):
    m = imbalance.metrics(load(spark, d, "labels"), "toxic")
    return m.select(big(F.col("total"), "total"), big(F.col("num_classes"), "num_classes"), "majority", "minority", *[r6(F.col(c), c) for c in ("ratio", "entropy", "normalized_entropy", "gini")], "severity")


@query("SELECT label, n::BIGINT AS n, round(w * count(*) OVER () / sum(w) OVER (), 4) AS weight FROM (SELECT label, n, sqrt(sum(n) OVER () / (count(*) OVER () * n)) AS w FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label))")
def sqrt_weights(spark, d):
    return splits.class_weights(load(spark, d, "embeddings"), "label").select("label", big(F.col("n"), "n"), F.round(F.col("weight").cast("double"), 4).alias("weight"))


# ------------------------------------------------------------------ splits and samples
@query("SELECT doc_id, toxic FROM (SELECT *, count(*) OVER (PARTITION BY toxic) AS n, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS i, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) AS t FROM labels), LATERAL (SELECT unnest(generate_series(1, t // n + CASE WHEN i < t % n THEN 1 ELSE 0 END)))")
def oversample(spark, d):
    return splits.resample(load(spark, d, "labels"), "toxic", "oversample", "doc_id").select("doc_id", "toxic")


@query("SELECT toxic, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))::BIGINT AS n FROM labels GROUP BY toxic")
def undersample_counts(spark, d):
    return splits.resample(load(spark, d, "labels"), "toxic", "undersample", "doc_id").groupBy("toxic").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN n < round(c * 0.7::DOUBLE) THEN 'train' WHEN n < round(c * 0.7::DOUBLE) + round(c * 0.2::DOUBLE) THEN 'test' ELSE 'validation' END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS c FROM orders)")
def split_positional(spark, d):
    return splits.assign(load(spark, d, "orders"), "o_orderkey", 0.7, 0.2, 0.1).select("o_orderkey", F.col("_split").alias("part"))


@query("SELECT label, a::BIGINT AS train, (n - a)::BIGINT AS test FROM (SELECT label, count(*) AS n, least(greatest(floor(count(*) * 0.8::DOUBLE + 0.5), 1), count(*)) AS a FROM embeddings GROUP BY label)")
def split_stratified_counts(spark, d):
    parts = splits.assign_stratified(load(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.8, 0.2, seed=7)
    return parts.groupBy("label").agg(F.count_if(F.col("_split") == "train").alias("train"), F.count_if(F.col("_split") == "test").alias("test"))


@query("SELECT origin, n::BIGINT AS n FROM (SELECT 'customer' AS origin, trunc(((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)) * 0.25::DOUBLE) AS n UNION ALL SELECT 'supplier', trunc(((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)) * 0.75::DOUBLE))")
def mix_counts(spark, d):
    a = load(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("origin"))
    b = load(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("origin"))
    return splits.mix([(a, 1.0), (b, 3.0)], "name").groupBy("origin").agg(F.count("*").alias("n"))


@query("SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 128)::BIGINT AS batch FROM events")
def batches(spark, d):
    return splits.batches(load(spark, d, "events").select("event_id"), 128, "event_id").select("event_id", F.col("_batch_id").alias("batch"))


@query("SELECT (SELECT count(*) FROM orders)::BIGINT AS n, (SELECT count(*) FROM orders)::BIGINT AS distinct_keys")
def shuffle_permutes(spark, d):
    return load(spark, d, "orders").transform(rows.shuffle(11, "o_orderkey")).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("distinct_keys"))


@query("SELECT round(count(*) * 0.1::DOUBLE)::BIGINT AS n FROM orders")
def sample_fraction(spark, d):
    return load(spark, d, "orders").transform(rows.sample(fraction=0.1, seed=3, key="o_orderkey")).agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS draws FROM part")
def weighted_draws(spark, d):
    return splits.weighted_sample(load(spark, d, "part"), "p_size", "p_partkey", seed=5).agg(F.count("*").alias("draws"))


@query("SELECT node_id, total_rows, train_rows, test_rows, round(total_rows / sum(total_rows) OVER (), 6) AS contribution_ratio, round(train_rows / total_rows, 6) AS train_ratio, train_rows < 10 OR test_rows < 10 AS insufficient_samples, abs(train_rows / total_rows - avg(train_rows / total_rows) OVER ()) > 0.1 AS ratio_deviation FROM (SELECT (o_custkey % 4)::VARCHAR AS node_id, count(*)::BIGINT AS total_rows, (count(*) FILTER (o_orderkey % 5 <> 0))::BIGINT AS train_rows, (count(*) FILTER (o_orderkey % 5 = 0))::BIGINT AS test_rows FROM orders GROUP BY 1)")
def federated_verify(spark, d):
    orders = load(spark, d, "orders").select((F.col("o_custkey") % 4).alias("node"), F.when(F.col("o_orderkey") % 5 != 0, "train").otherwise("test").alias("_split"))
    found = federated.verify(federated.manifests(orders, "node"))
    return found.select("node_id", *[big(F.col(c), c) for c in ("total_rows", "train_rows", "test_rows")], r6(F.col("contribution_ratio"), "contribution_ratio"), r6(F.col("train_ratio"), "train_ratio"), "insufficient_samples", "ratio_deviation")


@query("SELECT node_id, greatest(floor(n * 0.8::DOUBLE + 0.5), 1)::BIGINT AS train, (n - greatest(floor(n * 0.8::DOUBLE + 0.5), 1))::BIGINT AS test FROM (SELECT (o_custkey % 4)::VARCHAR AS node_id, count(*) AS n FROM orders GROUP BY 1)")
def federated_execute(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).cast("string").alias("node_id"))
    plan = federated.plan(orders.select("node_id").distinct(), federated.Strategy("proportional_iid"))
    parts = federated.execute(orders.withColumnRenamed("node_id", "node"), plan, "node", "o_orderkey")
    return parts.groupBy(F.col("node").alias("node_id")).agg(F.count_if(F.col("_split") == "train").alias("train"), F.count_if(F.col("_split") == "test").alias("test"))


# ------------------------------------------------------------------ drift
def _sides(spark, d):
    items = load(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_shipdate")
    return [items.filter(c).drop("l_shipdate") for c in (F.col("l_shipdate") < CUT, F.col("l_shipdate") >= CUT)]


_SIDES = f"s AS (SELECT 'l_quantity' AS \"column\", l_quantity::DOUBLE AS v, l_shipdate < '{CUT}' AS r FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice, l_shipdate < '{CUT}' FROM lineitem)"


@query(f"WITH {_SIDES}, n AS (SELECT \"column\", v, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS b FROM s GROUP BY 1, 2), c AS (SELECT \"column\", sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb FROM n WINDOW w AS (PARTITION BY \"column\" ORDER BY v), p AS (PARTITION BY \"column\")) SELECT \"column\", 'ks' AS test, round(max(abs(fa - fb)), 6) AS statistic FROM c GROUP BY 1")
def drift_ks(spark, d):
    return drift.detect(*_sides(spark, d), tests=["ks"]).select("column", "test", r6(F.col("statistic"), "statistic"))


def _histogram_sql(bins: str) -> str:
    return f"""{_SIDES}, m AS (SELECT "column", min(v) AS lo, max(v) AS hi, (count(*) FILTER (r))::DOUBLE AS nr, (count(*) FILTER (NOT r))::DOUBLE AS nc FROM s GROUP BY 1),
    g AS (SELECT *, {bins} AS k FROM m), e AS (SELECT *, unnest(range(k::BIGINT)) AS bin FROM g),
    f AS (SELECT "column", least(floor((v - lo) / ((hi - lo) / k)), k - 1)::BIGINT AS bin, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS b FROM s JOIN g USING ("column") GROUP BY 1, 2),
    h AS (SELECT "column", bin, k, nr, nc, coalesce(a, 0)::DOUBLE AS a, coalesce(b, 0)::DOUBLE AS b FROM e LEFT JOIN f USING ("column", bin))"""


@query(f"WITH {_histogram_sql('least(greatest(ceil(sqrt(nr)), 5), 20)')} SELECT \"column\", 'chi2' AS test, round(sum(CASE WHEN a + b > 0 THEN (a - (a + b) * nr / (nr + nc)) ** 2 / ((a + b) * nr / (nr + nc)) + (b - (a + b) * nc / (nr + nc)) ** 2 / ((a + b) * nc / (nr + nc)) ELSE 0 END), 4) AS statistic FROM h GROUP BY 1")
def drift_chi2(spark, d):
    return drift.detect(*_sides(spark, d), tests=["chi2"]).select("column", "test", F.round("statistic", 4).alias("statistic"))


@query(f"WITH {_histogram_sql('10')}, p AS (SELECT \"column\", (a + 0.5) / (nr + 5) AS p, (b + 0.5) / (nc + 5) AS q FROM h) SELECT \"column\", 'psi' AS test, round(sum((q - p) * ln(q / p)), 6) AS statistic FROM p GROUP BY 1")
def drift_psi(spark, d):
    return drift.detect(*_sides(spark, d), tests=["psi"]).select("column", "test", r6(F.col("statistic"), "statistic"))


@query(f"WITH {_histogram_sql('20')}, p AS (SELECT \"column\", (a + 0.5) / (nr + 10) AS p, (b + 0.5) / (nc + 10) AS q FROM h) SELECT \"column\", 'js' AS test, round(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2 / ln(2), 6) AS statistic FROM p GROUP BY 1")
def drift_js(spark, d):
    return drift.detect(*_sides(spark, d), tests=["js"]).select("column", "test", r6(F.col("statistic"), "statistic"))


# ------------------------------------------------------------------ sketches
_BUCKET = "ceil(ln(value) / ln(1.01::DOUBLE / 0.99::DOUBLE))::INT"


@query(f"SELECT 'value' AS \"column\", {_BUCKET} AS bucket, count(*)::BIGINT AS n FROM events GROUP BY 2")
def ddsketch_buckets(spark, d):
    return sketches.ddsketch(load(spark, d, "events"), ["value"]).select("column", "bucket", "n")


def _dd_sql(where: str) -> str:
    return f"(SELECT i / 20 AS q, 2 * (1.01::DOUBLE / 0.99::DOUBLE) ** bucket / (1.01::DOUBLE / 0.99::DOUBLE + 1) AS value FROM (SELECT bucket, sum(n) OVER (ORDER BY bucket) AS u, sum(n) OVER (ORDER BY bucket) - n AS l, sum(n) OVER () AS t FROM (SELECT {_BUCKET} AS bucket, count(*) AS n FROM events WHERE {where} GROUP BY 1)), range(1, 20) r(i) WHERE u >= ceil(i / 20 * t) AND l < ceil(i / 20 * t))"


@query(f"SELECT 'value' AS \"column\", round(q, 2) AS q, round(value, 6) AS value FROM {_dd_sql('true')}")
def ddsketch_quantiles(spark, d):
    return sketches.dd_quantiles(sketches.ddsketch(load(spark, d, "events"), ["value"]), sketches.steps()).select("column", F.round("q", 2).alias("q"), r6(F.col("value"), "value"))


@query("SELECT 'value' AS \"column\", round(max(abs((b.value - a.value) / a.value)), 6) AS statistic FROM " + _dd_sql("ts < '2024-01-16'") + " a JOIN " + _dd_sql("ts >= '2024-01-16'") + " b USING (q)")
def sketch_compare(spark, d):
    events = load(spark, d, "events")
    sides = [sketches.dd_quantiles(sketches.ddsketch(events.filter(c), ["value"]), sketches.steps()) for c in (F.col("ts") < "2024-01-16", F.col("ts") >= "2024-01-16")]
    return sketches.compare(*sides).select("column", r6(F.col("statistic"), "statistic"))


@query()
def tdigest_quantiles(spark, d):
    return sketches.td_quantiles(sketches.tdigest(load(spark, d, "events"), ["value"]), sketches.steps())


# ------------------------------------------------------------------ contamination
_GRAMS = """
WITH d AS (SELECT doc_id, lower(regexp_replace(text, '\\s', '', 'g')) AS t FROM documents), b AS (SELECT item_id, lower(regexp_replace(text, '\\s', '', 'g')) AS t FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(t) - 8), lambda i: substring(t, i, 10))) AS g FROM d),
bg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(t) - 8), lambda i: substring(t, i, 10))) AS g FROM b),
n AS (SELECT doc_id, count(*) AS total FROM dg GROUP BY 1),
shared AS (SELECT doc_id, item_id, count(*) / any_value(total) AS o FROM dg JOIN bg USING (g) JOIN n USING (doc_id) GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o DESC, item_id) AS k FROM shared) WHERE k = 1)
"""


@query(_GRAMS + "SELECT doc_id, item_id, round(o, 6) AS overlap FROM best")
def contamination(spark, d):
    found = similarity.contamination(load(spark, d, "documents"), load(spark, d, "benchmark"), "doc_id", "item_id")
    return found.select("doc_id", "item_id", r6(F.col("overlap"), "overlap"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality filter, exact deduplication, decontamination, and a summary by language."""
    docs = tx.filter_text(load(spark, sf_dir, "documents"), min_score=0.8)
    docs = docs.transform(rows.unique("text", "doc_id"))
    clean = similarity.decontaminate(docs, load(spark, sf_dir, "benchmark"), "doc_id", "item_id", threshold=0.05)
    return clean.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))


@query(
    _GRAMS.replace("WITH d AS", _SCORES.strip() + ", d AS")
    + "SELECT lang, count(*)::BIGINT AS docs, sum(strlen(text))::BIGINT AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents JOIN s AS sc USING (doc_id) WHERE (alnum_score + line_score + dup_score + entropy_score) / 4 >= 0.8) WHERE k = 1 AND doc_id NOT IN (SELECT doc_id FROM best WHERE o > 0.05) GROUP BY lang"
)
def prepare_corpus(spark, d):
    return flagship(spark, d)


# ------------------------------------------------------------------ tensors, json, the rest
@query("SELECT doc_id, coalesce(quality, 0)::BIGINT AS label FROM labels")
def labels_vector(spark, d):
    return load(spark, d, "labels").select("doc_id", tensors.labels("quality").alias("label"))


@query("SELECT p_partkey, [p_size::FLOAT, p_retailprice::FLOAT] AS features FROM part")
def feature_vectors(spark, d):
    return tensors.vector(load(spark, d, "part"), ["p_size", "p_retailprice"]).select("p_partkey", "features")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE json_valid(props) GROUP BY 1")
def json_props(spark, d):
    events = load(spark, d, "events").select("event_type", F.from_json("props", "map<string,string>").alias("p"))
    return events.filter(F.col("p").isNotNull()).groupBy("event_type").agg(F.count("*").alias("n"))


def _unit(seed: int) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', doc_id::VARCHAR)), 1, 15))::BIGINT % 4503599627370496) / 4503599627370496::DOUBLE"


@query(f"SELECT doc_id, CASE WHEN strlen(text) >= 10 AND {_unit(42)} < 0.5 THEN '<|fim_prefix|>' || substring(text, 1, least(i, j)) || '<|fim_suffix|>' || substring(text, greatest(i, j) + 1) || '<|fim_middle|>' || substring(text, least(i, j) + 1, greatest(i, j) - least(i, j)) ELSE text END AS text FROM (SELECT doc_id, text, floor({_unit(43)} * (length(text) + 1))::BIGINT AS i, floor({_unit(44)} * (length(text) + 1))::BIGINT AS j FROM documents)")
def fill_in_the_middle(spark, d):
    return load(spark, d, "documents").select("doc_id", "text").transform(fim.fim("text", "doc_id", rate=0.5, seed=42))


# The mark of 256 bits is that of the bytes 0 to 31, the highest bit first; so the low bit of row r is known, and what is measured of it countable.
@query("""
WITH x AS (SELECT r, (((r % 256) // 8) >> (7 - r % 8)) & 1 AS bit FROM (SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::BIGINT AS r FROM part WHERE p_retailprice IS NOT NULL)),
s AS (SELECT count(*) AS n, sum(bit)::DOUBLE AS ones, sum(bit) / count(*)::DOUBLE AS p, 2 * sum(bit) / count(*)::DOUBLE - 1 AS mean FROM x),
c AS (SELECT sum((2 * a.bit - 1 - mean) * (2 * b.bit - 1 - mean)) / count(*) AS cov FROM x a JOIN x b ON a.r = b.r + 256, s),
o AS (SELECT n, p, ones, CASE WHEN n < 512 OR 1 - mean * mean < 1e-10 THEN 0.0 ELSE least(greatest(coalesce(cov, 0) / (1 - mean * mean), -1), 1) END AS auto FROM s, c)
SELECT 'p_retailprice' AS "column", n::BIGINT AS n, round(-p * log2(p) - (1 - p) * log2(1 - p), 6) AS lsb_entropy, round(exp(-(ones - n / 2) * (ones - n / 2) / (n / 2)), 6) AS chi_square_pvalue,
       round(exp(-2 * (p - 0.5) * (p - 0.5) * n), 6) AS ks_pvalue, round(auto, 6) AS autocorrelation_256, auto > 0.5 AS anomalous FROM o""")
def watermark_bits(spark, d):
    parts = load(spark, d, "part").select("p_partkey", "p_retailprice")
    marked = watermark.embed(parts, bytes(range(32)), bytes(32), ["p_retailprice"], "p_partkey")
    return watermark.analyze(marked, "p_partkey").select("column", "n", *(r6(F.col(c), c) for c in ("lsb_entropy", "chi_square_pvalue", "ks_pvalue", "autocorrelation_256")), "anomalous")


@query("SELECT 'demo' AS source, '1.0' AS version, 'pkg.m' || r_regionkey AS module, 'f' AS function, '>>> f(2)' AS input, '4' AS expected, 'def f(x)' AS signature FROM region")
def extract_doctests(spark, d):
    code = "def f(x):\n    \"\"\"Double.\n\n    >>> f(2)\n    4\n    \"\"\"\n    return 2 * x\n"
    files = load(spark, d, "region").select(F.lit(code).alias("content"), F.concat(F.lit("pkg.m"), F.col("r_regionkey").cast("string")).alias("module"))
    return doctests.extract(files, "demo", "1.0")


# ------------------------------------------------------------------ sources and sinks
def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}/{name}"


@query("SELECT * FROM customer")
def csv_round_trip(spark, d):
    customers, path = load(spark, d, "customer"), _place(spark, "t.csv")
    files.save(customers, path)
    return files.read_csv(spark, path, files.CsvOptions(schema=customers.schema))


@query("SELECT * FROM nation")
def json_round_trip(spark, d):
    nations, path = load(spark, d, "nation"), _place(spark, "t.json")
    files.save(nations, path)
    return files.read_json(spark, path, files.JsonOptions(schema=nations.schema)).select(*nations.columns)


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def ipc_round_trip(spark, d):
    path = _place(spark, "t.arrow")
    files.save(load(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), path)
    return files.load(spark, path)


@query("SELECT * FROM supplier")
def container_round_trip(spark, d):
    suppliers = load(spark, d, "supplier")
    return container.unpacked(container.packed(suppliers, 500), suppliers.schema)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 700 OFFSET 900")
def chunked_rows(spark, d):
    path = _place(spark, "t.spd")
    chunks.write_chunks(load(spark, d, "orders").orderBy("o_orderkey"), path, 5000)
    return chunks.Chunked(spark, path).get_rows(900, 700, ["o_orderkey", "o_custkey"])


@query("SELECT * FROM region")
def registry_pull(spark, d):
    registry = Registry(spark, _place(spark, "registry"))
    registry.publish("region", "1.0", load(spark, d, "region").drop("r_name"))
    registry.publish("region", "1.1", load(spark, d, "region"))
    return registry.pull("region")


@query("SELECT n_nationkey::VARCHAR AS chapter_id, n_name AS chapter_title, n_regionkey::VARCHAR AS \"order\", CASE WHEN n_nationkey % 2 = 0 THEN 'easy' END AS difficulty, NULL::VARCHAR AS estimated_time FROM nation")
def book_chapters(spark, d):
    chapter = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), F.col("n_regionkey").alias("order"), F.struct(F.when(F.col("n_nationkey") % 2 == 0, "easy").alias("difficulty")).alias("settings"))
    books = load(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(chapter).alias("chapters"))
    return BOOK.to_rows(books.select(F.to_json(F.struct(F.lit("b").alias("id"), F.lit("t").alias("title"), F.lit("a").alias("author"), "chapters")).alias("json")))


@query("SELECT rule, count(*)::BIGINT AS n FROM (SELECT 'p_size:max' AS rule FROM part WHERE p_size > 25 UNION ALL SELECT 'p_name:pattern' FROM part WHERE NOT regexp_matches(p_name, '^[a-m]') UNION ALL SELECT 'p_brand:enum' FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#22')) GROUP BY rule")
def schema_violations(spark, d):
    schema = Schema("parts", fields=(Field("p_size", "integer", constraints=(Constraint("max", 25),)), Field("p_name", "string", constraints=(Constraint("pattern", "^[a-m]"),)), Field("p_brand", "string", constraints=(Constraint("enum", ("Brand#11", "Brand#22")),))))
    return schema.validate(load(spark, d, "part")).select(F.explode("_violations").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, min(levenshtein(c_mktsegment, x))::BIGINT AS distance FROM customer, (SELECT unnest(['" + "', '".join(LICENSES) + "']) AS x) GROUP BY c_custkey")
def nearest_name(spark, d):
    return load(spark, d, "customer").select("c_custkey", hub.least_distance(F.col("c_mktsegment"), LICENSES).cast("bigint").alias("distance"))


@query("SELECT event_type, ts::DATE AS day, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def streaming_daily_counts(spark, d):
    base = _place(spark, "stream")
    schema = load(spark, d, "events").schema
    stream = frames.read_stream(spark, f"{d}/events*.parquet", schema)
    counts = lambda batch: batch.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    frames.each_batch(stream, counts, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type", "day").agg(F.sum("n").alias("n"))


from sparkprep.plans import interfaces  # noqa: E402,F401  registers its queries
