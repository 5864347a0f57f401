"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join, in DataFrame expressions alone.

A list has entries of a host, a path and a verdict. An entry fits its host and all subdomains of it, if the path of a url
starts with the entry's; of several that fit, the longest (host and path together, then host, then text) decides, and of
equal entries with different verdicts ``block``. What no entry fits is not listed and has the verdict ``default``.

The filter holds every listed host and every listed (host, path), BITS bits each, in blocks of 512 bits of which a key
sets eight, one in each word. It is built by grouping the list by block, so no task or driver holds it whole, and has at
most MOST_BLOCKS rows of nine numbers, whatever the length of the list: that bound is what makes its broadcast safe; a
list that is longer has fewer bits a key, so more false hits, and the same results. A url asks first for those
suffixes of its host that have as many labels as some entry, then, for suffixes that pass, for those beginnings of its
path that are as long as some entry's. Both questions are answered where the url was read. Only what passes both is
shuffled, to the exact join on host and path, in which false hits find no entry.

Verdicts depend on host and path only, so urls that repeat are judged once and the verdicts return by a join on both; a
url or an entry that a third of all rows share meets unique keys in both joins, which adaptive execution can split.

Defined cases: host and path of a null url, and of one without ``://``, are empty; A-Z of a host are lower-cased, and
nothing else is changed; an entry of an empty host fits urls of empty hosts only; a null host or path of an entry is
empty; repeated rows are judged each; null keys are kept; an empty list leaves all urls unlisted, an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm.common import materialize, table

BITS, WORDS, MOST_BLOCKS = 16, 8, 1 << 18
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the registered query.
RULES = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: after the first ``://`` up to a slash, question or number sign; then up to one of the last two."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), F.regexp_extract(text, _URL, 2)


def _hash(host: str, path: str | None = None) -> Column:
    """The 64-bit hash of a listed host, or of a host with a path."""
    return F.xxhash64(F.col(host), F.lit(0)) if path is None else F.xxhash64(F.col(host), F.col(path), F.lit(1))


def _bit(hashed: Column, word: int) -> Column:
    """The bit that a key sets in a word of its block: six bits of a second hash for each word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(hashed), 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def build(entries: DataFrame, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """entries(host, path) -> the filter (block, w0 to w7), one row for each block that isn't empty, and the number of blocks."""
    keys = entries.select(F.explode(F.array(_hash("host"), _hash("host", "path"))).alias("h"))
    blocks = max(1, min(most_blocks, -(-keys.count() * BITS // (64 * WORDS))))
    keys = keys.withColumn("block", F.pmod("h", F.lit(blocks)))
    return keys.groupBy("block").agg(*(F.bit_or(_bit(F.col("h"), i)).alias(f"w{i}") for i in range(WORDS))), blocks


def passing(rows: DataFrame, hashed: Column, bloom: DataFrame, blocks: int) -> DataFrame:
    """The rows whose hash the filter may hold: all that it holds, and a few others."""
    found = rows.withColumn("h", hashed).withColumn("block", F.pmod("h", F.lit(blocks))).join(F.broadcast(bloom), "block")
    every = F.lit(True)
    for i in range(WORDS):
        every = every & (F.col(f"w{i}").bitwiseAND(_bit(F.col("h"), i)) != 0)
    return found.filter(every).select(*rows.columns)


def listed(rules: DataFrame) -> DataFrame:
    """The list, one row an entry, with the number of its host's labels and the length of its path."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rules.select(F.translate(text("host"), _UPPER, _LOWER).alias("host"), text("path").alias("path"), "verdict")
    return rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumns({"labels": F.size(F.split("host", r"\.")), "n": F.length("path")})


def hits(urls: DataFrame, entries: DataFrame, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """urls(host, path) -> the (host, path, rule_host, rule_path) that pass the filter; duplicates collapse before they are shuffled."""
    bloom, blocks = build(entries, most_blocks)
    # Numbers of labels and lengths of paths, each once: not more than the longest entry has characters.
    shape = entries.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("n")).alias("lengths")).first()
    labels, lengths = (F.array(*map(F.lit, x)).cast("array<int>") for x in (shape.labels, shape.lengths))
    parts = F.split("host", r"\.")
    suffix = lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), ".")
    hosts = urls.withColumn("rule_host", F.explode(F.transform(F.filter(labels, lambda k: k <= F.size(parts)), suffix)))
    hosts = passing(hosts, _hash("rule_host"), bloom, blocks)
    begins = F.transform(F.filter(lengths, lambda k: k <= F.length("path")), lambda k: F.substring("path", F.lit(1), k))
    return passing(hosts.withColumn("rule_path", F.explode(begins)), _hash("rule_host", "rule_path"), bloom, blocks).distinct()


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row per row of pages: key, host, path, rule (null if none fits) and verdict. rules: host, path, verdict (block or allow)."""
    host, path = canonical(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    entries = materialize(listed(rules), "url-list")
    found = hits(rows.select("host", "path"), entries, most_blocks)
    exact = entries.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    found = found.join(exact, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule), F.length("rule_host"), rule.alias("rule"), F.col("verdict").alias("verdict"))).alias("best")
    judged = found.groupBy(F.col("host").alias("own_host"), F.col("path").alias("own_path")).agg(best).select("own_host", "own_path", "best.rule", "best.verdict")
    out = rows.join(judged, (F.col("host") == F.col("own_host")) & (F.col("path") == F.col("own_path")), "left")
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM {RULES} AS t(host, path, verdict)"))


SQL = rf"""
WITH p AS (
  SELECT row_number() OVER () AS row, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r AS (SELECT * FROM ({RULES}) AS t(rule_host, rule_path, rule_verdict)),
m AS (SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
        row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) AS k
      FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
