"""A quality filter: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is of bytes, order ORDER. A hash of the id deals trusted documents into two folds: the whole texts of all of one
train the model, all of the other set the thresholds, as documents that the model has not seen (the rank of a quantile is right
to a ten-thousandth of their number). Counts are sharded by n-gram; continuation counts, context totals and the probabilities
of each order come from joins of these shards. There are far fewer different n-grams than bytes, so that the finished
probabilities are broadcast while they are MODEL_GRAMS at most, and documents are scored where they are instead of being
shuffled n-gram by n-gram. Of a larger model only the most frequent n-grams are broadcast; the n-grams of documents that are
not among these are sent to the shards of the whole model, whose probabilities come back by joins. Both ways give the same
perplexities.

Every whole document is scored. A document is judged by its perplexity in bits a byte; short texts, whose figures scatter, as if
PRIOR_BYTES bytes of their language's median were added to them. It is rejected above the UPPER quantile of its language's
trusted documents of the second fold, judged alike. A language's own quantiles are used at every size, moved towards the ones
over all languages as if PRIOR_DOCS documents of those were among its trusted documents.

Defined cases: a null or empty text has no perplexity (null) and is judged as median text, hence kept; languages without
trusted documents (and null) use the quantiles over all languages; without any trusted document nothing is
rejected; repeated ids are judged each on their own, and an id is trusted if any of its labels is; an empty
table gives no rows; other columns are passed through (names that begin with ``__sp_`` are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.common import materialize, slices, table, utf8

ORDER = 5
MODEL_GRAMS = 1 << 21
COUNT_BYTES = 4 << 20
SCORE_BYTES = 1 << 20
PRIOR_BYTES = 256
PRIOR_DOCS = 5
UPPER = 0.998
MOST_LANGUAGES = 10_000
_FIB = np.uint64(0x9E3779B97F4A7C15)


def codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of the ORDER bytes that end at each byte, bytes per row). Before a text there are line feeds."""
    sizes = np.diff(off)
    pad = ORDER - 1
    wide = np.full(len(data) + pad * len(sizes), 10, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(sizes) + 1) * pad, sizes)
    wide[at] = data
    code = np.zeros(len(data), np.uint64)
    for i in range(ORDER):
        code = (code << np.uint64(8)) | wide[at - pad + i]
    return code, sizes


def pieces(data: np.ndarray, off: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """codes of some rows, or of a single longer one in pieces of at most that many bytes."""
    if len(off) != 2 or len(data) <= most:
        yield codes(data, off)
        return
    for at in range(0, len(data), most):
        ahead = min(at, ORDER - 1)
        part = data[at - ahead : at + most]
        code = codes(part, np.array([0, len(part)]))[0][ahead:]
        yield code, np.array([len(code)])


def estimate(trusted: DataFrame, text: str = "text") -> list[DataFrame]:
    """For each order a table of its n-grams: g, its count c and probability p, its context h and the back-off weight gamma of that."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, COUNT_BYTES):
                for code, _ in pieces(*utf8(part.column(text)), COUNT_BYTES):
                    g, c = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], ["g", "c"])

    counts = {ORDER: materialize(trusted.select(text).mapInArrow(count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")), "grams")}
    for k in range(ORDER - 1, 0, -1):  # in how many contexts a shorter n-gram continues
        counts[k] = counts[k + 1].groupBy(F.col("g").bitwiseAND((1 << 8 * k) - 1).alias("g")).agg(F.count("*").alias("c"))
    orders: list[DataFrame] = []
    for k in range(1, ORDER + 1):
        n = counts[k].agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
        y = n.n1 / (n.n1 + 2 * n.n2) if n.n1 else 0.5
        d = [max(0.1, min(i - 0.1, i - (i + 1) * y * n[f"n{i + 1}"] / n[f"n{i}"])) if n[f"n{i}"] else 0.5 * i for i in (1, 2, 3)]
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = counts[k].withColumn("h", F.shiftright("g", 8)).withColumn("less", less)
        context = rows.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("less") / F.sum("c")).alias("gamma"))
        p = rows.join(context.hint("merge"), "h").withColumn("own", (F.col("c") - F.col("less")) / F.col("total"))
        if not orders:
            p = p.withColumn("p", F.col("own") + F.col("gamma") / 256)
        else:
            low = orders[-1].select(F.col("g").alias("s"), F.col("p").alias("below"))
            p = p.withColumn("s", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(low.hint("merge"), "s").withColumn("p", F.col("own") + F.col("gamma") * F.col("below"))
        orders.append(materialize(p.select("g", "c", "p", "h", "gamma"), "probabilities"))
    return orders


def _gather(parts: list[DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """A hash table of tables (k, g, x), whose size has been checked."""
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    got = whole.toArrow()
    key = (got.column("g").to_numpy().astype(np.uint64) << np.uint64(3)) | got.column("k").to_numpy().astype(np.uint64)
    return hash_table(key, got.column("x").to_numpy().astype(np.float32))


def _grams(orders: list[DataFrame]) -> list[DataFrame]:
    return [rows.select(F.lit(k).alias("k"), "g", F.log2("p").alias("x")) for k, rows in enumerate(orders, 1)]


def _contexts(orders: list[DataFrame]) -> list[DataFrame]:
    return [rows.select(F.lit(k).alias("k"), F.col("h").alias("g"), F.log2("gamma").alias("x")).distinct() for k, rows in enumerate(orders, 1)]


def gather(orders: list[DataFrame]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Hash tables of the log2 probabilities of n-grams and the log2 back-off weights of contexts."""
    return {"p": _gather(_grams(orders)), "gamma": _gather(_contexts(orders))}


def train(trusted: DataFrame, text: str = "text") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The model of a corpus with few different n-grams, as hash tables."""
    return gather(estimate(trusted, text))


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with linear probing; 0 is never a key (the order is in the low bits)."""
    bits = max(4, (2 * len(keys)).bit_length())
    slots, x = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
    with np.errstate(over="ignore"):
        at = ((keys * _FIB) >> np.uint64(64 - bits)).astype(np.int64)
    left = np.arange(len(keys))
    while len(left):
        _, first = np.unique(at[left], return_index=True)
        mine = left[first]
        mine = mine[slots[at[mine]] == 0]
        slots[at[mine]], x[at[mine]] = keys[mine], values[mine]
        left = np.setdiff1d(left, mine)
        at[left] = (at[left] + 1) & ((1 << bits) - 1)
    return slots, x


def find(model: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, values)."""
    slots, x = model
    bits = len(slots).bit_length() - 1
    with np.errstate(over="ignore"):
        at = ((keys * _FIB) >> np.uint64(64 - bits)).astype(np.int64)
    there = slots[at]
    hit = there == keys
    out = np.where(hit, x[at], np.float32(0))
    left = np.flatnonzero(~hit & (there != 0))
    while len(left):
        at[left] = (at[left] + 1) & (len(slots) - 1)
        there = slots[at[left]]
        got = there == keys[left]
        hit[left[got]] = True
        out[left[got]] = x[at[left[got]]]
        left = left[~got & (there != 0)]
    return hit, out


def bits(model: dict, code: np.ndarray) -> np.ndarray:
    """-log2 of the model's probability of each byte."""
    out = np.zeros(len(code), np.float32)
    left = np.arange(len(code))
    for k in range(ORDER, 0, -1):
        own = code[left] & np.uint64((1 << 8 * k) - 1)
        hit, x = find(model["p"], (own << np.uint64(3)) | np.uint64(k))
        out[left] -= x
        left, own = left[~hit], own[~hit]
        if not len(left):
            return out
        out[left] -= find(model["gamma"], (own >> np.uint64(8) << np.uint64(3)) | np.uint64(k))[1]
    out[left] += np.float32(8)
    return out


def _sums(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    stop = np.cumsum(sizes)
    return total[stop] - total[stop - sizes]


def score(docs: DataFrame, orders: list[DataFrame], names: list[str], text: str = "text") -> DataFrame:
    """The columns names of docs, with __sp_bytes and __sp_bits of each text; written."""
    known = sum(rows.count() for rows in orders)
    docs = docs.select(*dict.fromkeys([*names, text]))
    scored = _score_in_place(docs, gather(orders), text) if known <= MODEL_GRAMS else _score_in_shards(docs, orders, names, text)
    return materialize(scored.select(*names, "__sp_bytes", "__sp_bits"), "scores")


def _score_in_place(docs: DataFrame, model: dict, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SCORE_BYTES):
                data, off = utf8(part.column(text))
                total = sum(_sums(bits(sent.value, code), sizes) for code, sizes in pieces(data, off, SCORE_BYTES))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(off)), pa.array(total)], [*part.schema.names, "__sp_bytes", "__sp_bits"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("__sp_bytes", T.LongType()), T.StructField("__sp_bits", T.DoubleType())]))


def _score_in_shards(docs: DataFrame, orders: list[DataFrame], names: list[str], text: str) -> DataFrame:
    """The most frequent n-grams are looked up where the documents are; the others go to the shards of the model."""
    # The counts that are frequent: as many powers of two from above as MODEL_GRAMS n-grams reach.
    powers = orders[-1].groupBy(F.floor(F.log2("c")).alias("power")).agg(F.count("*").alias("n")).orderBy(F.desc("power")).collect()  # 63 rows at most
    least, n = 64, 0
    for r in powers:
        n += r["n"]
        if n > MODEL_GRAMS:
            break
        least = r["power"]
    frequent = orders[-1].filter(F.floor(F.log2("c")) >= least).select(F.lit(ORDER).alias("k"), "g", F.log2("p").alias("x"))
    sent = docs.sparkSession.sparkContext.broadcast(_gather([frequent]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SCORE_BYTES):
                data, off = utf8(part.column(text))
                for i, (code, sizes) in enumerate(pieces(data, off, SCORE_BYTES)):  # later pieces carry the row number alone
                    hit, x = find(sent.value, (code << np.uint64(3)) | np.uint64(ORDER))
                    rest = np.concatenate([[0], np.cumsum(~hit)])[np.concatenate([[0], np.cumsum(sizes)])]
                    rest = pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(code[~hit].astype(np.int64)))
                    own = [part.column(c) if not i or c == "__sp_row" else pa.nulls(part.num_rows, part.column(c).type) for c in [*names, "__sp_row"]]
                    piece = pa.array(np.full(part.num_rows, i, np.int32))
                    yield pa.RecordBatch.from_arrays([*own, piece, pa.array(np.diff(off)), pa.array(_sums(-x, sizes)), rest], [*names, "__sp_row", "__sp_piece", "__sp_bytes", "__sp_bits", "__sp_rest"])

    more = [("__sp_row", T.LongType()), ("__sp_piece", T.IntegerType()), ("__sp_bytes", T.LongType()), ("__sp_bits", T.DoubleType()), ("__sp_rest", T.ArrayType(T.LongType()))]
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in names), *(T.StructField(*f) for f in more)])
    # Row numbers are not stable, but they are written together with what they number.
    begun = materialize(docs.withColumn("__sp_row", F.monotonically_increasing_id()).mapInArrow(run, schema), "begun")
    rest = begun.select("__sp_row", F.explode("__sp_rest").alias("g")).groupBy("__sp_row", "g").agg(F.count("*").alias("__sp_n"))
    cost = _costs(rest.select("g").distinct(), orders)
    found = rest.join(cost.hint("merge"), "g").select("__sp_row", (F.col("__sp_n") * F.col("cost")).alias("__sp_more"))
    found = found.unionByName(begun.filter("__sp_piece > 0").select("__sp_row", F.col("__sp_bits").alias("__sp_more")))
    found = found.groupBy("__sp_row").agg(F.sum("__sp_more").alias("__sp_more"))
    whole = begun.filter("__sp_piece = 0").drop("__sp_rest", "__sp_piece").join(found.hint("merge"), "__sp_row", "left")
    return whole.withColumn("__sp_bits", F.col("__sp_bits") + F.coalesce("__sp_more", F.lit(0.0)))


def _costs(keys: DataFrame, orders: list[DataFrame]) -> DataFrame:
    """(g, cost): -log2 of the probability of the last byte of each n-gram of keys. What is not known asks for its shorter n-gram, once."""
    k = len(orders)
    if not k:
        return keys.withColumn("cost", F.lit(8.0))
    own = _grams(orders)[-1].select("g", (-F.col("x").cast("float")).cast("double").alias("cost"))
    asked = materialize(keys.join(own.hint("merge"), "g", "left"), "asked")
    left = asked.filter("cost IS NULL").select("g", F.shiftright("g", 8).alias("h"), F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1).alias("s"))
    weight = _contexts(orders)[-1].select(F.col("g").alias("h"), (-F.col("x").cast("float")).cast("double").alias("weight"))
    below = _costs(left.select(F.col("s").alias("g")).distinct(), orders[:-1]).withColumnsRenamed({"g": "s", "cost": "below"})
    backed = left.join(weight.hint("merge"), "h", "left").join(below.hint("merge"), "s").select("g", (F.coalesce("weight", F.lit(0.0)) + F.col("below")).alias("cost"))
    return asked.filter("cost IS NOT NULL").unionByName(backed)


def _judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", extra: list[str] | None = None) -> DataFrame:
    """The columns key, lang and extra, with __sp_raw, __sp_value, __sp_threshold and __sp_kept."""
    names = list(dict.fromkeys([key, lang, *(extra or [])]))
    trusted = labels.select(F.col(key).alias("__sp_key")).distinct()
    first = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(2)) == 0  # the fold that trains; the other is left for the thresholds
    # Ids against ids and texts: the same plan at every size, and texts are not sorted.
    texts = docs.filter((F.octet_length(text) > 0) & first).select(key, text).join(trusted.hint("shuffle_hash"), F.col(key) == F.col("__sp_key"), "left_semi")
    scored = score(docs, estimate(texts, text), names, text)
    # Thresholds are from all trusted documents that the model has not seen.
    of = scored.filter(~first & (F.col("__sp_bytes") > 0)).select(F.col(key), F.col(lang).alias("__sp_lang"), "__sp_bytes", "__sp_bits")
    of = materialize(of.join(trusted, F.col(key) == F.col("__sp_key"), "left_semi").select("__sp_lang", "__sp_bytes", "__sp_bits"), "unseen")
    langs = _small(of.groupBy("__sp_lang").agg(F.count("*").alias("__sp_n")).filter("__sp_lang IS NOT NULL"))
    quantile = lambda x, q: F.percentile_approx(x, F.lit(q), F.lit(10000)).alias("__sp_q")

    def by_language(x, q: float, name: str) -> tuple[DataFrame, float | None]:
        """(language, its quantile moved towards that over all), and the latter."""
        overall = of_now.agg(quantile(x, q)).first()[0]
        own = of_now.filter("__sp_lang IS NOT NULL").groupBy("__sp_lang").agg(quantile(x, q)).join(langs, "__sp_lang")
        moved = (F.col("__sp_n") * F.col("__sp_q") + PRIOR_DOCS * F.lit(overall)) / (F.col("__sp_n") + PRIOR_DOCS)
        return _small(own.select(F.col("__sp_lang").alias("__sp_l"), moved.alias(name))), overall

    def attach(rows: DataFrame, by: DataFrame, column: str, name: str, other: float) -> DataFrame:
        return rows.join(by, F.col(column) == F.col("__sp_l"), "left").drop("__sp_l").withColumn(name, F.coalesce(name, F.lit(other)))

    padded = (F.col("__sp_bits") + PRIOR_BYTES * F.col("__sp_median")) / (F.col("__sp_bytes") + PRIOR_BYTES)
    of_now = of
    medians, median = by_language(F.col("__sp_bits") / F.col("__sp_bytes"), 0.5, "__sp_median")
    median = 0.0 if median is None else median
    of_now = attach(of, medians, "__sp_lang", "__sp_median", median)
    limits, limit = by_language(padded, UPPER, "__sp_threshold")
    rows = attach(scored, medians, lang, "__sp_median", median)
    rows = attach(rows, limits, lang, "__sp_threshold", float("inf") if limit is None else limit)
    rows = rows.withColumn("__sp_value", padded).withColumn("__sp_raw", F.try_divide("__sp_bits", "__sp_bytes"))
    return rows.withColumn("__sp_kept", F.col("__sp_value") <= F.col("__sp_threshold")).select(*names, "__sp_raw", "__sp_value", "__sp_threshold", "__sp_kept")


def _small(rows: DataFrame) -> DataFrame:
    """A table of one row a language, broadcast if it is as small as that should be."""
    few = rows.limit(MOST_LANGUAGES + 1).collect()
    return F.broadcast(rows.sparkSession.createDataFrame(few, rows.schema)) if len(few) <= MOST_LANGUAGES else rows  # a checked size


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", extra: list[str] | None = None) -> DataFrame:
    """docs (the columns key, lang and extra) with bits_per_byte (raw), judged (what is compared), threshold and kept. labels: (key) of trusted documents."""
    judged = _judge(docs, labels, key, text, lang, extra)
    return judged.withColumnsRenamed({"__sp_raw": "bits_per_byte", "__sp_value": "judged", "__sp_threshold": "threshold", "__sp_kept": "kept"})


def trusted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select("doc_id")


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: the documents that are not rejected."""
    judged = _judge(docs, trusted_labels(spark, sf_dir), extra=docs.columns)
    return judged.filter("__sp_kept").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), trusted_labels(spark, sf_dir))
