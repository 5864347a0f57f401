"""How the sources of a language differ in their words: a two-pass vocabulary automaton and sparse postings.

Pass one counts exactly in how many documents of a language each term stands; terms in at least ``least`` documents are
kept. Pass two walks every text, each run of other bytes as one delimiter, through an Aho-Corasick automaton of the kept
terms, each padded with the delimiter on both sides: neighbours share the delimiter between them, so every whole term
is found and no part of a longer one. Both passes count within the task in tables of at most HELD entries before anything
is shuffled.

The automaton is broadcast while the kept terms of all languages have at most PART bytes (some 16 times that in memory).
A larger vocabulary is dealt by a hash to as many shards as it takes; terms of the texts, counted within the task, are
sent to the shard that they belong to, each shard walks them through its own automaton, and nothing is broadcast. Both ways give
the same counts. Kept terms above LONG bytes are not put into an automaton; their occurrences are looked up by themselves.

Shares are exact integers: p = 1 + floor(SCALE (count + 1) / (N + V)). A group's divergence from another one sums
f(p, q) = floor((p - q)^2 / q) over all kept terms of the language. Postings of (term, source, p) are dealt by blocks of terms, which
hold more postings than a language has pairs of sources; a task works through them in chunks, one source against all postings of the chunk at a time, adds the terms that the
other source lacks from the counts of equal shares, and the terms that both lack by their number. So it takes postings x
sources steps, not terms x sources^2, and passes on one number for each pair of sources.

Defined cases: null texts, languages and sources are empty; a group without terms is listed, a language without kept
terms has pairs of value 0; rows that repeat count each; terms of any length and texts of any length are counted whole,
texts in pieces; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkprep.llm.common import materialize, partitions, table

SCALE, LEAST, TOP = 1_000_000_000, 3, 200
HELD, PART, LONG, PIECE, CHUNK, BLOCK = 400_000, 16 << 20, 256, 1 << 20, 1 << 19, 1 << 15
#: Letters A-Z in lower case, other letters and bytes above 127 as they are, all else one delimiter.
_TERMS = bytes((x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x > 127 else 32) for x in range(256))
_LONG = re.compile(rb"[^ ]{%d,}" % (LONG + 1))
_automaton: dict[str, tuple] = {}


def pieces(text: pa.Scalar) -> Iterator[bytes]:
    """A text with its terms between single delimiters or runs of them, in pieces that cut no term."""
    if not text.is_valid:
        return
    raw = memoryview(text.as_buffer())
    at = 0
    while at < len(raw):
        end, part = at + PIECE, bytes(raw[at : at + PIECE]).translate(_TERMS)
        while end < len(raw) and part[-1] != 32:  # as far as the next delimiter
            more = bytes(raw[end : end + PIECE]).translate(_TERMS)
            cut = more.find(b" ") + 1 or len(more)
            part, end = part + more[:cut], end + cut
        yield part
        at = end


class Held:
    """Counts by group and term, given out when they exceed HELD entries."""

    def __init__(self):
        self.by: dict[tuple, Counter] = {}
        self.added = 0

    def add(self, group: tuple, terms, size: int) -> bool:
        """Whether it is time to give them out."""
        self.by.setdefault(group, Counter()).update(terms)
        self.added += size
        if self.added < HELD:
            return False
        self.added = sum(map(len, self.by.values()))
        return self.added >= HELD

    def take(self) -> dict[tuple, Counter]:
        out, self.by, self.added = self.by, {}, 0
        return out


def _rows(held: dict[tuple, Counter], names: list[str], terms) -> Iterator[pa.RecordBatch]:
    """Rows of (group..., term, n); terms turns keys into an array of terms."""
    for group, counts in held.items():
        if counts:
            n = pa.array(counts.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array([g] * len(n), pa.string()) for g in group), terms(list(counts)), n], [*names, "term", "n"])


def _texts(terms: list[bytes]) -> pa.Array:
    return pa.array(terms, pa.binary()).cast(pa.string())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): in how many documents a term stands."""
    held = Held()
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i in sorted(range(len(langs)), key=langs.__getitem__):  # neighbours use the same table
            own: set[bytes] = set()
            for part in pieces(batch.column("text")[i]):
                own.update(part.split())
            if held.add((langs[i],), own, len(own)):
                yield from _rows(held.take(), ["lang"], _texts)
    yield from _rows(held.take(), ["lang"], _texts)


def automaton(terms: list[bytes]):
    """Kept terms, padded with the delimiter, with their numbers. The most frequent first, so that their nodes lie together."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, x in enumerate(terms):
        if len(x) <= LONG:
            out.add_word(f" {x.decode('latin-1')} ", i)
    out.make_automaton()
    return out


def occurrences(found, long: dict[bytes, int], part: bytes) -> Iterator[int]:
    """The numbers of the kept terms in a piece of text, once for each occurrence."""
    met = map(itemgetter(1), found.iter(f" {part.decode('latin-1')} ")) if len(found) else ()
    if long and _LONG.search(part):
        met = chain(met, (long[x] for x in _LONG.findall(part) if x in long))
    return iter(met)


class Tally:
    """Counts of numbers by group, in arrays: what was met is sorted and counted when there are HELD numbers."""

    def __init__(self):
        self.met: dict[tuple, list[np.ndarray]] = {}
        self.sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        self.waiting = 0

    def add(self, group: tuple, numbers: np.ndarray) -> bool:
        """Whether it is time to give the counts out."""
        self.met.setdefault(group, []).append(numbers)
        self.waiting += len(numbers)
        if self.waiting < 10 * HELD:
            return False
        self.settle()
        return sum(len(x) for x, _ in self.sums.values()) >= 4 * HELD

    def settle(self) -> None:
        for group, arrays in self.met.items():
            number, n = np.unique(np.concatenate(arrays), return_counts=True)
            if group in self.sums:
                old, more = self.sums[group]
                number, at = np.unique(np.concatenate([old, number]), return_inverse=True)
                both, n = np.concatenate([more, n]), np.zeros(len(number), np.int64)
                np.add.at(n, at, both)
            self.sums[group] = number, n
        self.met, self.waiting = {}, 0

    def take(self) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
        self.settle()
        out, self.sums = self.sums, {}
        return out


def _recount(sent: Broadcast):
    """(lang, source, term, n): occurrences of the broadcast terms."""

    name = uuid.uuid4().hex  # a worker that runs several tasks builds one automaton

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _automaton:
            _automaton.clear()
            terms = sent.value.split()
            _automaton[name] = automaton(terms), {x: i for i, x in enumerate(terms) if len(x) > LONG}, _texts(terms)
        found, long, names = _automaton[name]
        held = Tally()

        def give() -> Iterator[pa.RecordBatch]:
            for group, (number, n) in held.take().items():
                yield pa.RecordBatch.from_arrays([*(pa.array([g] * len(n), pa.string()) for g in group), names.take(pa.array(number)), pa.array(n, pa.int64())], ["lang", "source", "term", "n"])

        for batch in batches:
            groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            for i in sorted(range(len(groups)), key=groups.__getitem__):
                for part in pieces(batch.column("text")[i]):
                    if held.add(groups[i], np.fromiter(occurrences(found, long, part), np.int32)):
                        yield from give()
        yield from give()

    return run


def _shard(terms: list[bytes], shards: int) -> np.ndarray:
    """The shard of each term: CRC-32, which Spark has, too."""
    return np.fromiter((zlib.crc32(x) % shards for x in terms), np.int64, len(terms))


def _route(shards: int):
    """(shard, lang, source, terms, counts): the terms of the task's texts, for the shards that they belong to."""

    def give(held: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            terms, n = list(counts), np.fromiter(counts.values(), "<i8", len(counts))
            at = _shard(terms, shards)
            order = np.argsort(at, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else ():
                row = (int(at[part[0]]), lang, source, b" ".join(terms[i] for i in part), n[part].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["shard", "lang", "source", "terms", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for group, text in zip(groups, batch.column("text"), strict=True):
                for part in pieces(text):
                    words = part.split()
                    if held.add(group, words, len(words)):
                        yield from give(held.take())
        yield from give(held.take())

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards one after the other: first the rows of their vocabulary (without a source), then what was sent to them."""
    shard, terms, found, long = None, [], None, {}
    for batch in batches:
        for s, lang, source, words, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "lang", "source", "terms", "counts")), strict=True):
            if s != shard:
                shard, terms, found = s, [], None
            if source is None:
                terms.append(words)
                continue
            if found is None:
                found, long = automaton(terms), {x: i for i, x in enumerate(terms) if len(x) > LONG}
            n, own = np.frombuffer(counts, "<i8"), words.split()
            ends = {e: k for k, e in enumerate(np.cumsum([len(x) + 1 for x in own]).tolist())}  # where a term's delimiter is
            met = list(found.iter(f" {words.decode('latin-1')} ")) if len(found) else []
            keys, sums = [terms[i] for _, i in met], [int(n[ends[e]]) for e, _ in met]
            for k, x in enumerate(own) if long else ():
                if x in long:
                    keys.append(x)
                    sums.append(int(n[k]))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([source] * len(keys), pa.string()), _texts(keys), pa.array(sums, pa.int64())], ["lang", "source", "term", "n"])


def _documents(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))))


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, docs): the terms in at least so many documents of a language. docs: text, lang."""
    found = docs.select("text", "lang").mapInArrow(_frequencies, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= least)


def recount(docs: DataFrame, kept: DataFrame, part: int | None = None) -> DataFrame:
    """(lang, source, term, n): occurrences of the kept terms of each language in each of its groups. docs: text, lang, source."""
    spark, schema = docs.sparkSession, "lang string, source string, term string, n long"
    part = PART if part is None else part
    terms = kept.groupBy("term").agg(F.sum("docs").alias("docs"))
    size = terms.agg(F.sum(F.octet_length("term") + 1).alias("size")).first()["size"] or 0
    if size <= part:
        names = terms.orderBy(F.desc("docs"), "term").select(F.col("term").cast("binary").alias("term")).toArrow().column("term").to_pylist()
        counts = docs.mapInArrow(_recount(spark.sparkContext.broadcast(b" ".join(names))), schema)
    else:
        shards = max(math.ceil(size / part), partitions(spark))
        own = terms.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(shards)).alias("shard"), F.lit("").alias("lang"), F.lit(None).cast("string").alias("source"), F.col("term").cast("binary").alias("terms"), F.lit(b"").alias("counts"))
        sent = docs.mapInArrow(_route(shards), "shard long, lang string, source string, terms binary, counts binary")
        both = own.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", F.col("source").isNotNull())
        counts = both.mapInArrow(_walk, schema)
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n")


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count, exact at any size."""
    return (F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)")) + 1).cast("long")


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): sums over blocks of terms. Of each block and language, first come its sources (without a term, p
    of count 0), then its postings by term."""
    at, sources, zero = None, [], []
    code: dict[str, int] = {}
    held: list[tuple[int, int, int]] = []
    term, n_terms, last = None, -1, None

    def give() -> Iterator[pa.RecordBatch]:
        if held:
            value = divergences(np.array(held, np.int64), n_terms + 1, np.array(zero, np.int64))
            own, other = np.nonzero(~np.eye(len(sources), dtype=bool))
            names = pa.array(sources, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([at[1]] * len(own), pa.string()), names.take(pa.array(own)), names.take(pa.array(other)), pa.array(value[own, other])], ["lang", "source", "item", "value"])

    for batch in batches:
        for block, lang, term, source, p in zip(*(batch.column(c).to_pylist() for c in ("block", "lang", "term", "source", "p")), strict=True):
            if (block, lang) != at:
                yield from give()
                at, sources, zero, code, held, n_terms, last = (block, lang), [], [], {}, [], -1, None
            if term is None:
                code[source] = len(sources)
                sources.append(source)
                zero.append(p)
                continue
            if term != last:
                if len(held) >= CHUNK:
                    yield from give()
                    held, n_terms = [], -1
                n_terms, last = n_terms + 1, term
            held.append((n_terms, code[source], p))
    yield from give()


def divergences(postings: np.ndarray, n_terms: int, zero: np.ndarray) -> np.ndarray:
    """value[a, b]: the sum of f(p of a, p of b) over n_terms terms. postings: (term, source, p) of counts above 0; zero: p of count 0."""
    n = len(zero)
    postings = postings[np.argsort(postings[:, 1], kind="stable")]
    term, source, p = postings.T
    begin = np.searchsorted(source, np.arange(n + 1))
    some = np.flatnonzero(np.diff(begin))
    sizes, value = np.diff(begin), np.zeros((n, n), np.int64)

    def by_source(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[some] = np.add.reduceat(x, begin[some])
        return out

    for a in range(n):
        mine = slice(begin[a], begin[a + 1])
        row, has = np.full(n_terms, zero[a]), np.zeros(n_terms, bool)
        row[term[mine]], has[term[mine]] = p[mine], True
        here, both = row[term], has[term]
        theirs = by_source((here - p) ** 2 // p)  # terms that b has
        shared = zero[source]
        common = by_source(np.where(both, (here - shared) ** 2 // shared, 0))
        kinds, times = np.unique(p[mine], return_counts=True)  # terms that a has, and b not
        alone = np.array([((kinds - z) ** 2 // z * times).sum() for z in zero], np.int64) - common
        neither = (n_terms - sizes[a] - sizes + by_source(both.astype(np.int64))) * ((zero[a] - zero) ** 2 // zero)
        value[a] = theirs + alone + neither
    return value


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source", part: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each other source of its language is from a source (part pair), and the top
    terms that a source has more of than its language (part term)."""
    docs = _documents(docs, text, lang, source)
    kept = materialize(vocabulary(docs, least), "vocabulary")
    counts = materialize(recount(docs, kept, part), "counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms"])
    groups = materialize(groups, "groups")
    placed = materialize(counts.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "postings")

    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    q = placed.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    value = F.expr("(p - q) * (p - q) div q")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = placed.join(q, ["lang", "term"]).filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)

    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, placed.count() // max(BLOCK, most * most))
    postings = placed.select(F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "lang", "term", "source", "p")
    known = groups.filter("terms > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "lang", F.lit(None).cast("string").alias("term"), "source", share(F.lit(0), F.col("total"), F.col("terms")).alias("p"))
    dealt = postings.unionByName(known).repartition(blocks, "block", "lang").sortWithinPartitions("block", "lang", F.col("term").asc_nulls_first())
    sums = dealt.mapInArrow(_pair_sums, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # A row for each pair is what is asked for.
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(first)).unionByName(terms)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
full_counts AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT f.*, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + v.v))::HUGEINT AS p FROM full_counts f JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM p GROUP BY lang, term),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + v.v))::HUGEINT AS q FROM l JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
