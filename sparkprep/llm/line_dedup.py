"""Line deduplication with a log-template tree.

Lines are parsed to templates by a tree of fixed depth: the first level is the number of tokens, the next
``depth`` levels are the leading tokens, and a leaf holds the lines that share these. Fields are generalised in two
ways. By form: tokens with a digit, an at sign or a slash (numbers, dates, hashes, addresses, links) become one mark
before they choose a branch, if at least FORM tokens and half of the line's are others; a line of fewer (a row of
numbers, a list of links) keeps all its tokens, as nothing else would tell it from other rows. In tokens of scripts
written without spaces, which hold whole sentences, only the digits become one mark, if BYTES other bytes remain. By
comparison within the leaf: of each token it is known how many different lines of the leaf have it at its place. The
constants of a line's template are what most of its tokens have in common with the most lines: at least 1 - FIELDS of
the tokens that are no fields by form. Tokens that at most one VALUES-th as many lines share as the rarest of these are
fields (names, say, which may repeat, as long as their template has that many times more lines). Lines that agree but for such fields are one
template, if at least CONSTANT constants remain and at least VALUES different lines agree in them. All this is counted,
not learned line by line: a shard's lines are compared by pre-aggregated counts over (leaf, place, token), so the
outcome depends neither on the order of lines nor on their partitions. Lines of one template always have equal
constants; a field among the leading ``depth`` tokens is not generalised, as it chooses the leaf.

A template recurs if it is in at least two different documents, wherever it stands in them. Documents are different
unless one is a near copy of the other as a whole: a Jaccard similarity of at least ALIKE over the shingles of SHINGLE
words, estimated from BINS minima of hashes (a standard error of about 0.035 at the threshold, less for short texts). So
what was put into different documents recurs, while the lines of a document that was copied as a whole do not (that is
the business of near-duplicate detection), and neither do lines that one document repeats (a refrain). Of a recurring
template the first line of the document with the smallest id stays, and all other lines are dropped.

Every template has one of its documents as its centre; if any other of its documents is not a near copy of that one,
there are two. Each pair of texts is compared once. Counting is pre-aggregated minima and maxima; the decisions return
to documents by an ordinary join.

Defined cases: a null text stays null; lines without a word character never recur, nor do lines of fewer than ``least`` tokens
(by default all others are counted); a text without recurring lines is unchanged, byte for byte; rows of null id come
after all others in choosing what stays, and rows that repeat an id and a text are one document; an empty table
gives no rows; other columns are passed through, whatever their names (names that begin with ``__sp_`` are reserved).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.common import hash_spans, materialize, mix, shingle_hashes, slices, table, utf8, words

DEPTH = 2
MIN_TOKENS, FORM, BYTES = 1, 2, 12
CONSTANT, FIELDS, VALUES = 4, 0.3, 3
SALTS = 16
SHINGLE, BINS, ALIKE = 5, 128, 0.8
_FIELD = np.zeros(256, np.int64)
_FIELD[[*range(48, 58), ord("@"), ord("/")]] = 1
# Leading bytes of scripts written without spaces, and bytes that only word characters have.
_UNSPACED = np.zeros(256, np.int64)
_UNSPACED[[0xE0, 0xE1, *range(0xE3, 0xEE)]] = 1
_WORD = np.zeros(256, np.int64)
_WORD[[*range(48, 58), *range(97, 123), ord("_"), *range(0xC3, 0xE2), *range(0xE4, 0xED)]] = 1
_WORD_CHARACTER = re.compile(r"\w")
_ANY = np.uint64(0x27D4EB2F165667C5)
_K = np.uint64(0x9E3779B97F4A7C15)
_LINE = ["__sp_key", "__sp_hash", "place", "fresh", "template", "leaf", "base", "tokens", "sketch"]
_PLACE = np.uint64(0xD6E8FEB86659FD93)


def line_offsets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of all lines, lines per row): a row of k line feeds has k + 1 lines; line feeds end their lines."""
    feeds = np.flatnonzero(data == 10) + 1
    per_row = np.diff(np.searchsorted(feeds, off, "right")) + 1
    # A feed at a row's end opens one more, empty line there.
    edges = np.sort(np.concatenate([off[:-1], feeds]), kind="stable")
    return np.append(edges, len(data)), per_row


def sketches(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row of counts words with hashes h, a byte of the least hash of its shingles in each of BINS classes (0: none)."""
    x, each = shingle_hashes(h, counts, SHINGLE)
    out = np.zeros((len(counts), BINS), np.uint32)
    at = np.repeat(np.arange(len(counts)) * BINS, each) + (x % np.uint64(BINS)).astype(np.int64)
    np.maximum.at(out.reshape(-1), at, ~(x >> np.uint64(32)).astype(np.uint32))
    return np.where(out > 0, out % 255 + 1, 0).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity of pairs of sketches."""
    some = ((a > 0) | (b > 0)).sum(1)
    return np.where(some > 0, ((a == b) & (a > 0)).sum(1) / np.maximum(some, 1), 1.0)


def cells(tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each token at its place in the line."""
    with np.errstate(over="ignore"):
        return mix(tokens ^ mix(place.astype(np.uint64) * _PLACE + np.uint64(1)))


def templates(column: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, ...]:
    """(template, leaf, tokens, tokens that are no fields by form, with a word character or not) of each line; the tokens of all
    lines, and which are fields by form; lines of each row; sketch of each row."""
    raw, off = utf8(column)
    lines, per_row = line_offsets(raw, off)
    data, starts, ends, counts = words(raw, lines)
    h = hash_spans(data, starts, ends)
    tokens = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_row)])]
    sketch = sketches(h, np.diff(tokens))
    fields, wide, letters = (np.concatenate([[0], np.cumsum(kind[data])]) for kind in (_FIELD, _UNSPACED, _WORD))
    begin = np.cumsum(counts) - counts
    field, unspaced = fields[ends] > fields[starts], wide[ends] > wide[starts]
    part = np.flatnonzero(field & unspaced & ((ends - starts) - (fields[ends] - fields[starts]) >= BYTES))
    if len(part):
        h[part] = hash_spans(np.where((data >= 48) & (data <= 57), np.uint8(48), data), starts[part], ends[part])
    field &= ~unspaced
    fixed = np.concatenate([[0], np.cumsum(~field)])
    plain = fixed[begin + counts] - fixed[begin]
    h = np.where(field & np.repeat((plain >= FORM) & (2 * plain >= counts), counts), _ANY, h)
    worded = letters[lines[1:]] > letters[lines[:-1]]
    for i in np.flatnonzero(~worded & (counts > 0)):
        worded[i] = _WORD_CHARACTER.search(raw[lines[i] : lines[i + 1]].tobytes().decode(errors="ignore")) is not None
    place = np.arange(len(h)) - np.repeat(begin, counts)
    value = cells(h, place)
    with np.errstate(over="ignore"):
        size = mix(counts.astype(np.uint64) * _K + np.uint64(1))
    return size ^ by_line(value, counts), size ^ by_line(np.where(place < depth, value, np.uint64(0)), counts), counts, plain, worded, h, field, per_row, sketch


def by_line(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The exclusive or of the values of each line."""
    out, some = np.zeros(len(counts), np.uint64), counts > 0
    if len(values):
        out[some] = np.bitwise_xor.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def _places(batches: Iterator[pa.RecordBatch], text: str, depth: int, least: int) -> Iterator[pa.RecordBatch]:
    long = lambda x: pa.array(x.view(np.int64))
    for batch in batches:
        for part in slices(batch, text):
            t, leaf, counts, plain, worded, h, field, per_row, sketch = templates(part.column(text), depth)
            owner = np.repeat(np.arange(part.num_rows), per_row)
            place = np.arange(len(t)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
            use = np.flatnonzero(worded & (counts >= max(1, least)))
            # Within a leaf and a place, 32 bits of a token's hash do; the last one tells fields by form.
            short, stop = (h >> np.uint64(32)).astype(np.uint32) & ~np.uint32(1) | field.astype(np.uint32), np.cumsum(counts)
            base = by_line(cells(short.astype(np.uint64), np.arange(len(h)) - np.repeat(stop - counts, counts)), counts)
            own = [short[e - m : e].tobytes() if p > CONSTANT else None for e, m, p in zip(stop[use].tolist(), counts[use].tolist(), plain[use].tolist(), strict=True)]
            with np.errstate(over="ignore"):
                fresh = np.zeros(len(use), bool)  # the first line of its template in its text
                fresh[np.unique(mix(t[use] ^ (owner[use].astype(np.uint64) * _K)), return_index=True)[1]] = True
            at = pa.array(owner[use])
            yield pa.RecordBatch.from_arrays([part.column("__sp_key").take(at), part.column("__sp_hash").take(at), pa.array(place[use].astype(np.int32)), pa.array(fresh), *(long(x[use]) for x in (t, leaf, base)), pa.array(own, pa.binary()), pa.nulls(len(use), pa.binary())], _LINE)
            size = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("__sp_key"), part.column("__sp_hash"), pa.nulls(size, pa.int32()), pa.nulls(size, pa.bool_()), *[pa.nulls(size, pa.int64())] * 3, pa.nulls(size, pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())], _LINE)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(template, cell, delta) of the tokens that are no fields by form: what their place in the leaf is called, and how the
    line's hash changes if the token is a field."""
    mark = (_ANY >> np.uint64(32)) | np.uint64(1)
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            raw = part.column("tokens")
            counts = np.array([len(x) // 4 for x in raw.to_pylist()], np.int64)
            tokens = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).astype(np.uint64)
            place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
            value, owner = cells(tokens, place), np.repeat(np.arange(len(counts)), counts)
            cell = mix(value ^ part.column("leaf").to_numpy().view(np.uint64)[owner])
            delta = value ^ cells(np.full(len(tokens), mark), place)
            some = tokens & np.uint64(1) == 0
            yield pa.RecordBatch.from_arrays([part.column("template").take(pa.array(owner[some])), pa.array(cell[some].view(np.int64)), pa.array(delta[some].view(np.int64))], ["template", "cell", "delta"])


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(template, delta) from rows sorted by template, one for each of its tokens: how its line's hash changes with its fields. Templates
    without fields, or with too few constants, go."""

    def judged(template: np.ndarray, n: np.ndarray, delta: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(template):
            return
        begin = np.flatnonzero(np.append(True, template[1:] != template[:-1]))
        size = np.diff(np.append(begin, len(template)))
        group = np.repeat(np.arange(len(begin)), size)
        level = n[np.lexsort((n, group))][begin + np.floor(size * FIELDS).astype(np.int64)]
        field = VALUES * n <= level[group]
        fields = np.add.reduceat(field.astype(np.int64), begin)
        some = (fields > 0) & (size - fields >= CONSTANT)
        changed = np.bitwise_xor.reduceat(np.where(field, delta, 0), begin)
        yield pa.RecordBatch.from_arrays([pa.array(template[begin][some]), pa.array(changed[some])], ["template", "delta"])

    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("template", "n", "delta"), strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last template may go on in the next batch
        yield from judged(*(h[:cut] for h in held))
        held = [h[cut:] for h in held]
    yield from judged(*held)


def _generalised(lines: DataFrame) -> DataFrame:
    """(template, named): for the templates that are one but for fields, the name they share."""
    lines = lines.filter("tokens IS NOT NULL")
    # Leaves with one line, or of one document, have nothing to compare.
    open_ = lines.groupBy("leaf").agg(*(f(c).alias(f"{c}{i}") for c in ("template", "__sp_hash") for i, f in enumerate((F.min, F.max))))
    open_ = open_.filter("template0 != template1 AND __sp_hash0 != __sp_hash1").select("leaf")
    # A leaf may hold a large share of all lines: its lines are dealt by document, too.
    salted = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kinds = lines.select("template", "leaf", "base", "tokens", F.pmod("__sp_hash", F.lit(SALTS)).cast("int").alias("salt"))
    kinds = kinds.join(salted, ["leaf", "salt"], "left_semi").groupBy("template").agg(*(F.first(c).alias(c) for c in ("leaf", "base", "tokens")))
    kinds = materialize(kinds.withColumn("salt", F.pmod("template", F.lit(SALTS)).cast("int")), "leaves")
    # A template has VALUES lines at least, and so has its leaf.
    wide = kinds.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= VALUES)
    wide = wide.select("leaf", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    kinds = materialize(kinds.join(wide, ["leaf", "salt"], "left_semi").drop("salt"), "wide-leaves")
    cells = kinds.select("template", "leaf", "tokens").mapInArrow(_cells, "template long, cell long, delta long")
    # Written, so that adaptive execution can split the lines that share a common token.
    shared = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")), "cells")
    seen = cells.join(shared, "cell").select("template", "n", "delta").repartition("template").sortWithinPartitions("template")
    seen = seen.mapInArrow(_fields, "template long, delta long")
    alike = kinds.select("template", "leaf", "base").join(seen, "template")
    alike = materialize(alike.select("template", F.xxhash64("leaf", F.col("base").bitwiseXOR(F.col("delta"))).alias("named")), "alike")
    several = alike.groupBy("named").agg(F.count("*").alias("n")).filter(F.col("n") >= VALUES).select("named")
    return alike.join(several, "named").select("template", "named")


def _unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of texts that are not near copies."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch", "other"))
        yield batch.select(["__sp_hash", "centre"]).filter(pa.array(likeness(a, b) < ALIKE))


def drops(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = MIN_TOKENS) -> DataFrame:
    """(__sp_key, __sp_hash, __sp_places): the lines to drop of the documents that lose any."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__sp_key"), F.xxhash64(text).alias("__sp_hash"), F.col(text).alias("__sp_text")).filter("__sp_text IS NOT NULL")
    schema = f"__sp_key {kind}, __sp_hash long, place int, fresh boolean, template long, leaf long, base long, tokens binary, sketch binary"
    both = materialize(rows.mapInArrow(lambda it: _places(it, "__sp_text", depth, least), schema), "lines")
    lines = both.filter("place IS NOT NULL").drop("sketch")
    named = _generalised(lines)
    lines = lines.select("__sp_key", "__sp_hash", "place", "fresh", "template").join(named, "template", "left")
    # Written, so that the joins shuffle both sides and adaptive execution can split a very common template.
    lines = materialize(lines.select("__sp_key", "__sp_hash", "place", "fresh", F.coalesce("named", "template").alias("template")), "templates")
    document = F.struct(F.col("__sp_key").isNull(), F.col("__sp_key"), F.col("__sp_hash"))
    found = lines.groupBy("template").agg(F.min("__sp_hash").alias("centre"), F.max("__sp_hash").alias("last"), F.min(document).alias("first"))
    found = materialize(found.filter("centre != last"), "repeated")
    asked = lines.select("template", "__sp_hash").join(found.select("template", "centre"), "template").filter("__sp_hash != centre")
    asked = materialize(asked, "asked")
    needed = asked.select("__sp_hash").unionByName(asked.select(F.col("centre").alias("__sp_hash"))).distinct()
    sketches_of = both.filter("sketch IS NOT NULL").groupBy("__sp_hash").agg(F.min("sketch").alias("sketch")).join(needed, "__sp_hash", "left_semi")
    sketches_of = materialize(sketches_of, "sketches")
    pairs = asked.select("__sp_hash", "centre").distinct().join(sketches_of, "__sp_hash")
    pairs = pairs.join(sketches_of.select(F.col("__sp_hash").alias("centre"), F.col("sketch").alias("other")), "centre")
    unlike = materialize(pairs.mapInArrow(_unlike, "__sp_hash long, centre long"), "unlike")
    several = asked.join(unlike, ["__sp_hash", "centre"]).select("template").distinct()
    recurring = materialize(found.join(several, "template", "left_semi").select("template", "first"), "recurring")
    lost = lines.join(recurring, "template").filter(~(document.eqNullSafe(F.col("first")) & F.col("fresh")))
    return lost.groupBy("__sp_key", "__sp_hash").agg(F.collect_set("place").alias("__sp_places"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, least: int = MIN_TOKENS) -> DataFrame:
    """docs with the recurring lines taken out of text, and the number of lines before (__sp_lines) and dropped (__sp_dropped)."""
    lost = drops(docs, key, text, depth, least).withColumnRenamed("__sp_hash", "__sp_h")
    both = docs.withColumn("__sp_hash", F.xxhash64(text)).join(lost, F.col(key).eqNullSafe(F.col("__sp_key")) & (F.col("__sp_hash") == F.col("__sp_h")), "left")
    names = docs.columns
    schema = T.StructType([*docs.schema, T.StructField("__sp_lines", T.LongType()), T.StructField("__sp_dropped", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            for part in slices(batch, text):
                texts, places = part.column(text).to_pylist(), part.column("__sp_places").to_pylist()
                total, gone = [], []
                for i, (x, p) in enumerate(zip(texts, places, strict=True)):
                    total.append(0 if x is None else x.count("\n") + 1)
                    gone.append(len(p or ()))
                    if p:
                        out = set(p)
                        texts[i] = "\n".join(line for j, line in enumerate(x.split("\n")) if j not in out)
                columns = [part.column(c) for c in names]
                columns[at] = pa.array(texts, part.schema.field(text).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], schema.names)

    return both.select(*names, "__sp_places").mapInArrow(cut, schema)


def keep(docs: DataFrame) -> DataFrame:
    """A pipeline stage: documents without their recurring lines; those with nothing left go."""
    cut = dedup(docs).filter("__sp_dropped = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__sp_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("__sp_lines").alias("n_lines"), F.col("__sp_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("text_sha256"))
