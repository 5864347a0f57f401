"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of code points into a fixed number of hash slots per language; every task
adds up its own dense table, and tables are summed by slot range. The log-probability matrix has
languages x slots entries whatever the corpus size, so it is broadcast; there are SLOTS slots, and fewer (a power of two) where
there are so many labels that the matrix would have more than ENTRIES entries. Scoring gathers, for the
n-grams that occur, their rows of the matrix and sums them per text.

Defined cases: a null text or one without a letter is ``und`` with score 0; if nothing can be learned
(no labelled text, empty table) every text is ``und`` with score 0; ties go to the smaller language;
null labels are not learned from; more labels than ENTRIES / FEWEST are refused before anything is counted; texts of any length are read whole, those of more than LONG code points in overlapping pieces;
rows that repeat an id, and rows of null id, are predicted each on their own; other columns are passed through if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm.common import crc_mod, partitions, slices, table, utf8

SLOTS = 1 << 16
ENTRIES, FEWEST = 1 << 24, 1 << 8
LONG = 1 << 20
ORDERS = (1, 2, 3)
RANGES = 16
_LETTER = np.zeros(128, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def grams(column: pa.Array, width: int = SLOTS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(slots by order, code points per row, has a letter). A slot stands where its n-gram starts; n-grams over a row's end are -1."""
    texts = ["" if x is None else x.lower() for x in column.to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    plain = points < 128
    letter = np.zeros(len(points), bool)
    letter[plain] = _LETTER[points[plain]]
    if not plain.all():
        other, back = np.unique(points[~plain], return_inverse=True)
        letter[~plain] = np.array([chr(c).isalpha() for c in other])[back]
    total = np.concatenate([[0], np.cumsum(letter)])
    lettered = total[ends] > total[ends - sizes]
    found = []
    with np.errstate(over="ignore"):
        acc = np.zeros(len(points), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(points) >= n:
                acc[: len(points) - n + 1] = (acc[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(0x01000193) + np.uint32(n)
            if n in ORDERS:
                h = acc ^ (acc >> np.uint32(15))
                h *= np.uint32(0x85EBCA6B)
                slot = (h >> np.uint32(16)).astype(np.int64) % width
                for back in range(1, n):
                    at = ends[sizes >= back] - back
                    slot[at] = -1
                found.append(slot)
    return found, sizes, lettered


def pieces(part: pa.RecordBatch, width: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """grams() of a slice; a single long text comes piece by piece, each n-gram in the piece that it starts in."""
    text = part.column("text")[0].as_py() if part.num_rows == 1 else None
    if text is None or len(text) <= LONG:
        yield grams(part.column("text"), width)
        return
    text, more = text.lower(), max(ORDERS) - 1
    for at in range(0, len(text), LONG):
        slots, sizes, lettered = grams(pa.array([text[at : at + LONG + more]], pa.large_string()), width)
        for s in slots:
            s[LONG:] = -1
        yield slots, sizes, lettered


def _count(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").to_pylist()
            code = {x: i for i, x in enumerate(sorted(set(langs)))}
            own = np.array([code[x] for x in langs], np.int64)
            each = np.zeros((len(code), width), np.int64)
            for slots, sizes, _ in pieces(part, width):
                row = np.repeat(own, sizes) * width
                for s in slots:
                    good = s >= 0
                    each += np.bincount(row[good] + s[good], minlength=each.size).reshape(each.shape)
            for x, i in code.items():
                sums[x] = sums[x] + each[i] if x in sums else each[i]
                docs[x] = docs.get(x, 0) + int((own == i).sum())
    wide = width // RANGES
    out = [(x, r, docs[x] if r == 0 else 0, v[r * wide : (r + 1) * wide].tobytes()) for x, v in sums.items() for r in range(RANGES)]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["lang", "part", "docs", "counts"])


def _add(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple, list] = {}
    for batch in batches:
        for x, r, n, c in zip(*[col.to_pylist() for col in batch.columns], strict=True):
            got = sums.setdefault((x, r), [0, np.zeros(width // RANGES, np.int64)])
            got[0] += n
            got[1] += np.frombuffer(c, np.int64)
    if sums:
        rows = [(x, r, n, v.tobytes()) for (x, r), (n, v) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["lang", "part", "docs", "counts"])


_TABLE = "lang string, part int, docs long, counts binary"


def train(labelled: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """labelled(text, lang) -> (languages, matrix of slots x languages; the last row holds the priors)."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(ENTRIES // FEWEST + 1).collect())
    if len(langs) > ENTRIES // FEWEST:
        raise ValueError(f"more than {ENTRIES // FEWEST} labels: they are no languages")
    width = SLOTS
    while width > FEWEST and width * len(langs) > ENTRIES:
        width //= 2
    parts = rows.mapInArrow(lambda it: _count(it, width), _TABLE)
    # Two levels of sums keep the number of tables that one task adds up small.
    found = parts.repartition(partitions(labelled.sparkSession), "lang", "part").mapInArrow(lambda it: _add(it, width), _TABLE).toLocalIterator()
    counts, docs, code = np.zeros((len(langs), width)), np.zeros(len(langs)), {x: i for i, x in enumerate(langs)}
    for r in found:
        i, wide = code[r.lang], width // RANGES
        counts[i, r.part * wide : (r.part + 1) * wide] += np.frombuffer(r.counts, np.int64)
        docs[i] += r.docs
    if not langs:
        return [], np.zeros((width + 1, 0), np.float32)
    logp = np.log(counts + smoothing) - np.log(counts.sum(1, keepdims=True) + smoothing * width)
    prior = np.log(docs) - np.log(docs.sum())
    return langs, np.vstack([logp.T, prior[None, :]]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """The columns in keep, lang_pred and score (the posterior of lang_pred). Only text is read for the prediction."""
    langs, matrix = model
    width = len(matrix) - 1
    sent = docs.sparkSession.sparkContext.broadcast(matrix)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sums, lettered = np.zeros((part.num_rows, len(langs))), np.zeros(part.num_rows, bool)
                for slots, sizes, letters in pieces(part, width):
                    lettered |= letters
                    some = np.flatnonzero(sizes > 0)
                    begin = (np.cumsum(sizes) - sizes)[some]
                    for s in slots if langs and len(some) else []:
                        good, at = s >= 0, np.where(s >= 0, s, 0)
                        for j in range(len(langs)):
                            sums[some, j] += np.add.reduceat(np.where(good, m[:width, j][at], np.float32(0)), begin, dtype=np.float64)
                if langs:
                    sums += m[width]
                    best = sums.argmax(1)
                    odds = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                    pred = [langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                    odds = np.where(lettered, odds, 0.0)
                else:
                    pred, odds = ["und"] * part.num_rows, np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(odds)], [*keep, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod("doc_id", 3) == 1).alias("held_out"))
    model = train(docs.filter(~F.col("held_out")))
    return predict(docs, model, ["doc_id", "held_out"])
