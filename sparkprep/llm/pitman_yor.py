"""Language-model scoring with a hierarchical Pitman-Yor model of word trigrams.

Every pair of words (a, b) has a restaurant whose dishes are the words that follow it; its parent is the restaurant
of b, whose customers are the tables of its children; the parent of these is one restaurant over words, shared by all,
with a uniform base. Training has four sharded steps:

1. Words are counted.
2. The pairs (b, w) of the training documents go to shards by b, and a first seating of the restaurants of b gives the
   tables that each word has in them: these are the customers of the shared restaurant, which is seated in turn.
3. The trigrams of all documents go to shards by b, so that a restaurant of b is together with all its children (a, b). A
   context b of very many tokens is divided into parts by a hash of the word, with p(w | a, b) = p(part | b) *
   p(w | a, b, part), so no shard holds an unbounded share.
4. In its shard, restaurants are seated by Gibbs sweeps, children and parents in turn: all customers of a dish leave and
   take seats again, given the tables of all other dishes and the parent; the
   parent's customers are then its children's tables. Predictive probabilities, averaged over the sweeps after the
   first BURN, score the tokens; sums per document return.

A dish's tables are drawn from their conditional distribution (with generalised Stirling numbers), given those of the other
dishes and the parent without them; those of all dishes of a restaurant are drawn at once, given the tables of the sweep
before, where a plain sampler would see each other's new tables. Random numbers are seeded by what a shard holds, and shards depend
on the number of tokens alone, so scores depend neither on the layout of partitions nor on settings.

What is broadcast is bounded: the at most ``TOP`` most frequent words with their parent probabilities, and the divided
contexts (at most the number of shards). Words are told apart by 64-bit hashes. The shards ask for the probabilities of all
rarer words: requests are joined with the counted words by ranges of the word's hash, and each shard is sent the
words that it has.

Defined cases: a null or empty text is the end token alone; a word unknown in training gets the base's
share; without any training token all probabilities are 1 (scores 0); repeated ids are scored each on
their own, null ids, too; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.common import crc_mod, hash_spans, materialize, mix, partitions, slices, table, utf8, words

TOP = 1 << 20
CHUNK, CHUNK_ROWS = 1 << 20, 1 << 15
SHARD = 1_000_000
BITS = 10  # words are dealt to 1 << BITS buckets
BURN, SWEEPS = 3, 4
MOST = 128
STRENGTH, PARENT_STRENGTH, PART_STRENGTH = 1.0, 10.0, 100.0
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RARE = np.uint32(1 << 31)
_LOW = np.uint64(0xFFFFFFFF)


def stirling(most: int, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: in how many weighted ways c customers sit at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most + 1):
            out[c, 1:] = np.logaddexp(out[c - 1, :-1], np.where(t[1:] < c, np.log(np.maximum(c - 1 - d * t[1:], 0)) + out[c - 1, 1:], -np.inf))
    return out


def _sequence(c: np.ndarray, a: np.ndarray, b: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes whose customers are seated one after another: a new table has weight a + b * t, the others k - d * t.

    Until the next new table this is a Polya urn, so the number of customers until then is drawn at once (beta, then geometric). With
    MOST customers present, the following come in groups of a sixteenth of those, which find the same weights.
    """
    t, k = np.ones(len(c)), np.ones(len(c))
    left = np.flatnonzero(c > 1)
    while len(left):
        new = a[left] + b[left] * t[left]
        q = rng.beta(np.maximum(new, 1e-300), k[left] - d * t[left])
        k[left] += np.ceil(np.log(1 - rng.random(len(left))) / np.log1p(-np.clip(q, 1e-300, 1 - 1e-16)))
        left = left[k[left] <= c[left]]
        t[left] += 1
        left = left[k[left] < MOST]
    k = np.minimum(k, c)
    left = np.flatnonzero(k < c)
    while len(left):
        new, size = a[left] + b[left] * t[left], np.minimum(np.maximum(1, k[left] // 16), c[left] - k[left]).astype(np.int64)
        t[left] += rng.binomial(size, new / (new + k[left] - d * t[left]))
        k[left] += size
        left = left[k[left] < c[left]]
    return t


def seat(c: np.ndarray, others: np.ndarray, strength: float, d: float, above: tuple, ways: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draw the tables of dishes with c customers, given the tables of the others in their restaurants and the parents.

    above = (x, floor, whole): a parent without this dish's tables gives the first table the weight max(x, floor) / whole, and the
    next one, when it has i of them, (x + i) / (whole + i). The tables of up to len(ways) - 1 customers are drawn from their
    conditional distribution; beyond, customers are seated in sequence with the parent's weight for the first table held, which
    matters less the more customers there are.
    """
    x, floor, whole = above
    out, most = np.ones(len(c)), len(ways) - 1
    size = np.ceil(np.log2(np.maximum(c, 2))).astype(int)
    for s in np.unique(size[(c > 1) & (c <= most)]):
        at = np.flatnonzero((size == s) & (c > 1) & (c <= most))
        n = min(1 << s, most)
        for cut in range(0, len(at), max(1, (1 << 21) // n)):
            i = at[cut : cut + max(1, (1 << 21) // n)]
            j = np.arange(n)
            weight = np.where(j == 0, np.maximum(x[i], floor[i])[:, None], x[i][:, None] + j) / (whole[i][:, None] + j)
            logs = np.log(strength + d * (others[i][:, None] + j)) + np.log(np.maximum(weight, 1e-300))
            logs = np.cumsum(logs, axis=1) + ways[c[i], 1 : n + 1]
            p = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
            out[i] = 1 + (p < rng.random(len(i))[:, None] * p[:, -1:]).sum(1)
    big = np.flatnonzero(c > most)
    if len(big):
        p = np.maximum(x[big], floor[big]) / whole[big]
        out[big] = _sequence(c[big], (strength + d * others[big]) * p, d * p, d, rng)
    return out


def discount(n1: int, n2: int) -> float:
    """The usual estimate from the numbers of things seen once and twice."""
    return min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5


def tokens(batch: pa.RecordBatch, text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, tokens per row) of slices of at most CHUNK_ROWS rows; each row ends with END."""
    for whole in slices(batch, text):
        for at in range(0, whole.num_rows, CHUNK_ROWS):
            data, starts, ends, counts = words(*utf8(whole.column(text).slice(at, CHUNK_ROWS)))
            n = counts + 1
            w = np.full(int(n.sum()), END, np.uint64)
            inner = np.ones(len(w), bool)
            inner[np.cumsum(n) - 1] = False
            w[inner] = hash_spans(data, starts, ends)
            yield w, n


def before(w: np.ndarray, n: np.ndarray, start) -> np.ndarray:
    """The token before each one; start at the beginning of a row."""
    out = np.empty_like(w)
    out[1:] = w[:-1]
    out[np.cumsum(n) - n] = start
    return out


def _bucket_edges(sorted_words: np.ndarray) -> list[tuple[int, int, int]]:
    edge = np.searchsorted(sorted_words, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS))
    return [(b, x, y) for b, (x, y) in enumerate(zip(edge, [*edge[1:], len(sorted_words)], strict=True)) if x < y]


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    names, types = zip(*(x.split() for x in fields.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], list(names))


def _grouped(batches: Iterator[pa.RecordBatch], close) -> Iterator:
    """close(name, rows) of the runs of rows with one first column."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != now:
                yield from close(now, rows)
                rows = []
            now = row[0]
            rows.append(row)
    if rows:
        yield from close(now, rows)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


# ------------------------------------------------------------------ words and the shared restaurant
_SENT = "bucket int, once binary, more binary, c binary"
_COUNTED = "bucket int, words binary, c binary, v long, n long, hist array<long>"


def count_words(train: DataFrame, text: str) -> DataFrame:
    """Rows (bucket, words, c, v, n, hist): the words of a bucket, sorted by hash, with their counts."""

    def emit(ws: list[np.ndarray]) -> pa.RecordBatch:
        kinds, c = np.unique(np.concatenate(ws), return_counts=True)
        rows = []
        for b, x, y in _bucket_edges(kinds):
            one = c[x:y] == 1
            rows.append((b, kinds[x:y][one].tobytes(), kinds[x:y][~one].tobytes(), c[x:y][~one].astype(np.uint32).tobytes()))
        return _batch(rows, _SENT)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for w, _ in tokens(batch, text):
                held.append(w)
                size += len(w)
                if size >= 2 * CHUNK:
                    yield emit(held)
                    held, size = [], 0
        if size:
            yield emit(held)

    def close(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, counts = [], []
        for _, once, more, c in rows:
            keys += [np.frombuffer(once, np.uint64), np.frombuffer(more, np.uint64)]
            counts += [np.ones(len(keys[-2]), np.int64), np.frombuffer(c, np.uint32).astype(np.int64)]
        k, c = _summed(np.concatenate(keys), np.concatenate(counts))
        yield _batch([(bucket, k.tobytes(), c.tobytes(), len(k), int(c.sum()), np.bincount(np.log2(c).astype(np.int64), minlength=64).tolist())], _COUNTED)

    n = partitions(train.sparkSession)
    parts = train.select(F.col(text).alias("t")).mapInArrow(local, _SENT).repartition(n, "bucket").sortWithinPartitions("bucket")
    return materialize(parts.mapInArrow(lambda it: _grouped(it, close), _COUNTED), "words")


class Vocabulary:
    """What is known of words on every executor: totals, the most frequent words, the contexts to divide."""

    def __init__(self, counted: DataFrame, shard: int):
        s = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n")), *(F.coalesce(F.sum(F.get("hist", F.lit(i))), F.lit(0)).alias(f"h{i}") for i in range(64))).first()
        self.v, self.n = int(s.v), int(s.n)
        self.shards = max(1, -(-2 * self.n // shard))
        room, least = TOP, 64
        while least > 0 and s[f"h{least - 1}"] <= room:
            least -= 1
            room -= s[f"h{least}"]
        self.cut = cut = 1 << least

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in zip(*(batch.column(c).to_pylist() for c in ("words", "c")), strict=True):
                    k, c = np.frombuffer(raw[0], np.uint64), np.frombuffer(raw[1], np.int64)
                    yield _batch([(k[c >= cut].tobytes(), c[c >= cut].tobytes())], "k binary, c binary")

        rows = counted.mapInArrow(split, "k binary, c binary").collect()  # TOP words at most
        k, c = (np.concatenate([np.frombuffer(r[x], kind) for r in rows] or [np.zeros(0, kind)]) for x, kind in (("k", np.uint64), ("c", np.int64)))
        order = np.lexsort((k, -c))
        rank = np.empty(len(k), np.uint32)
        rank[order] = np.arange(len(k), dtype=np.uint32)
        by_hash = np.argsort(k)
        self.words, self.rank, self.counts = k[by_hash], rank[by_hash], c[order]  # counts by rank
        self.end = int(c[k == END].sum())
        hot = {int(w): int(x) for w, x in zip(k[c > shard], c[c > shard], strict=True) if w != END}
        if self.end > shard:
            hot[int(START)] = self.end
        self.hot = np.array(sorted(hot), np.uint64)
        self.hot_counts = np.array([hot[int(w)] for w in self.hot], np.int64)
        self.parts = np.array([1 << int(4 * x // shard).bit_length() for x in self.hot_counts], np.int64)
        self.most_parts = int(self.parts.max(initial=1))

    def codes(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, rare words): the rank of a frequent word, or _RARE + the place among the rare words."""
        if not len(self.words):
            rare, at = np.unique(w, return_inverse=True)
            return at.astype(np.uint32) + _RARE, rare
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        out, known = self.rank[at], self.words[at] == w
        rare, place = np.unique(w[~known], return_inverse=True)
        out[~known] = place.astype(np.uint32) + _RARE
        return out, rare

    def part(self, w: np.ndarray, parts) -> np.ndarray:
        return (mix(w ^ _K2) % np.uint64(parts)).astype(np.int64)

    def groups(self, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The restaurant of b that w belongs to."""
        group = mix(b ^ _K1)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, b), len(self.hot) - 1)
            split = np.flatnonzero(self.hot[at] == b)
            j = (mix(w[split] ^ _K2) % self.parts[at[split]].astype(np.uint64)).astype(np.uint64)
            with np.errstate(over="ignore"):
                group[split] = mix(group[split] + (j + np.uint64(1)) * _K2)
        return group

    def shard(self, group: np.ndarray) -> np.ndarray:
        return (group >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)  # ranges of groups


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays, byte planes apart."""
    raw = [x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"" for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).reshape(-1))
        at += size
    return out


def _own_rare(codes: list[np.ndarray], rare: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The codes of a part of a chunk, with rare words numbered among its own."""
    which = np.unique(np.concatenate([c[c >= _RARE] for c in codes]))
    out = []
    for c in codes:
        c = c.copy()
        some = c >= _RARE
        c[some] = np.searchsorted(which, c[some]).astype(np.uint32) + _RARE
        out.append(c)
    return out, rare[which - _RARE]


def _dishes(blobs: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """The codes of all blobs of a shard with one numbering of rare words, and these words."""
    rare = np.unique(np.concatenate([r for _, r in blobs]))
    out = [[] for _ in blobs[0][0]]
    for codes, own in blobs:
        to = np.searchsorted(rare, own).astype(np.uint32) + _RARE
        for i, c in enumerate(codes):
            c, some = c.copy(), c >= _RARE
            c[some] = to[c[some] - _RARE]
            out[i].append(c)
    return [np.concatenate(x) for x in out], rare


_PAIRS = "shard int, n long, groups binary, sizes binary, codes binary, rare binary"
_TABLES = "bucket int, words binary, tables binary"


def first_tables(train: DataFrame, text: str, sent, spark: SparkSession) -> DataFrame:
    """Rows (bucket, words, tables): the tables that words have in a first seating of the restaurants of single words."""

    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        known = sent.value
        w = np.concatenate([x for x, _ in held])
        b = np.concatenate([before(x, n, START) for x, n in held])
        code, rare = known.codes(w)
        g = known.groups(b, w)
        order = np.lexsort((code, g))
        g, code = g[order], code[order]
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (code[1:] != code[:-1])]))
        times = np.diff(np.append(new, len(g))).astype(np.uint32)
        g, code = g[new], code[new]
        edge = np.searchsorted(known.shard(g), np.arange(known.shards + 1, dtype=np.uint64))
        rows = []
        for s in np.flatnonzero(edge[1:] > edge[:-1]):
            x, y = edge[s], edge[s + 1]
            run = np.flatnonzero(np.concatenate([[True], g[x + 1 : y] != g[x : y - 1]]))
            (own,), few = _own_rare([code[x:y]], rare)
            rows.append((s, y - x, g[x:y][run].tobytes(), np.diff(np.append(run, y - x)).astype(np.uint32).tobytes(), _pack(own, times[x:y]), few.tobytes()))
        return _batch(rows, _PAIRS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in tokens(batch, text):
                held.append(x)
                size += len(x[0])
                if size >= CHUNK:
                    yield emit(held)
                    held, size = [], 0
        if size:
            yield emit(held)

    def close(shard: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        g = np.concatenate([np.repeat(np.frombuffer(r[2], np.uint64), np.frombuffer(r[3], np.uint32)) for r in rows])
        data = [_unpack(r[4], r[1], np.uint32, np.uint32) for r in rows]
        (code,), rare = _dishes([([x], np.frombuffer(r[5], np.uint64)) for (x, _), r in zip(data, rows, strict=True)])
        names, gid = np.unique(g, return_inverse=True)
        key, c = _summed((gid.astype(np.uint64) << np.uint64(32)) | code, np.concatenate([t for _, t in data]).astype(np.int64))
        gid, code = (key >> np.uint64(32)).astype(np.int64), (key & _LOW).astype(np.uint32)
        # Words in proportion to their counts stand for the shared restaurant, which does not exist yet.
        p = np.full(len(code), known.cut / 2 / max(1, known.n))
        p[code < _RARE] = known.counts[code[code < _RARE]] / known.n
        disc, t, many = discount(int((c == 1).sum()), int((c == 2).sum())), np.ones(len(c)), np.flatnonzero(c > 1)
        rng, ways = np.random.Generator(np.random.PCG64(int(names[0] >> np.uint64(1)))), stirling(MOST, disc)
        above = p[many] * known.n - c[many], p[many], np.full(len(many), known.n)
        for _ in range(BURN):
            total = np.bincount(gid, t, len(names))
            t[many] = seat(c[many], total[gid[many]] - t[many], STRENGTH, disc, above, ways, rng)
        word = np.empty(len(code), np.uint64)
        frequent = code < _RARE
        by_rank = np.empty(len(known.words), np.uint64)
        by_rank[known.rank] = known.words
        word[frequent], word[~frequent] = by_rank[code[frequent]], rare[code[~frequent] - _RARE]
        w, t = _summed(word, t.astype(np.int64))
        yield _batch([(b, w[x:y].tobytes(), t[x:y].astype(np.uint32).tobytes()) for b, x, y in _bucket_edges(w)], _TABLES)

    n = partitions(spark)
    parts = train.select(F.col(text).alias("t")).mapInArrow(lambda it: local(it), _PAIRS)
    return parts.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(lambda it: _grouped(it, close), _TABLES)


_SEATED = "bucket int, words binary, c0 binary, t0 binary, customers long, tables double, n1 long, n2 long"


def seat_words(counted: DataFrame, tables: DataFrame, sent) -> DataFrame:
    """Rows (bucket, words, c0, t0, ...): the customers and mean tables of the words in the shared restaurant."""

    def close(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        v = sent.value.v
        k = next(np.frombuffer(r[1], np.uint64) for r in rows if r[2] is None)
        w, t = _summed(np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows if r[2] is not None]), np.concatenate([np.frombuffer(r[2], np.uint32).astype(np.int64) for r in rows if r[2] is not None]))
        c0 = np.ones(len(k), np.int64)
        c0[np.searchsorted(k, w)] = t
        disc, rng = discount(int((c0 == 1).sum()), int((c0 == 2).sum())), np.random.Generator(np.random.PCG64(bucket))
        # Buckets are alike: a bucket's share of the words has the same share of the tables.
        own, mean, ways = np.ones(len(k)), np.zeros(len(k)), stirling(MOST, disc)
        for sweep in range(BURN + SWEEPS):
            rest, flat = own.sum() * v / len(k) - own, np.ones(len(k))
            own = seat(c0, rest, PARENT_STRENGTH, disc, (1e9 * flat, flat, 1e9 * (v + 1) * flat), ways, rng)
            if sweep >= BURN:
                mean += own / SWEEPS
        yield _batch([(bucket, k.tobytes(), c0.tobytes(), mean.astype(np.float32).tobytes(), int(c0.sum()), float(mean.sum()), int((c0 == 1).sum()), int((c0 == 2).sum()))], _SEATED)

    both = counted.select("bucket", "words", F.lit(None).cast("binary").alias("tables")).unionByName(tables)
    both = both.repartition(partitions(counted.sparkSession), "bucket").sortWithinPartitions("bucket")
    return materialize(both.mapInArrow(lambda it: _grouped(it, close), _SEATED), "shared")


class Parent:
    """Probabilities of words in the shared restaurant: of the most frequent by rank, of the others on demand."""

    def __init__(self, seated: DataFrame, known: Vocabulary, sent):
        s = seated.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("customers", "tables", "n1", "n2"))).first()
        disc, whole = discount(s.n1, s.n2), PARENT_STRENGTH + s.customers
        base = (PARENT_STRENGTH + disc * s.tables) / (known.v + 1)
        self.of = of = lambda c0, t0: (c0 - disc * t0.astype(float) + base) / whole
        self.disc, self.base, self.whole = disc, base, whole
        self.unseen, most = base / whole, known.most_parts

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, mass = sent.value, np.zeros(most)
            for batch in batches:
                for raw in zip(*(batch.column(c).to_pylist() for c in ("words", "c0", "t0")), strict=True):
                    k = np.frombuffer(raw[0], np.uint64)
                    p = of(np.frombuffer(raw[1], np.int64), np.frombuffer(raw[2], np.float32))
                    mass += np.bincount(here.part(k, most), p, most)
                    code, _ = here.codes(k)
                    some = code < _RARE
                    yield _batch([(code[some].tobytes(), p[some].tobytes(), None)], "k binary, p binary, mass binary")
            yield _batch([(b"", b"", mass.tobytes())], "k binary, p binary, mass binary")

        self.p = np.full(len(known.words), self.unseen)
        share = np.full(most, self.unseen / most)
        for r in seated.mapInArrow(frequent, "k binary, p binary, mass binary").toLocalIterator() if len(known.words) else []:
            self.p[np.frombuffer(r.k, np.uint32)] = np.frombuffer(r.p)
            if r.mass is not None:
                share += np.frombuffer(r.mass)
        self.shares = {int(parts): share.reshape(-1, int(parts)).sum(0) for parts in {*known.parts.tolist()}}


# ------------------------------------------------------------------ scoring
_BLOB = "shard int, chunk long, n long, groups binary, sizes binary, special binary, codes binary, rare binary, trained int, total int"
_REPLY = "chunk long, docs binary, score binary, base binary, known binary, ids binary, tokens binary, held binary"
#: Documents that sums are held of before they are sent.
REPLIED = 1 << 20


def by_document(doc: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The documents of a chunk that a shard has touched, and their sums: at most as many as it has tokens of the chunk."""
    top = int(doc.max()) + 1 if len(doc) else 0
    if top <= 4 * len(doc):  # few places for so many tokens: no sorting
        docs = np.flatnonzero(np.bincount(doc, minlength=top))
        return docs.astype(np.uint16), *(np.bincount(doc, v, top)[docs] for v in values)
    docs, at = np.unique(doc, return_inverse=True)
    return docs.astype(np.uint16), *(np.bincount(at, v, len(docs)) for v in values)


def sample(gid: np.ndarray, w: np.ndarray, a: np.ndarray, learned: np.ndarray, base: np.ndarray, pi: np.ndarray, shared: tuple, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean predictive probability of each entry, customers of each restaurant of a single word).

    Entries are tokens: the restaurant gid of b, the word w, the word a before b, and whether the model learns from it. base:
    probabilities of w in the shared restaurant, of which a restaurant's words have pi; shared: its (discount, weight of an unseen
    word, customers with strength).
    """
    rng, groups = np.random.Generator(np.random.PCG64(seed)), len(pi)
    # Dishes (b, w) of the parents, and restaurants (a, b) and dishes (a, b, w) of the children.
    k2, two = np.unique((gid.astype(np.uint64) << np.uint64(32)) | w, return_inverse=True)
    _, room = np.unique((gid.astype(np.uint64) << np.uint64(32)) | a, return_inverse=True)
    k3, at, three = np.unique((two.astype(np.uint64) << np.uint64(32)) | room.astype(np.uint64), return_index=True, return_inverse=True)
    c3 = np.bincount(three, learned, len(k3)).astype(np.int64)
    of2, of_room, g2 = two[at], room[at], (k2 >> np.uint64(32)).astype(np.int64)
    rooms = int(room.max(initial=-1)) + 1
    mass1 = np.empty(len(k2))
    mass1[two] = base
    p1, mass1 = mass1 / pi[g2], mass1 * shared[2]
    d3, whole3 = discount(int((c3 == 1).sum()), int((c3 == 2).sum())), STRENGTH + np.bincount(of_room, c3, rooms)
    t3, many, mean = (c3 > 0).astype(float), np.flatnonzero(c3 > 1), np.zeros(len(k3))
    c2 = np.bincount(of2, t3, len(k2)).astype(np.int64)
    d2, t2 = discount(int((c2 == 1).sum()), int((c2 == 2).sum())), (c2 > 0).astype(float)
    ways3, ways2 = stirling(MOST, d3), stirling(MOST, d2)
    for sweep in range(BURN + SWEEPS):
        tables2, whole2 = np.bincount(g2, t2, groups), STRENGTH + np.bincount(g2, c2, groups)
        crowd = np.flatnonzero(c2 > 1)
        g, own = g2[crowd], t2[crowd]
        unseen = np.full(len(crowd), shared[1])
        above = np.maximum(mass1[crowd] - own, unseen - shared[0]), unseen, shared[2] * pi[g]
        t2[c2 == 1], t2[c2 == 0] = 1, 0
        t2[crowd] = seat(c2[crowd], tables2[g] - own, STRENGTH, d2, above, ways2, rng)
        tables2 = np.bincount(g2, t2, groups)
        low = (STRENGTH + d2 * tables2[g2]) * p1
        mass2 = c2 - d2 * t2 + low
        above, own = of2[many], t3[many]
        x = np.maximum(mass2[above] - own, low[above] - d2)
        t3[many] = seat(c3[many], np.bincount(of_room, t3, rooms)[of_room[many]] - own, STRENGTH, d3, (x, low[above], whole2[g2[above]] - own), ways3, rng)
        # The parents' customers are their children's tables.
        c2 = np.bincount(of2, t3, len(k2)).astype(np.int64)
        t2 = np.minimum(t2, c2)
        if sweep >= BURN:
            p2 = (c2 - d2 * t2 + (STRENGTH + d2 * np.bincount(g2, t2, groups)[g2]) * p1) / (STRENGTH + np.bincount(g2, c2, groups))[g2]
            mean += (c3 - d3 * t3 + (STRENGTH + d3 * np.bincount(of_room, t3, rooms)[of_room]) * p2[of2]) / whole3[of_room] / SWEEPS
    return mean[three], np.bincount(gid, learned, groups)


def score(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """Per document: key, held_out, n_tokens, n_known, train_tokens, base_score and score. held_out: a condition; those rows are not learned from."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), held_out.alias("h"))
    train = rows.filter(~F.col("h"))
    counted = count_words(train, "t")
    known = Vocabulary(counted, shard)
    sent = spark.sparkContext.broadcast(known)
    seated = seat_words(counted, first_tables(train, "t", sent, spark), sent)
    parent = Parent(seated, known, sent)
    given = spark.sparkContext.broadcast(parent.p)
    shards, n_train, v_train, end, of, unseen, shares = known.shards, known.n, known.v, known.end, parent.of, parent.unseen, parent.shares
    shared = parent.disc, parent.base, parent.whole
    key_type = docs.select(key).limit(0).toArrow().schema.field(0).type

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rare words of each shard, by buckets of words."""
        here = sent.value

        def asked(ws: list, to: list) -> pa.RecordBatch:
            w, s = np.concatenate(ws), np.concatenate(to)
            order = np.lexsort((s, w))
            w, s = w[order], s[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
            w, s = w[new], s[new].astype(np.uint32)
            return _batch([(b, True, w[x:y].tobytes(), s[x:y].tobytes(), None) for b, x, y in _bucket_edges(w)], "bucket int, asks boolean, words binary, x binary, y binary")

        ws, to, size = [], [], 0
        for batch in batches:
            for w, each in tokens(batch, "t"):
                rare = here.codes(w)[0] >= _RARE
                if rare.any():
                    ws.append(w[rare])
                    to.append(here.shard(here.groups(before(w, each, START)[rare], w[rare])))
                    size += len(ws[-1])
                if size >= CHUNK:
                    yield asked(ws, to)
                    ws, to, size = [], [], 0
        if size:
            yield asked(ws, to)

    def answer(bucket: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own, asks = next((r for r in rows if not r[1]), None), [r for r in rows if r[1]]
        if own is None or not asks:
            return
        k, c0, t0 = np.frombuffer(own[2], np.uint64), np.frombuffer(own[3], np.int64), np.frombuffer(own[4], np.float32)
        w, s = np.concatenate([np.frombuffer(r[2], np.uint64) for r in asks]), np.concatenate([np.frombuffer(r[3], np.uint32) for r in asks])
        order = np.lexsort((w, s))
        w, s = w[order], s[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
        at = np.minimum(np.searchsorted(k, w), len(k) - 1)
        new &= k[at] == w  # a word without counts is unseen
        w, p, s = w[new], of(c0[at[new]], t0[at[new]]), s[new]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        cut = list(zip(first, [*first[1:], len(s)], strict=True)) if len(s) else []
        if cut:
            yield _batch([(int(s[x]), -1, y - x, b"", b"", b"", p[x:y].tobytes(), w[x:y].tobytes(), 0, 0) for x, y in cut], _BLOB)

    def emit(chunk: int, held_rows: list[tuple[np.ndarray, np.ndarray]], held: np.ndarray) -> Iterator[tuple]:
        here = sent.value
        w, each = np.concatenate([x for x, _ in held_rows]), np.concatenate([x for _, x in held_rows])
        place = np.empty(len(each), np.int64)  # documents to learn from come first
        place[np.argsort(held, kind="stable")] = np.arange(len(held))
        doc = np.repeat(place, each).astype(np.uint16)
        code, rare = here.codes(np.append(w, START))
        start, code = code[-1], code[:-1]
        b, left = before(w, each, START), before(code, each, start)
        left = before(left, each, start)  # the word before the context; its own start token before the first two
        g = here.groups(b, w)
        order = np.argsort((code.astype(np.uint64) << np.uint64(32)) | left)
        order = order[np.argsort(g[order], kind="stable")]
        g, code, left, doc, b, w = g[order], code[order], left[order], doc[order], b[order], w[order]
        edge = np.searchsorted(here.shard(g), np.arange(shards + 1, dtype=np.uint64))
        for s in np.flatnonzero(edge[1:] > edge[:-1]):
            x, y = edge[s], edge[s + 1]
            run = np.flatnonzero(np.concatenate([[True], g[x + 1 : y] != g[x : y - 1]]))
            special = []
            for i in np.flatnonzero((b[x:y][run] == START) | np.isin(b[x:y][run], here.hot)):
                at, k = x + run[i], int(np.searchsorted(here.hot, b[x + run[i]]))
                if k < len(here.hot) and here.hot[k] == b[at]:
                    parts = int(here.parts[k])
                    special.append((i, here.hot_counts[k], shares[parts][here.part(w[at : at + 1], parts)[0]], b[at] == START))
                else:
                    special.append((i, -1, 1.0, True))
            codes, few = _own_rare([code[x:y], left[x:y]], rare)
            yield s, chunk, y - x, g[x:y][run].tobytes(), np.diff(np.append(run, y - x)).astype(np.uint32).tobytes(), np.array(special, float).tobytes(), _pack(*codes, doc[x:y]), few.tobytes(), int((~held).sum()), len(held)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq = TaskContext.get().partitionId(), 0
        state: list[list] = [[], [], []]
        size = count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            parts, held, ids = state
            chunk, mask = (pid << 32) | seq, np.concatenate(held)
            yield _batch(list(emit(chunk, parts, mask)), _BLOB)
            # The documents themselves: ids as an Arrow stream, token counts, and which are held out.
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", key_type)])) as stream:
                stream.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays(ids)], ["id"]))
            yield _batch([(-1 - chunk % 64, chunk, 0, sink.getvalue().to_pybytes(), np.concatenate([x for _, x in parts]).astype(np.int64).tobytes(), mask.tobytes(), b"", b"", 0, len(mask))], _BLOB)

        for batch in batches:
            at, mask = 0, batch.column("h").to_numpy(zero_copy_only=False).astype(bool)
            for w, each in tokens(batch, "t"):
                if count and (count + len(each) > 2 * CHUNK_ROWS or size >= CHUNK):  # documents are numbered in 16 bits
                    yield from flush()
                    state, size, count, seq = [[], [], []], 0, 0, seq + 1
                for column, x in zip(state, ((w, each), mask[at : at + len(each)], batch.column("k").slice(at, len(each)).cast(key_type)), strict=True):
                    column.append(x)
                at, size, count = at + len(each), size + len(w), count + len(each)
        if count:
            yield from flush()

    def close(rows: list[tuple], sums: dict) -> None:
        replied = [r for r in rows if r[1] == -1]
        rows = [r for r in rows if r[1] != -1]
        if not rows:
            return
        known_words, known_p = np.frombuffer(b"".join(r[7] for r in replied), np.uint64), np.frombuffer(b"".join(r[6] for r in replied))
        by = np.argsort(known_words, kind="stable")
        known_words, known_p = known_words[by], known_p[by]
        groups = [np.frombuffer(r[3], np.uint64) for r in rows]
        names_of, gid = np.unique(np.concatenate(groups), return_inverse=True)
        count, pi, start = np.full(len(names_of), -1.0), np.ones(len(names_of)), np.zeros(len(names_of), bool)
        at = 0
        for r, g in zip(rows, groups, strict=True):
            for i, c, share, is_start in np.frombuffer(r[5]).reshape(-1, 4):
                k = gid[at + int(i)]
                count[k], pi[k], start[k] = c, share, bool(is_start)
            at += len(g)
        gid = np.repeat(gid, np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows]))
        data = [_unpack(r[6], r[2], np.uint32, np.uint32, np.uint16) for r in rows]
        (w, a), rare = _dishes([(x[:2], np.frombuffer(r[7], np.uint64)) for x, r in zip(data, rows, strict=True)])
        lengths = np.array([r[2] for r in rows])
        doc = np.concatenate([x[2] for x in data]).astype(np.int64)
        learned = doc < np.repeat(np.array([r[8] for r in rows]), lengths)
        own = np.full(len(rare), unseen)
        if len(known_words) and len(rare):
            at = np.minimum(np.searchsorted(known_words, rare), len(known_words) - 1)
            own = np.where(known_words[at] == rare, known_p[at], unseen)
        base, frequent = np.empty(len(w)), w < _RARE
        base[frequent], base[~frequent] = given.value[w[frequent]], own[w[~frequent] - _RARE]
        p, customers = sample(gid, w, a, learned, base, pi, shared, int(names_of[0] >> np.uint64(1)))
        divided = count >= 0
        part = np.where(divided, (customers + PART_STRENGTH * pi) / (np.maximum(count, 0) + PART_STRENGTH), 1.0)
        value = np.log10(p * part[gid])
        known_count = np.where(start, 0, np.where(divided, count, customers))
        logs = np.where(start, 0.0, np.log10(known_count + 1))
        for r, y in zip(rows, np.cumsum(lengths), strict=True):
            x = y - r[2]
            sums.setdefault(r[1], []).append(by_document(doc[x:y], value[x:y], logs[gid[x:y]], known_count[gid[x:y]] > 0))

    def replies(sums: dict) -> Iterator[pa.RecordBatch]:
        for cut in range(0, len(sums), 256):
            out = []
            for chunk, held in list(sums.items())[cut : cut + 256]:
                docs, *total = by_document(*(np.concatenate(x) for x in zip(*held, strict=True)))
                out.append((chunk, docs.tobytes(), total[0].tobytes(), total[1].tobytes(), total[2].astype(np.uint32).tobytes(), None, None, None))
            yield _batch(out, _REPLY)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sums = None, [], {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] < 0:
                    yield _batch([(row[1], None, None, None, None, *row[3:6])], _REPLY)
                    continue
                if row[0] != now and held:
                    close(held, sums)
                    held = []
                    if sum(len(x[0]) for touched in sums.values() for x in touched) > REPLIED:
                        yield from replies(sums)
                        sums = {}
                now = row[0]
                held.append(row)
        if held:
            close(held, sums)
        yield from replies(sums)

    out_schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def finish(chunk: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = next(r for r in parts if r[5] is not None)
        ids = pa.ipc.open_stream(own[5]).read_all().column(0).combine_chunks()
        each, held = np.frombuffer(own[6], np.int64), np.frombuffer(own[7], bool)
        total = np.zeros((3, len(each)))
        # Partial sums in an order of their own, so that the last bits don't depend on which task came first.
        for r in sorted((r for r in parts if r[1] is not None), key=lambda r: r[1:5]):
            docs = np.frombuffer(r[1], np.uint16)
            for x, data, kind in zip(total, r[2:5], (np.float64, np.float64, np.uint32), strict=True):
                x[docs] += np.frombuffer(data, kind)
        place = np.empty(len(held), np.int64)
        place[np.argsort(held, kind="stable")] = np.arange(len(held))
        s, base, seen = (x[place] for x in total)
        if not n_train:
            s = np.zeros(len(s))
        base = base + np.log10(end + 1) - each * np.log10(n_train + v_train + 1)
        yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(each), pa.array(seen.astype(np.int64) + (end > 0)), pa.array(np.full(len(each), n_train)), pa.array(base), pa.array(s)], out_schema.names)

    blobs = rows.mapInArrow(local, _BLOB)
    if known.v > len(known.words):
        asked = rows.select("t").mapInArrow(ask, "bucket int, asks boolean, words binary, x binary, y binary")
        both = seated.select("bucket", F.lit(False).alias("asks"), "words", F.col("c0").alias("x"), F.col("t0").alias("y")).unionByName(asked)
        blobs = blobs.unionByName(both.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _grouped(it, answer), _BLOB))
    blobs = blobs.repartition(n, "shard").sortWithinPartitions("shard", "chunk")
    return blobs.mapInArrow(infer, _REPLY).repartition(n, "chunk").sortWithinPartitions("chunk").mapInArrow(lambda it: _grouped(it, finish), out_schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)
