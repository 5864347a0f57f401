"""N-gram Jaccard join by token-combination prefixes.

Tokens are word shingles. A first pass counts, exactly and over all documents, in how many each
token occurs; the most frequent form the frequent class. Tokens are ordered rare class first, by hash
within a class. Two sets whose overlap must reach t share tokens in their prefixes: a set is indexed by
each rare token of its prefix, and by pairs of frequent tokens of one subclass. The prefix is extended
until (rare tokens) + sum over subclasses of (frequent tokens - 1) reaches size - t + 1; if two sets
share no signature, each is missing so many tokens of the other that their overlap is below t.

Documents with equal sets are one node. A signature that HEAVY nodes of one chunk share is posted in parts (the nodes
of a chunk), which never meet in one task; all other signatures have one posting list. Pairs are bounded
by parity bitmaps (the Hamming distance of two parity bitmaps never exceeds the symmetric difference, so
no link is lost). Three rounds of verification, each followed by connected components, go from few pairs to all that
are left: (1) a star per group of alike nodes of a list or part; (2) one pair per node and list between different
components, and for signatures in parts, between one representative of each component; (3) every alike pair of different
components: in a signature of several parts the nodes outside its largest component meet all parts, so the parts of a
large group of near copies, which are one component by then, do not meet each other. Lists within one component take no part.
Verification intersects the whole token sets. (Round 3 is as large as the number of pairs that pass the bitmaps but not
the limit; no exact join avoids these.)

Defined cases: null text, or text without words, has an empty set and no links; fewer words than a
shingle form one token; equal sets are linked however many there are; rows that repeat an id are all
reported, with that id; null ids are linked and reported like others and stand after all others for naming a component (if a
component holds only null ids its name is null); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm.common import hash_spans, materialize, mix, partitions, shingle_hashes, slices, table, utf8, words
from sparkprep.llm.components import components

MIN_DF = 8
MOST_FREQUENT = 1 << 20
FLUSH = 1 << 20
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK = 2048
HEAVY = 64


def token_sets(batch: pa.RecordBatch, text: str, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct token hashes) of each row."""
    at = 0
    for part in slices(batch, text):
        data, starts, ends, counts = words(*utf8(part.column(text)))
        tokens, each = shingle_hashes(hash_spans(data, starts, ends), counts, k)
        stop = np.cumsum(each)
        for i, (a, b) in enumerate(zip(stop - each, stop, strict=True)):
            yield at + i, np.unique(tokens[a:b])
        at += part.num_rows


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = max(len(c) for c in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


# ------------------------------------------------------------------ document frequencies
def frequent_tokens(docs: DataFrame, text: str, k: int, most: int = MOST_FREQUENT) -> tuple[np.ndarray, int]:
    """(tokens, bits cut off): of the at most ``most`` tokens in the most documents, MIN_DF or more, the leading bits; sorted."""
    spark = docs.sparkSession
    n = partitions(spark)
    bits = min(12, max(5, (32 * n - 1).bit_length()))
    cut = 32 - bits  # a bucket is the top bits; the next 32 are sent
    sent = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def emit(sets: list[np.ndarray]) -> pa.RecordBatch:
        t, c = np.unique(np.concatenate(sets) >> np.uint64(cut), return_counts=True)
        edge = np.searchsorted(t, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32))
        rows = []
        for b, (x, y) in enumerate(zip(edge, [*edge[1:], len(t)], strict=True)):
            if x < y:
                key, each = t[x:y].astype(np.uint32), c[x:y]
                rows.append((b, key[each == 1].tobytes(), key[each > 1].tobytes(), each[each > 1].astype(np.uint32).tobytes()))
        return _rows(sent, **dict(zip(sent.names, map(list, zip(*rows, strict=True)), strict=True)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, s in token_sets(batch, "_text", k):
                held.append(s)
                size += len(s)
                if size >= 2 * FLUSH:
                    yield emit(held)
                    held, size = [], 0
        if size:
            yield emit(held)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(bucket: int, keys: list, counts: list) -> Iterator[pa.RecordBatch]:
            key, w = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            key, w = key[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            df = np.add.reduceat(w, first)
            good = df >= MIN_DF
            if good.any():
                token = (np.uint64(bucket) << np.uint64(32)) | key[first][good].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(df[good].astype(np.int64))], ["token", "df"])

        now, keys, counts = None, [], []
        for batch in batches:
            for b, once, more, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if b != now and keys:
                    yield from close(now, keys, counts)
                    keys, counts = [], []
                now = b
                one, many = np.frombuffer(once, np.uint32), np.frombuffer(more, np.uint32)
                keys += [one, many]
                counts += [np.ones(len(one), np.int64), np.frombuffer(c, np.uint32).astype(np.int64)]
        if keys:
            yield from close(now, keys, counts)

    parts = docs.select(F.col(text).alias("_text")).mapInArrow(local, "bucket int, once binary, more binary, counts binary")
    found = parts.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(total, "token long, df long")
    found = materialize(found, "frequencies")
    room, least = most, None
    for r in sorted(found.groupBy(F.floor(F.log2("df")).alias("level")).count().collect(), key=lambda r: -r.level):  # at most 64 rows
        if r["count"] > room:
            break
        room, least = room - r["count"], 1 << r.level
    if least is None:
        return np.zeros(0, np.uint64), cut
    return np.sort(np.array([r.token for r in found.filter(F.col("df") >= least).select("token").collect()], np.int64)).astype(np.uint64), cut


# ------------------------------------------------------------------ signatures
def _classes(cut: int) -> int:
    return max(1, (1 << cut) // 8)


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of one sorted token set; frequent marks its tokens of the frequent class."""
    n = len(s)
    need = n - (percent * n + 99) // 100 + 1
    rare = s[~frequent]
    if len(rare) >= need:
        return mix(rare[:need] ^ _K1)
    out, often = [mix(rare ^ _K1)], s[frequent]
    level = n.bit_length() - 1
    with np.errstate(over="ignore"):
        for cut in [level, level + 1] if 100 * n >= percent << (level + 1) else [level]:
            left = need - len(rare)
            if cut < 3:  # a few tokens: singles of the frequent class, too
                out.append(mix(often[:left] ^ _K2))
                continue
            group = (mix(often) % np.uint64(_classes(cut))).astype(np.int64)
            _, first = np.unique(group, return_index=True)
            worth = np.ones(len(often), np.int64)
            worth[first] = 0
            stop = int(np.searchsorted(np.cumsum(worth), left)) + 1
            order = np.argsort(group[:stop], kind="stable")
            t, g = often[:stop][order], group[:stop][order]
            for gap in range(1, stop):
                same = g[gap:] == g[:-gap]
                if not same.any():
                    break
                out.append(mix(mix(t[:-gap][same] * _K1 + t[gap:][same] * _K2) + np.uint64(cut)))
    return np.concatenate(out)


def parity(s: np.ndarray) -> bytes:
    width = 1 << max(8, (4 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((mix(s) % np.uint64(width)).astype(np.int64), minlength=width).astype(np.uint8) & 1).tobytes()


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two 63-bit sums that name a set."""
    with np.errstate(over="ignore"):
        both = [mix(s + x).sum(dtype=np.uint64) + np.uint64(len(s)) for x in (_K1, _K2)]
    return tuple(int(mix(np.array([x], np.uint64))[0] >> np.uint64(1)) for x in both)


def index(docs: DataFrame, frequent: tuple[np.ndarray, int], key: str, text: str, k: int, percent: int) -> DataFrame:
    """Rows with a sig are posting lists of two or more nodes; the others describe documents."""
    spark = docs.sparkSession
    n = partitions(spark)
    lists = 8 * n
    filled = np.zeros(1 << 24, bool)
    filled[(frequent[0] % np.uint64(1 << 24)).astype(np.int64)] = True
    sent, cut = spark.sparkContext.broadcast((frequent[0], np.packbits(filled))), frequent[1]
    key_type = docs.select(key).limit(0).toArrow().schema.field(0).type
    first = pa.schema([("bucket", pa.int32()), ("id", key_type), ("h", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("sigs", pa.binary()), ("nodes", pa.binary())])
    then = pa.schema([("id", key_type), ("h", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("sig", pa.int64()), ("members", pa.list_(pa.int64()))])
    key_sql = docs.schema[key].dataType.simpleString()

    def post(sigs: list[np.ndarray], nodes: list[tuple[int, int]]) -> pa.RecordBatch:
        sig, node = np.concatenate(sigs), np.repeat(np.array([x for x, _ in nodes], np.int64), [c for _, c in nodes])
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        first_of = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first_of, len(sig)))
        heavy = np.flatnonzero(size >= HEAVY)
        parts = [(-1 - int(sig[i] % np.uint64(lists)), sig[i : i + 1].tobytes(), np.sort(node[j : min(j + BLOCK, i + m)]).tobytes()) for i, m in zip(first_of[heavy], size[heavy], strict=True) for j in range(i, i + m, BLOCK)]
        light = np.repeat(size < HEAVY, size)
        sig, node = sig[light], node[light]
        list_of = (sig % np.uint64(lists)).astype(np.int32)
        order = np.argsort(list_of, kind="stable")
        sig, node, list_of = sig[order], node[order], list_of[order]
        edge = np.searchsorted(list_of, np.arange(lists + 1))
        full = np.flatnonzero(edge[1:] > edge[:-1])
        rows = [(b, sig[edge[b] : edge[b + 1]].tobytes(), node[edge[b] : edge[b + 1]].tobytes()) for b in full] + parts
        return _rows(first, **dict(zip(("bucket", "sigs", "nodes"), map(list, zip(*rows, strict=True)), strict=True)))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, packed = sent.value
        slots = np.unpackbits(packed).view(bool)
        held, owners, seen, size = [], [], set(), 0
        for batch in batches:
            meta: dict[str, list] = {c: [] for c in ("bucket", "n", "node", "check", "bits")}
            rows = []
            for row, s in token_sets(batch, "_text", k):
                node, check = identity(s) if len(s) else (0, 0)
                for c, x in zip(meta, (lists + (row + node) % (4 * lists), len(s), node, check, parity(s) if len(s) else b""), strict=True):
                    meta[c].append(x)
                rows.append(row)
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                short = s >> np.uint64(cut)
                maybe = slots[(short % np.uint64(1 << 24)).astype(np.int64)]
                at = np.flatnonzero(maybe)
                if len(at):
                    got = np.searchsorted(often, short[at])
                    maybe[at] = often[np.minimum(got, len(often) - 1)] == short[at]
                held.append(np.unique(signatures(s, maybe, percent)))
                owners.append((node, len(held[-1])))
                size += len(held[-1])
                if size >= FLUSH:
                    yield post(held, owners)
                    held, owners, seen, size = [], [], set(), 0
            yield _rows(first, id=batch.column("_id").cast(key_type), h=batch.column("_h"), **meta)
        if size:
            yield post(held, owners)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(sigs: list, nodes: list) -> Iterator[pa.RecordBatch]:
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            order = np.argsort(sig, kind="stable")
            s = sig[order]
            alike = s[1:] == s[:-1]
            keep = np.concatenate([[False], alike]) | np.concatenate([alike, [False]])
            s, m = s[keep], node[order][keep]
            order = np.lexsort((m, s))
            s, m = s[order], m[order]
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (m[1:] != m[:-1])
            s, m = s[fresh], m[fresh]
            if not len(s):
                return
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            stop = np.append(edge[1:], len(s))
            many = np.flatnonzero(stop - edge > 1)
            for cut in range(0, len(many), 4096):
                use = many[cut : cut + 4096]
                yield _rows(then, sig=s[edge[use]].view(np.int64), members=[m[edge[i] : stop[i]] for i in use])

        now, sigs, nodes = None, [], []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            if (bucket >= lists).any():
                plain = batch.filter(pa.array(bucket >= lists))
                yield _rows(then, **{c: plain.column(c) for c in ("id", "h", "n", "node", "check", "bits")})
            if (bucket < 0).any():
                parts = batch.filter(pa.array(bucket < 0))
                yield _rows(then, sig=[int.from_bytes(x, "little", signed=True) for x in parts.column("sigs").to_pylist()], members=[np.frombuffer(x, np.int64) for x in parts.column("nodes").to_pylist()])
            batch = batch.filter(pa.array((bucket >= 0) & (bucket < lists)))
            for b, s, m in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sigs", "nodes")), strict=True):
                if b != now and sigs:
                    yield from close(sigs, nodes)
                    sigs, nodes = [], []
                now = b
                sigs.append(np.frombuffer(s, np.uint64))
                nodes.append(np.frombuffer(m, np.int64))
        if sigs:
            yield from close(sigs, nodes)

    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    both = rows.mapInArrow(local, f"bucket int, id {key_sql}, h long, n long, node long, check long, bits binary, sigs binary, nodes binary")
    both = both.repartition(n, "bucket").sortWithinPartitions("bucket")
    return materialize(both.mapInArrow(gather, f"id {key_sql}, h long, n long, node long, check long, bits binary, sig long, members array<long>"), "postings")


# ------------------------------------------------------------------ pairs
def _near(bits: list[np.ndarray], sizes: np.ndarray, i: int, js: np.ndarray, percent: int) -> np.ndarray:
    """Which of js (none larger than i) may reach the similarity with i."""
    js = js[100 * sizes[js] >= percent * sizes[i]]
    good = []
    for width in {len(bits[j]) for j in js}:
        own = bits[i]
        while len(own) > width:
            own = own[: len(own) // 2] ^ own[len(own) // 2 :]
        use = np.array([j for j in js if len(bits[j]) == width], np.int64)
        apart = np.bitwise_count(np.stack([bits[j] for j in use]) ^ own).sum(1, dtype=np.int64)
        good.append(use[(100 + percent) * apart <= (100 - percent) * (sizes[i] + sizes[use])])
    return np.concatenate(good) if good else js[:0]


def _pairs(batches: Iterator[pa.RecordBatch], percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows (list, side, node, n, bits, component) -> pairs to verify.

    Without components, a star around the first of each group of alike nodes, and a pair at least for
    every node that has an alike one; with components, for a node the first other that is alike and of
    another component, or with ``every`` all of them.
    """
    seen: set[tuple[int, int]] = set()

    def close(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (-r[2], r[1]))
        side = np.array([r[0] for r in rows])
        nodes, sizes = [r[1] for r in rows], np.array([r[2] for r in rows])
        bits = [np.frombuffer(r[3], np.uint64) for r in rows]
        out = []
        if rows[0][4] is None:
            left, alone = np.arange(len(rows)), np.ones(len(rows), bool)
            while len(left) > 1:
                near = _near(bits, sizes, left[0], left[1:], percent)
                out += [(nodes[left[0]], nodes[j]) for j in near]
                if len(near):
                    alone[near] = alone[left[0]] = False
                left = np.setdiff1d(left[1:], near, assume_unique=True)
            # A node that is near some member of a star only: one pair makes it known to the second round.
            joined = np.flatnonzero(~alone)
            for i in joined:
                js = np.flatnonzero(alone[i + 1 :]) + i + 1
                if len(js):
                    near = _near(bits, sizes, i, js, percent)
                    out += [(nodes[i], nodes[j]) for j in near]
                    alone[near] = False
            for i in np.flatnonzero(alone) if len(joined) else []:
                near = _near(bits, sizes, i, joined[joined > i], percent)
                out += [(nodes[i], nodes[j]) for j in near[:1]]
        else:
            comp = np.array([r[4] for r in rows])
            mixed = side.any()  # two blocks of a long list: each on its own is compared elsewhere
            for i in range(len(rows) if (comp != comp[0]).any() else 0):
                js = np.arange(i + 1, len(rows))
                js = js[(comp[js] != comp[i]) & ((side[js] != side[i]) | ~mixed)]
                if len(js):
                    near = _near(bits, sizes, i, js, percent)
                    out += [(nodes[i], nodes[j]) for j in (near if every else near[:1])]
        return out

    now, rows = None, []
    for batch in batches:
        out = []
        for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != now and len(rows) > 1:
                out += close(rows)
            if name != now:
                now, rows = name, []
            rows.append(row)
        fresh = [p for p in dict.fromkeys(out) if p not in seen]
        if len(seen) < 1 << 20:
            seen.update(fresh)
        if fresh:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*fresh, strict=True)], ["a", "b"])
    if len(rows) > 1 and (out := close(rows)):
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*dict.fromkeys(out), strict=True)], ["a", "b"])


def _candidates(entries: DataFrame, nodes: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Pairs of the entries (list, side, node, component)."""
    rows = entries.join(nodes.hint("merge"), "node").select("list", "side", "node", "n", "bits", "component")
    rows = rows.repartition(partitions(entries.sparkSession), "list").sortWithinPartitions("list", "side")
    return rows.mapInArrow(lambda it: _pairs(it, percent, every), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are linked."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                good.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _lists(found: DataFrame) -> DataFrame:
    """(sig, part, several, node): the entries of posting lists, less signatures that post the same nodes in the same parts as another."""
    posted = found.filter("sig IS NOT NULL").select("sig", "members", F.xxhash64("members").alias("part"), F.xxhash64(F.lit(1), "members").alias("other"))
    whole = posted.groupBy("sig").agg(F.bit_xor("part").alias("x"), F.bit_xor("other").alias("y"), F.count("*").alias("parts"))
    kept = whole.groupBy("x", "y", "parts").agg(F.min("sig").alias("sig")).select("sig", (F.col("parts") > 1).alias("parted"))
    rows = posted.join(kept.hint("merge"), "sig").withColumn("blocks", F.ceil(F.size("members") / (2 * BLOCK)))
    rows = rows.select("sig", "part", "blocks", (F.col("parted") | (F.col("blocks") > 1)).alias("several"), F.posexplode("members").alias("at", "node"))
    return rows.select("sig", F.when(F.col("blocks") > 1, F.xxhash64("part", F.col("at") % F.col("blocks"))).otherwise(F.col("part")).alias("part"), "several", "node")


def _open(entries: DataFrame, every: bool) -> DataFrame:
    """(list, side, node, component) of the entries (sig, part, several, node, component) of signatures with several components."""
    spans = entries.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("sig")
    entries = materialize(entries.join(spans.hint("merge"), "sig", "left_semi"), "entries")
    name = lambda part, block: F.struct(F.col("sig"), part.alias("part"), block.alias("block")).alias("list")
    zero = F.lit(0)
    own = entries.filter("NOT several OR " + str(not every).lower()).select(name(F.col("part"), zero), zero.alias("side"), "node", "component")
    several = entries.filter("several")
    sizes = several.groupBy("sig", "component").agg(F.count("*").alias("size"), F.min("node").alias("node"))
    if not every:  # one node of each component of the whole signature
        blocks = sizes.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        heads = sizes.join(blocks.hint("merge"), "sig").select(name(F.lit(0).cast("long"), F.pmod(F.xxhash64("node"), "blocks").cast("int") + 1), zero.alias("side"), "node", "component")
        return own.unionByName(heads)
    # Nodes outside the largest component meet all parts, in blocks.
    largest = sizes.groupBy("sig").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
    rest = several.join(largest.hint("merge"), "sig").filter("component != largest").select("sig", "node", "component").distinct()
    blocks = rest.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    places = several.select("sig", "part").distinct()
    rest = rest.join(blocks.hint("merge"), "sig").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(places.hint("merge"), "sig")
    rest = rest.select(name(F.col("part"), F.col("block")), F.lit(1).alias("side"), "node", "component")
    part = several.join(blocks.hint("merge"), "sig").withColumn("block", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    return own.unionByName(rest).unionByName(part.select(name(F.col("part"), F.col("block")), zero.alias("side"), "node", "component"))


def _groups(docs: DataFrame, k: int, percent: int, key: str, text: str, most_frequent: int) -> tuple[DataFrame, DataFrame]:
    """(id, h, n, node, check) of every document, and (node, check, id, h, component) of every set: its first document and its group."""
    kind = docs.schema[key].dataType.simpleString()
    found = index(docs, frequent_tokens(docs, text, k, most_frequent), key, text, k, percent)
    meta = found.filter("sig IS NULL").select("id", "h", "n", "node", "check", "bits")
    # A set is known by its first document; equal sets need no comparison.
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("h"))).alias("first")
    reps = meta.filter("n > 0").groupBy("node", "check").agg(first, F.first("n").alias("n"), F.first("bits").alias("bits"))
    reps = materialize(reps.select("node", "check", "first.id", "first.h", "n", "bits"), "sets")
    nodes = reps.dropDuplicates(["node"]).select("node", "n", "bits")
    entries = materialize(_lists(found), "lists")
    lists = entries.select(F.struct("sig", "part", F.lit(0).alias("block")).alias("list"), F.lit(0).alias("side"), "node", F.lit(None).cast("long").alias("component"))
    pairs = materialize(_candidates(lists, nodes, percent), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = reps.join(needed.hint("merge"), "node", "left_semi").select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("node").alias("_node"), F.col("check").alias("_check"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets = [], []
            asked = list(zip(batch.column("_node").to_pylist(), batch.column("_check").to_pylist(), strict=True))
            for i, s in token_sets(batch, "_text", k):
                if len(s) and identity(s) == asked[i]:
                    rows.append(i)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("_node").take(pa.array(rows, pa.int64())), pa.array(sets, pa.binary())], ["node", "tokens"])

    texts = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    texts = texts.join(wanted.hint("merge"), F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")))
    sets = texts.select("_node", "_check", "_text").mapInArrow(fetch, "node long, tokens binary")
    repeated = meta.filter("n > 0").groupBy("id", "h").count().filter("count > 1").limit(1)
    sets = materialize(sets if repeated.isEmpty() else sets.dropDuplicates(["node"]), "tokens")
    links = materialize(_verify(pairs, sets, percent), "links")
    label = components(links, "a", "b")
    for every in (False, True):  # few pairs join most of what belongs together; then all that are left are tried
        named = entries.join(label.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        more = materialize(_candidates(_open(named, every), nodes, percent, every).join(pairs.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        new = materialize(_verify(more, sets, percent), "links")
        pairs = pairs.unionByName(more)
        if not new.isEmpty():
            links = links.unionByName(new)
            label = components(links, "a", "b")
    return meta.select("id", "h", "n", "node", "check"), reps.select("node", "check", "id", "h").join(label.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def join(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key reachable by links)."""
    meta, sets = _groups(docs, k, percent, key, text, most_frequent)
    names = sets.groupBy("component").agg(F.min("id").alias("name"))
    named = sets.join(names.hint("merge"), "component").select(F.col("node").alias("_node"), F.col("check").alias("_check"), "name")
    out = meta.join(named.hint("merge"), (meta.node == F.col("_node")) & (meta.check == F.col("_check")) & (meta.n > 0), "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A pipeline stage: of each group of near duplicates one document stays, that of the smallest id (null ids last); documents
    without words all stay, but rows that repeat an id and a text only once."""
    meta, sets = _groups(docs, 5, 80, key, text, MOST_FREQUENT)
    best = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("h"))).alias("best")
    kept = sets.groupBy("component").agg(best).select("best.id", "best.h").unionByName(meta.filter("n = 0").select("id", "h")).distinct()
    kept = materialize(kept.select(F.col("id").alias("__sp_id"), F.col("h").alias("__sp_h")), "kept")
    out = docs.withColumn("__sp_hash", F.xxhash64(text)).join(kept.hint("merge"), F.col(key).eqNullSafe(F.col("__sp_id")) & (F.col("__sp_hash") == F.col("__sp_h")), "left_semi").drop("__sp_hash")
    repeated = meta.groupBy("id", "h").count().filter("count > 1").limit(1)
    return out if repeated.isEmpty() else out.dropDuplicates([key, text])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), k=4, percent=85)
