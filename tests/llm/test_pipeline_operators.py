"""Every operator against a brute-force version, an exact round trip, or held-out accuracy; and the awkward cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import archive, components, fingerprints, langid, line_dedup, mixing, packing, pitman_yor, quality, simjoin, vectors
from sparkprep.llm.common import crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(lower(t))


def rows(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]


# ------------------------------------------------------------------ 1
def test_packing_round_trip(spark, corpus, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    special = spark.createDataFrame([(9100, "a <|endoftext|> b")], "doc_id long, text string")
    got = packing.pack(corpus.select("doc_id", "text").unionByName(special), path, width=256).collect()
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        assert r.length * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids) and 0 < r.length <= 256 and r.offset + r.length <= 256
    for i, text in [*rows(corpus), (9100, "a <|endoftext|> b")]:
        p = sorted(pieces[i], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in p])
        assert [r.start for r in p] == np.cumsum([0, *[r.length for r in p]])[:-1].tolist()
        assert ids.tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 0] and p[0].doc_tokens == len(ids)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s, x in sequences.items():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and x[0][0] == 0
        assert s == len(sequences) - 1 or sum(n for _, n in x) == 256
    assert packing.pack(empty, path).count() == 0
    assert packing.padded_length(512) == 512 and packing.padded_length(513) == 1024


# ------------------------------------------------------------------ 2
def brute_join(pairs, k, percent):
    sets = {i: frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w := words(t)) >= k else frozenset([tuple(w)] if w else []) for i, t in pairs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "most"), [(4, 85, 1 << 20), (2, 80, 50), (5, 60, 1 << 20)])
def test_join_equals_brute_force(spark, corpus, monkeypatch, k, percent, most):
    monkeypatch.setattr(simjoin, "MIN_DF", 3)
    base = [t.split() for _, t in rows(corpus.filter("length(text) > 400").limit(3))]
    rng = np.random.default_rng(7)
    near = []
    for n in range(60):  # groups around the limit, of various sizes
        w = list(base[n % 3])[: 40 + 7 * (n % 5)]
        for at in rng.integers(0, len(w), 1 + n % 4):
            w[at] = f"edit{n}"
        near.append((20000 + n, " ".join(w)))
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.join(docs, k, percent, most_frequent=most).collect()}
    assert got == brute_join(rows(docs), k, percent)


def test_signatures_meet(monkeypatch):
    """Any two sets at the limit share a signature, whatever tokens are frequent."""
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 64, 100, 333]:
        for _ in range(6):
            pool = np.unique(rng.integers(1, 2**63, 3 * n, dtype=np.uint64))
            x = np.sort(rng.permutation(pool)[:n])
            m = int(rng.integers(0, n // 5 + 1))
            y = np.sort(np.concatenate([rng.permutation(x)[m:], rng.integers(1, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if 100 * shared < 80 * (len(x) + len(y) - shared):
                continue
            often = rng.random() < 0.5
            mark = lambda s: (s % np.uint64(10) < 8) if often else np.ones(len(s), bool)  # noqa: B023, E731
            assert len(np.intersect1d(simjoin.signatures(x, mark(x), 80), simjoin.signatures(y, mark(y), 80)))
            bits = [np.frombuffer(simjoin.parity(s), np.uint64) for s in sorted((x, y), key=len, reverse=True)]
            assert len(simjoin._near(bits, np.array(sorted((len(x), len(y)), reverse=True)), 0, np.array([1]), 80)) == 1


def test_join_of_repeated_and_null_ids(spark, empty):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    df = spark.createDataFrame([(3, t), (3, t), (None, t), (5, t + " z2"), (7, "other words are here now")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simjoin.join(df).collect()), key=str)
    assert got == [(3, 3), (3, 3), (5, 3), (7, 7), (None, 3)]
    assert simjoin.join(empty).count() == 0
    full = df.select("*", F.lit("en").alias("lang"))
    assert sorted(r.doc_id for r in simjoin.keep(full).collect()) == [3, 7]


def test_long_lists_are_cut_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "BLOCK", 8)
    monkeypatch.setattr(simjoin, "MIN_DF", 3)
    base = [f"t{i}" for i in range(120)]
    rng = np.random.default_rng(2)
    data = []
    for n in range(50):
        w = list(base)
        for at in rng.integers(0, 120, 3):
            w[at] = f"e{n}"
        data.append((n, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in simjoin.join(df, 3, 80).collect()}
    assert got == brute_join(data, 3, 80)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 201)]
    df = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.component for r in components.components(df, "u", "v").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components.components(df.limit(0), "u", "v").count() == 0


# ------------------------------------------------------------------ 3
def test_scores(corpus, empty):
    held = crc_mod("doc_id", 7) == 2
    got = {r.doc_id: r for r in pitman_yor.score(corpus, held, shard=20000).collect()}
    docs = rows(corpus)
    assert set(got) == {i for i, _ in docs}
    counts = collections.Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        tokens, r = [*words(t), None], got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and (r.n_tokens, r.train_tokens) == (len(tokens), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), rel=1e-9)
        assert r.score <= 1e-9 and math.isfinite(r.score)
    test = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    again = {r.doc_id: r.score for r in pitman_yor.score(corpus, held, shard=20000).collect()}
    assert all(again[i] == pytest.approx(r.score, rel=1e-5) for i, r in got.items())
    assert pitman_yor.score(empty, held).count() == 0
    assert {r.score for r in pitman_yor.score(corpus.limit(5), F.lit(True)).collect()} == {0.0}


def test_probabilities_share_one_mass(spark):
    """Texts that differ in one word share at most the whole mass."""
    rng = np.random.default_rng(1)
    vocabulary = [f"v{i}" for i in range(30)]
    data = [(i, " ".join(rng.choice(vocabulary, 40))) for i in range(60)]
    probe = [(1000 + i, f"v3 {w}") for i, w in enumerate([*vocabulary, "unseen"])]
    df = spark.createDataFrame(data + probe, "doc_id long, text string")
    for shard in (400, 100000):  # with divided contexts and without
        got = {r.doc_id: r.score for r in pitman_yor.score(df, F.col("doc_id") >= 1000, shard=shard).collect()}
        assert 0 < sum(10**x for i, x in got.items() if i >= 1000) <= 1.0


class Restaurant:
    """The plain sampler: every customer has a table, and moves one at a time."""

    def __init__(self, d, strength, parent, base=None):
        self.d, self.strength, self.parent, self.base, self.tables, self.c, self.t = d, strength, parent, base, collections.defaultdict(list), 0, 0

    def above(self, w):
        return self.parent.prob(w) if self.parent else self.base

    def prob(self, w):
        own = self.tables.get(w, ())
        return (sum(own) - self.d * len(own) + (self.strength + self.d * self.t) * self.above(w)) / (self.strength + self.c)

    def add(self, w, rng):
        own = self.tables[w]
        weights = np.array([*(x - self.d for x in own), (self.strength + self.d * self.t) * self.above(w)])
        k = int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right"))
        self.c += 1
        if k < len(own):
            own[k] += 1
            return
        own.append(1)
        self.t += 1
        if self.parent:
            self.parent.add(w, rng)

    def remove(self, w, rng):
        own = self.tables[w]
        k = int(np.searchsorted(np.cumsum(own), rng.random() * sum(own), "right"))
        self.c -= 1
        own[k] -= 1
        if not own[k]:
            own.pop(k)
            self.t -= 1
            if self.parent:
                self.parent.remove(w, rng)


def test_scores_equal_a_plain_sampler(spark):
    """Within 2 % of the log-probabilities that moving one customer at a time gives."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{int(rng.zipf(1.4)) % 200}"
    phrases = [[word() for _ in range(4)] for _ in range(40)]
    text = lambda: " ".join(x for _ in range(12) for x in (phrases[int(rng.integers(40))] if rng.random() < 0.6 else [word()]))
    data = [(i, text()) for i in range(90)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.score(df, F.col("doc_id") >= 70).collect()}
    grams = lambda t: [(a, b, w) for x in [["<", "<", *t.split(), ">"]] for a, b, w in zip(x, x[1:], x[2:], strict=False)]
    train = [g for i, t in data if i < 70 for g in grams(t)]
    c3, v = collections.Counter(train), len({w for *_, w in train})
    kinds = lambda c: [sum(x == k for x in c.values()) for k in (1, 2)]
    c2 = collections.Counter((b, w) for _, b, w in c3)
    c1 = collections.Counter(w for _, w in {(b, w) for _, b, w in c3})
    root = Restaurant(pitman_yor.discount(*kinds(c1)), 10.0, None, 1 / (v + 1))
    two = collections.defaultdict(lambda: Restaurant(pitman_yor.discount(*kinds(c2)), 1.0, root))
    three = {}
    for a, b, _ in c3:
        three.setdefault((a, b), Restaurant(pitman_yor.discount(*kinds(c3)), 1.0, two[b]))
    for a, b, w in train:
        three[a, b].add(w, rng)
    total = collections.Counter()
    for sweep in range(14):
        for i in rng.permutation(len(train)):
            a, b, w = train[i]
            three[a, b].remove(w, rng)
            three[a, b].add(w, rng)
        if sweep >= 6:
            for i, t in data:
                for a, b, w in grams(t):
                    room = three.get((a, b)) or two.get(b) or root
                    total[i, a, b, w] += room.prob(w) / 8
    for held in (False, True):
        want = {i: sum(math.log10(total[i, *g] / grams(t).count(g)) for g in grams(t)) for i, t in data if (i >= 70) == held}
        assert sum(got[i] for i in want) == pytest.approx(sum(want.values()), rel=0.02)
        assert np.median([abs(got[i] / x - 1) for i, x in want.items()]) < 0.03


def test_scores_do_not_depend_on_layout(spark, corpus):
    held = crc_mod("doc_id", 7) == 2
    docs = corpus.select("doc_id", "text")
    want = {r.doc_id: r.score for r in pitman_yor.score(docs.coalesce(1), held).collect()}
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.doc_id: r.score for r in pitman_yor.score(docs.repartition(16), held).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert got == pytest.approx(want, rel=1e-9)


def test_many_rows_in_one_batch(spark):
    """More documents in one Arrow batch than 16 bits can number."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    try:
        df = spark.range(70000).selectExpr("id AS doc_id", "CASE WHEN id % 20 = 0 OR id > 69990 THEN 'four words are here' ELSE '' END AS text").coalesce(1)
        got = pitman_yor.score(df, F.col("doc_id") % 7 == 2).filter("doc_id >= 69990").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 10 and all(r.n_known == r.n_tokens == (5 if r.doc_id > 69990 else (5 if r.doc_id % 20 == 0 else 1)) and r.score < 0 for r in got)


def test_rare_words_keep_their_own_counts(corpus, monkeypatch):
    """Words beyond those that are broadcast keep their own probabilities."""
    held = crc_mod("doc_id", 7) == 2
    want = {r.doc_id: r.score for r in pitman_yor.score(corpus, held).collect()}
    monkeypatch.setattr(pitman_yor, "TOP", 64)
    got = {r.doc_id: r.score for r in pitman_yor.score(corpus, held).collect()}
    assert got == pytest.approx(want, rel=0.03)  # the first seating starts from other probabilities of rare words


def test_rows_that_repeat_or_lack_an_id_are_scored(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, "a b")], "doc_id long, text string").withColumns({"k": F.lit(1), "t": F.lit("x"), "h": F.lit(2)})
    got = sorted(((r.doc_id, r.n_tokens, round(r.score, 9)) for r in pitman_yor.score(df, F.col("doc_id") == 3).collect()), key=str)
    assert [g[:2] for g in got] == [(1, 4), (1, 4), (2, 1), (3, 3), (None, 4)] and got[0] == got[1] and got[0][2] == got[4][2]


def test_replies_grow_with_tokens():
    """A shard answers for the documents that it has tokens of, however many its chunk holds; merged answers are sums of both."""
    rng = np.random.default_rng(1)
    for n in (10, 1000):
        doc, value = rng.integers(0, 30000, n), rng.random(n)
        docs, sums, ones = pitman_yor.by_document(doc, value, np.ones(n))
        assert len(docs) == len(set(doc.tolist())) <= n and docs.dtype == np.uint16 and ones.sum() == n
        assert sums == pytest.approx([value[doc == d].sum() for d in docs])
    a, b = (pitman_yor.by_document(np.array(d), np.array(v)) for d, v in (([5, 1, 5], [1.0, 2.0, 3.0]), ([1, 9], [4.0, 5.0])))
    assert [x.tolist() for x in pitman_yor.by_document(*(np.concatenate(x) for x in zip(a, b, strict=True)))] == [[1, 5, 9], [6.0, 4.0, 5.0]]


def test_seating_is_exact():
    """Tables drawn at once are distributed as those of customers who move one at a time."""
    rng = np.random.default_rng(0)
    ways = pitman_yor.stirling(64, 0.4)
    assert np.exp(ways[3, 1:4]) == pytest.approx([0.6 * 1.6, 3 * 0.6, 1.0])
    for c, others, strength, p in ((2, 3.0, 1.0, 0.2), (9, 20.0, 1.0, 0.3), (40, 100.0, 2.0, 0.05)):
        n = 4000
        got = pitman_yor.seat(np.full(n, c), np.full(n, others), strength, 0.4, (np.full(n, 1e9 * p), np.full(n, 0.0), np.full(n, 1e9)), ways, rng)
        tables, t = [c], []
        for step in range(3000 * c // 4):
            k = int(np.searchsorted(np.cumsum(tables), rng.random() * c, "right"))
            tables[k] -= 1
            tables = [x for x in tables if x]
            weights = np.array([*(x - 0.4 for x in tables), (strength + 0.4 * (others + len(tables))) * p])
            k = int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum(), "right"))
            tables = [*tables, 1] if k == len(tables) else [x + (i == k) for i, x in enumerate(tables)]
            if step > 100:
                t.append(len(tables))
        assert got.mean() == pytest.approx(np.mean(t), rel=0.08) and (got >= 1).all() and (got <= c).all()
    for c, a, b, d in ((5, 0.7, 0.1, 0.4), (60, 2.0, 0.3, 0.8), (300, 0.05, 0.0, 0.2)):
        got = pitman_yor._sequence(np.full(4000, c), np.full(4000, a), np.full(4000, b), d, rng)
        plain = np.ones(4000)
        for k in range(1, c):
            new = a + b * plain
            plain += rng.random(4000) < new / (new + k - d * plain)
        assert got.mean() == pytest.approx(plain.mean(), rel=0.06) and got.std() == pytest.approx(plain.std(), rel=0.1)


# ------------------------------------------------------------------ 4
def test_fingerprints(spark, corpus, empty):
    got = {r.doc_id: r for r in fingerprints.neighbours(corpus).collect()}
    docs = sorted(rows(corpus), reverse=True)
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(corpus).collect()}
    errors = []
    shingles = lambda t: set(zip(*[w[j:] for j in range(5)], strict=False)) if len(w := words(t)) >= 5 else {tuple(w)} if words(t) else set()
    for n, (i, t) in enumerate(docs):
        t, other, r = t or "", docs[(n + 1) % len(docs)][1] or "", got[i]
        third = len(t) // 3
        want = t[: len(t) - third] + other[:third]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.fingerprint == prints[i]
        a, b = shingles(t), shingles(want)
        if len(a) > 200:
            errors.append(abs(r.near_edited - len(a & b) / len(a | b)))
        own, after, following = (fingerprints.from_text(x) for x in (r.fingerprint, r.edited_fingerprint, prints[docs[(n + 1) % len(docs)][0]]))
        for value, y in ((r.near_edited, after), (r.near_next, following)):
            x, y = set(own.tolist()), set(y.tolist())
            assert value == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
    assert np.mean(errors) < 0.06
    texts = collections.defaultdict(set)
    for i, t in docs:
        texts[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in texts.values())
    assert fingerprints.neighbours(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert fingerprints.neighbours(one).first().near_next == 1.0
    tied = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "z z")], "doc_id long, text string")
    assert fingerprints.neighbours(tied).count() == 4


def test_sketches_merge_and_contain():
    import pyarrow as pa

    big, small = (" ".join(f"w{i}" for i in range(n)) for n in (4000, 400))
    a, b, c = fingerprints.sketches(pa.array([big, small, None]))
    assert fingerprints.containment(b, a) == 1.0 and fingerprints.containment(a, b) == pytest.approx(0.1, abs=0.03)
    assert (fingerprints.merge(a, b) == a).all() and len(c) == 0 and fingerprints.likeness(c, c) == 1.0 and fingerprints.likeness(c, a) == 0.0
    assert (fingerprints.from_text(fingerprints.text_of(a)) == a).all()


def test_merged_sketches_are_those_of_unions():
    """Also where a sketch has a stand-in only; members are those of a plain sketch."""
    import pyarrow as pa

    from sparkprep.llm.common import hash_spans, shingle_hashes
    from sparkprep.llm.common import words as spans

    limit = int(fingerprints.FRACTION * (1 << 32))

    def hashes(t):
        data, starts, ends, counts = spans(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        return {int(x) >> 32 for x in shingle_hashes(hash_spans(data, starts, ends), counts, 5)[0]}

    texts = [" ".join(f"t{i}w{j}" for j in range(4 + i % 9)) for i in range(60)]
    low = [sorted(x for x in h if x < limit) or [min(h)] for h in map(hashes, texts)]
    found = fingerprints.sketches(pa.array(texts))
    assert [f.tolist() for f in found] == low and any(x[0] >= limit for x in low) and any(x[0] < limit for x in low)
    for i in range(59):
        h = hashes(texts[i]) | hashes(texts[i + 1])
        assert fingerprints.merge(found[i], found[i + 1]).tolist() == (sorted(x for x in h if x < limit) or [min(h)])
    alone = next(f for f in found if f[0] >= limit)
    other = next(f for f in found if f[0] < limit)
    assert math.isnan(fingerprints.containment(alone, other)) and fingerprints.containment(alone, alone) == 1.0


# ------------------------------------------------------------------ 5
def test_kneser_ney_is_a_distribution(spark, corpus):
    model = quality.train(corpus.filter("length(text) BETWEEN 100 AND 5000").select("text"))
    for context in (b"\n\n\n\n", b"the ", b"zq#x"):
        code = np.array([int.from_bytes(context + bytes([i])) for i in range(256)], np.uint64)
        assert 2.0 ** -quality.bits(model, code) @ np.ones(256) == pytest.approx(1, abs=1e-4)


class PlainKneserNey:
    """Interpolated modified Kneser-Ney over bytes, from dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {order: collections.Counter()}
        for t in texts:
            raw = b"\n" * (order - 1) + t.encode()
            self.counts[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
        for k in range(order - 1, 0, -1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.total, self.gamma = {}, {}, {}
        for k, c in self.counts.items():
            n = [sum(x == i for x in c.values()) for i in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            self.d[k] = [max(0.1, min(i - 0.1, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 * i for i in (1, 2, 3)]
            self.total[k], lost = collections.Counter(), collections.Counter()
            for g, x in c.items():
                self.total[k][g[:-1]] += x
                lost[g[:-1]] += self.d[k][min(x, 3) - 1]
            self.gamma[k] = {h: lost[h] / self.total[k][h] for h in lost}

    def p(self, g):
        k = len(g)
        below = self.p(g[1:]) if k > 1 else 1 / 256
        if g[:-1] not in self.gamma[k]:
            return below
        x = self.counts[k][g]
        own = (x - self.d[k][min(x, 3) - 1]) / self.total[k][g[:-1]] if x else 0.0
        return own + self.gamma[k][g[:-1]] * below

    def bits(self, text):
        raw = b"\n" * (self.order - 1) + text.encode()
        return -sum(math.log2(self.p(raw[i : i + self.order])) for i in range(len(raw) - self.order + 1))


def test_quality_equals_a_plain_model(spark, corpus):
    """Perplexities, thresholds and decisions."""
    docs = corpus.filter("length(text) BETWEEN 20 AND 1500 AND doc_id < 9000").select("doc_id", "text", "lang").limit(90)
    docs = docs.unionByName(spark.createDataFrame([(1, "qq zz 01 xx" * 40, "en"), (-5, "", None), (None, "zz qq ww", "en")], "doc_id long, text string, lang string"))
    every = {(r.doc_id, r.text): r for r in docs.collect()}
    labels = docs.filter("doc_id % 3 != 0 AND doc_id > 1").select("doc_id")
    half = {r[0] for r in labels.distinct().filter("pmod(xxhash64(doc_id, 1), 2) = 0").collect()}
    model = PlainKneserNey([r.text for r in every.values() if r.doc_id in half], quality.ORDER)
    got = quality.judge(docs, labels, extra=["text"]).collect()
    assert len(got) == len(every)
    bits = {k: model.bits(r.text or "") for k, r in every.items()}
    trusted = [k for k, r in every.items() if r.doc_id is not None and r.doc_id > 1 and r.doc_id % 3 and r.doc_id not in half and r.text]
    rank = lambda x, q: sorted(x)[max(0, math.ceil(q * len(x)) - 1)]

    def by(values, q):
        overall = rank(values.values(), q)
        langs = {every[k].lang for k in values} - {None}
        own = {x: [v for k, v in values.items() if every[k].lang == x] for x in langs}
        return {None: overall, **{x: (len(v) * rank(v, q) + quality.PRIOR_DOCS * overall) / (len(v) + quality.PRIOR_DOCS) for x, v in own.items()}}

    size = {k: len((r.text or "").encode()) for k, r in every.items()}
    median = by({k: bits[k] / size[k] for k in trusted}, 0.5)
    middle = lambda k: median.get(every[k].lang, median[None])
    judged = {k: (bits[k] + quality.PRIOR_BYTES * middle(k)) / (size[k] + quality.PRIOR_BYTES) for k in every}
    limit = by({k: judged[k] for k in trusted}, quality.UPPER)
    for r in got:
        k = (r.doc_id, r.text)
        assert r.bits_per_byte == (pytest.approx(bits[k] / size[k], rel=1e-4) if size[k] else None)
        assert r.judged == pytest.approx(judged[k], rel=1e-4) and r.threshold == pytest.approx(limit.get(r.lang, limit[None]), rel=1e-4)
        assert r.kept == (r.judged <= r.threshold)
    assert not next(r for r in got if r.doc_id == 1).kept and next(r for r in got if r.doc_id == -5).kept


def test_quality_separates(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = quality.judge(docs, quality.trusted_labels(spark, d)).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2
    kept = quality.keep(spark, docs, d)
    assert kept.columns == docs.columns and 0.8 * docs.count() < kept.count() < docs.count()


def test_quality_of_awkward_rows(spark, corpus, empty):
    labels = corpus.select("doc_id")
    got = {r.doc_id: r for r in quality.judge(corpus, labels, extra=["_key", "id"]).collect()}
    assert len(got) == corpus.count() and got[9001].kept and got[9002].kept and got[9001]["_key"] == "x"
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(corpus, labels.limit(0)).filter("kept").count() == corpus.count()


def test_languages_of_few_documents_have_their_own_thresholds(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = quality.judge(docs, quality.trusted_labels(spark, d)).filter("lang IS NOT NULL").select("lang", "threshold").distinct().collect()
    at = {r.lang: r.threshold for r in got}
    assert len(got) == len(at) == len(set(at.values())) == 4


@pytest.fixture(scope="module")
def many_trusted(spark):
    """Some 4,500 short documents of the training fold, each with characters of its own."""
    texts = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words "), F.md5(F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    return texts.repartition(3).cache()


def test_all_trusted_documents_of_the_fold_train(spark, many_trusted):
    first = many_trusted.filter("pmod(xxhash64(doc_id, 1), 2) = 0")
    model = PlainKneserNey([r.text for r in first.collect()], quality.ORDER)
    got = quality.judge(many_trusted, many_trusted.select("doc_id"), extra=["text"])
    seen = got.join(first.select("doc_id"), "doc_id")
    assert seen.count() > 4000
    for r in seen.orderBy(F.desc(F.xxhash64("doc_id"))).limit(40).collect():
        assert r.bits_per_byte == pytest.approx(model.bits(r.text) / len(r.text), rel=1e-4)


@pytest.mark.parametrize("most", [0, 300, 3000])
def test_a_model_too_large_to_broadcast_scores_alike(spark, corpus, most, monkeypatch):
    """Also with long texts in pieces, and with repeated ids, rows and nulls."""
    docs = corpus.unionByName(corpus.limit(3)).unionByName(corpus.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    labels = corpus.filter("doc_id % 3 = 0").select("doc_id")
    columns = ["doc_id", "lang", "_key", "text", "bits_per_byte", "judged", "threshold", "kept"]

    def judged():
        return sorted(map(tuple, quality.judge(docs, labels, extra=["_key", "text"]).select(*columns).collect()), key=str)

    want = judged()
    monkeypatch.setattr(quality, "MODEL_GRAMS", most)
    monkeypatch.setattr(quality, "COUNT_BYTES", 5000)
    monkeypatch.setattr(quality, "SCORE_BYTES", 700)
    got = judged()
    assert len(got) == docs.count() and [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[4] == (pytest.approx(b[4], rel=1e-5) if b[4] is not None else None)
        assert a[5:7] == pytest.approx(b[5:7], rel=1e-5) and a[7] == b[7]


def test_hash_table():
    keys = np.random.default_rng(0).permutation(np.arange(1, 20001, dtype=np.uint64) * np.uint64(8) + np.uint64(3))
    table = quality.hash_table(keys[:10000], np.arange(10000, dtype=np.float32))
    hit, x = quality.find(table, keys)
    assert hit[:10000].all() and not hit[10000:].any() and (x[:10000] == np.arange(10000)).all()


# ------------------------------------------------------------------ 6
def test_language(spark, corpus, empty):
    docs = corpus.withColumn("held_out", crc_mod("doc_id", 3) == 1)
    model = langid.train(docs.filter(~F.col("held_out")))
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id", "held_out", "lang"]).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 9000]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(got[i].lang_pred == "und" for i in (9001, 9002, 9003, 9009)) and got[9008].lang_pred in model[0]
    assert all(0 <= r.score <= 1 for r in got.values())
    swapped = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    assert {r.doc_id: r.lang_pred for r in langid.predict(swapped, model, ["doc_id"]).collect()} == {i: r.lang_pred for i, r in got.items()}
    assert langid.predict(empty, model, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.predict(corpus, langid.train(empty), ["doc_id"]).collect()} == {"und"}


def plain_slots(text):
    """The slots of the n-grams of a text, one code point at a time."""
    points, out = [ord(c) for c in (text or "").lower()], []
    for n in langid.ORDERS:
        for i in range(len(points) - n + 1):
            acc = 0
            for j in range(n):
                acc = ((acc ^ points[i + j]) * 0x01000193 + j + 1) & 0xFFFFFFFF
            h = ((acc ^ (acc >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
            out.append((h >> 16) % langid.SLOTS)
    return out


def test_language_equals_plain_bayes(spark, corpus):
    docs = corpus.filter("length(text) < 3000 OR text IS NULL").select("doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    every = docs.collect()
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for r in every:
        if not r.held_out and r.text is not None and r.lang is not None:
            counts[r.lang].update(plain_slots(r.text))
            n[r.lang] += 1
    langs, total = sorted(counts), {x: sum(c.values()) for x, c in counts.items()}
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs.filter("NOT held_out")), ["doc_id"]).collect()}
    for r in every:
        logs = {x: math.log(n[x] / sum(n.values())) + sum(math.log((counts[x][s] + 0.5) / (total[x] + 0.5 * langid.SLOTS)) for s in plain_slots(r.text)) for x in langs}
        best = max(langs, key=lambda x: logs[x])
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        share = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(share, abs=1e-3)


# ------------------------------------------------------------------ 7
def brute_lines(docs, hashes, depth=line_dedup.DEPTH):
    """The rule of templates, line by line; hashes are only used to choose each template's centre."""
    at, out = collections.defaultdict(list), {}
    wide = lambda x: re.search("[\u0800-\u1fff\u3000-\ud7ff]", x)
    form = lambda x: re.search("[0-9@/]", x) and not wide(x)
    for i, t in docs:
        for j, line in enumerate((t or "").split("\n") if t is not None else []):
            w = [re.sub("[0-9]", "0", x) if wide(x) and len(re.sub("[0-9@/]", "", x).encode()) >= 12 else x for x in words(line)]
            constant = sum(not form(x) for x in w)
            w = tuple("*" if form(x) and constant >= 2 and 2 * constant >= len(w) else x for x in w)
            if any(re.search(r"\w", x) for x in words(line)):
                at[w].append((i, j))
    leaves = collections.defaultdict(list)
    text = dict(docs)
    for w in at:
        leaves[len(w), w[:depth]].append(w)
    named = {}
    for leaf in leaves.values():
        plain = {w: [p for p, x in enumerate(w) if x != "*" and not form(x)] for w in leaf}
        fit = [w for w in leaf if len(plain[w]) > 4]
        if len({text[i] for w in fit for i, _ in at[w]}) < 2:
            continue
        seen = collections.Counter((p, w[p]) for w in fit for p in plain[w])
        groups = collections.defaultdict(list)
        for w in fit:
            by = sorted(seen[p, w[p]] for p in plain[w])
            level = by[int(len(by) * 0.3)]
            fields = [p for p in plain[w] if 3 * seen[p, w[p]] <= level]
            if fields and len(by) - len(fields) >= 4:
                groups[tuple((0,) if p in fields else x for p, x in enumerate(w))].append(w)
        for name, members in groups.items():
            if len(members) >= 3:
                named.update((w, ("field", name)) for w in members)
    lines = collections.defaultdict(list)
    for w, o in at.items():
        lines[named.get(w, w)] += [(i, j, w) for i, j in o]
    shingles = {i: set(zip(*[w[j:] for j in range(5)], strict=False)) if len(w := words(t)) >= 5 else {tuple(w)} for i, t in docs if t is not None}
    drop = collections.defaultdict(set)
    for o in lines.values():
        centre = min({i for i, _, _ in o}, key=lambda i: hashes[i])
        a = shingles[centre]
        if any(text[i] != text[centre] and len(a & shingles[i]) < 0.8 * len(a | shingles[i]) for i, _, _ in o):
            first, kept = min(i for i, _, _ in o), set()
            for i, j, w in sorted(o, key=lambda x: x[:2]):
                if i == first and w not in kept:
                    kept.add(w)
                else:
                    drop[i].add(j)
    for i, t in docs:
        out[i] = t if t is None or i not in drop else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in drop[i])
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_lines_equal_brute_force(spark, corpus, empty, depth):
    letter = lambda i: f"To {chr(65 + i)}nna\nDear Mr Sm{chr(97 + i)}th thank you for writing\nyours {chr(107 + i)}ly"
    extra = [(9200, "head\nAn order 17 was sent to a@b.c\ntail x y\n"), (9201, "top\nan order 9918 was sent to x@y\nfoot\n\n"), (9202, "\n\n"), (9203, "a b c\na b c\na b c"), (9204, "p1 is here now\nshared first line x\nshared second line x\np1 ends here now"), (9205, "p2 was there then\nalso p2 text here\nshared first line x\nshared second line x\np2 ends at last"), *((9210 + i, letter(i)) for i in range(6))]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs, depth=depth).collect()}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    assert got == brute_lines(rows(docs), hashes, depth)
    assert got[9204] == extra[4][1] and got[9205] == "p2 was there then\nalso p2 text here\np2 ends at last"
    assert got[9200] == extra[0][1] and got[9201] == "top\nfoot\n\n"
    # The name is a field unless it is one of the leading tokens that choose the leaf; the other lines are too short.
    assert [got[9210 + i].count("\n") for i in range(6)] == ([2] * 6 if depth == 3 else [2] + [1] * 5)
    whole = line_dedup.keep(corpus)
    assert whole.columns == corpus.columns and line_dedup.dedup(empty).count() == 0


def dropped(spark, lines, **options):
    """How many of these lines go, each put into a document of other words."""
    docs = [(i, f"{' '.join(f'x{i}y{j}z'.translate(str.maketrans('0123456789', 'abcdefghij')) for j in range(30))}\n{line}") for i, line in enumerate(lines)]
    return line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **options).agg(F.sum("__sp_dropped")).first()[0]


def test_rows_of_fields_stay(spark):
    """Different rows of numbers, hashes and links are different lines, however many there are; equal ones recur."""
    rng = np.random.default_rng(3)
    rows_ = ["2019 141 77 5.2", "1998 8 3012 0.1", "10:30 9/4 a1 b2", "total 4 5 6", "total 7 8 9", "12円 34円", "56円 78円"]
    rows_ += [" ".join(str(x) for x in rng.integers(0, 10**6, 6)) for _ in range(30)] + [" ".join(f"q{x}w" for x in rng.integers(0, 10**6, 40)) for _ in range(10)]
    rows_ += [f"0 0 0 0 0 0 {i}" for i in range(9)] + [f"north 0 south 0 east {x}" for x in ("a", "b", "c")]
    assert dropped(spark, rows_) == 0
    assert dropped(spark, ["1 2 3 4", "page 3 of the book", "1 2 3 4", "page 14 of the book"]) == 2


def test_fields_may_repeat(spark):
    names = ["smith", "jones", "baker", "cook", "mason", "weaver"]
    story = [f"this story was posted by {a} in our {s} pages for all readers today" for a in names for s in ("news", "sports", "travel", "money", "science")]
    assert dropped(spark, story) == 29
    assert dropped(spark, [f"posted by {a} in news" for a in names]) == 5
    assert dropped(spark, [f"the night watch was led by captain {a}{b} until dawn" for a in names for b in ("a", "b", "c")[: 2 + (a > "m")] for _ in range(2)]) == 29
    assert dropped(spark, [f"dear {a} thank you for writing to us" for a in names], depth=1) == 5
    assert dropped(spark, [f"dear {a} thank you for writing to us" for a in names]) == 0


def test_lines_of_other_constants_stay(spark):
    """Lines of one leaf that share most tokens, each with another rest, and lines that differ in more than the fields allowed."""
    letters = "abcdefghijklmnopqrst"
    assert dropped(spark, [f"we saw that {a}{b} {b}{a} {a}{a} went {b}{b}" for a, b in zip(letters, letters[::-1], strict=True)]) == 0
    # Two templates in one leaf that differ in a constant: one line of each stays.
    both = [f"we saw that mister {a}{a} went {w} again" for a in letters for w in ("home", "away")]
    assert dropped(spark, both) == len(both) - 2


def test_refrain_of_one_document_stays(spark):
    song = "verse one is new\nrefrain line sung again\nverse two is newer\nrefrain line sung again\nverse three is last"
    df = spark.createDataFrame([(1, song), (1, song), (None, "other text of one line")], "doc_id long, text string")
    assert line_dedup.dedup(df).filter("__sp_dropped > 0").count() == 0
    both = df.unionByName(spark.createDataFrame([(2, "a poem\nrefrain line sung again\nby someone else entirely")], "doc_id long, text string"))
    assert {r.doc_id: r.n for r in line_dedup.dedup(both).selectExpr("doc_id", "__sp_dropped AS n").distinct().collect()} == {1: 1, 2: 1, None: 0}


def test_short_lines_by_parameter(spark):
    df = spark.createDataFrame([(i, f"text {'abc'[i] * 3} of its own kind\nRead more\nend {'xyz'[i] * 4} of that") for i in range(3)], "doc_id long, text string")
    assert line_dedup.dedup(df).filter("__sp_dropped > 0").count() == 2 and line_dedup.dedup(df, least=3).filter("__sp_dropped > 0").count() == 0


def test_line_of_copies_stays(spark):
    text = "one line of words\nanother line of words\nlast line of words"
    df = spark.createDataFrame([(i, text) for i in range(5)] + [(None, text)], "doc_id long, text string")
    assert line_dedup.dedup(df).filter("__sp_dropped > 0").count() == 0


def test_lines_of_different_documents_recur(spark):
    """Boilerplate at both ends, or most of a document, recurs wherever it stands; whole near copies stay."""
    own = lambda i, n: "\n".join(" ".join(f"{c}{'abcdefghij'[i]}{'klmnopqrst'[j]}{c}" for c in "uvwxyz") for j in range(n))
    ends = [(i, f"top line of site\nsecond line of site\n{own(i, 3)}\nfoot line of site\nlast line of site") for i in range(3)]
    shared = "\n".join(f"a shared passage {'abcde'[j]} has many words in a row" for j in range(5))
    start = [(10 + i, f"{shared}\n{own(3 + i, 3)}") for i in range(3)]
    copy = own(8, 10)
    near = [(20, copy), (21, copy.replace("zikz", "other"))]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(ends + start + near, "doc_id long, text string")).collect()}
    assert got[0] == ends[0][1] and got[10] == start[0][1]
    assert [got[i] for i in (1, 2, 11, 12)] == [own(1, 3), own(2, 3), own(4, 3), own(5, 3)]
    assert all(got[i] == t for i, t in near)


def test_short_and_unspaced_lines_recur(spark):
    """Lines of one or two tokens, of scripts without spaces too; but not marks, or lines that differ in their only tokens."""
    lines = ["And so.", "Yes", "本文はすべての文書にある長い行です。", "本文の第1章です", "https://example.org/a/long/link/1", "---", "。"]
    own = [["alpha beta gamma", "10", "二〇一年に書かれた行で、価格は5円"], ["delta epsilon zeta", "11", "別の文書の行で、価格は7円"], ["eta theta iota", "12", "三つ目の文書の行で、価格は9円"]]
    texts = ["\n".join([o[0], *lines, *o[1:], f"https://example.org/{'abc'[i]}", f"本文の第{i + 2}章です", "end of " + o[0]]) for i, o in enumerate(own)]
    got = [r.text for r in line_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == texts[0].replace("\n本文の第2章です", "")
    for i in (1, 2):
        assert got[i].split("\n") == [own[i][0], "---", "。", *own[i][1:], f"https://example.org/{'abc'[i]}", "end of " + own[i][0]]


# ------------------------------------------------------------------ 8
def water(sizes, weights, cap):
    free, left, out = set(sizes), float(sum(sizes.values())), {}
    while True:
        w = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / w > cap * sizes[s]}
        if not over:
            return {**out, **{s: left * weights[s] / w for s in free}}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= over


@pytest.mark.parametrize("sizes", [[5, 100, 7, 1000, 30, 2], [10, 10, 10], [1, 1000000, 3, 900, 1], [0, 5, 9], [7]])
def test_water_filling(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, [5, 2, 1], 3).collect()}
    want = water(dict(zip(names, sizes, strict=True)), dict(zip(names, [5, 2, 1] * 5, strict=False)), 3)
    assert got == pytest.approx(want)


def test_mixing(spark, corpus, empty):
    got = mixing.mix(corpus, [5, 2, 1]).collect()
    size = {i: len(words(t)) for i, t in rows(corpus)}
    assert all(r["size"] == size[r.doc_id] and r.taken == r.times * r["size"] and 0 <= r.times <= 3 for r in got)
    source = {r.doc_id: r.source for r in corpus.collect()}
    for s in set(source.values()):
        own = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    again = {r.doc_id: r.taken for r in mixing.mix(corpus.repartition(7), [5, 2, 1]).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    mixed = mixing.repeat(corpus, mixing.mix(corpus, [5, 2, 1]))
    assert mixed.count() == sum(r.times for r in got) and mixed.columns == corpus.columns
    assert mixing.mix(empty, [5, 2, 1]).count() == 0


# ------------------------------------------------------------------ 9
def test_archive(spark):
    big, bad = "x" * 1500 + "é", "<p>" + "y" * 2000
    data = [(1, "http://a/1", big), (2, "http://a/2", big), (5, "http://a/\r\nX: 1", big), (3, None, "short"), (4, "u", "short"), (6, "u", None), (7, "u", bad), (None, "u", bad)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    headers, payloads = archive.write(pages)
    assert payloads.count() == 4
    got = {r.id: r for r in archive.read(headers, payloads).collect()}
    assert {i: r.record_type for i, r in got.items()} == {1: "revisit", 2: "revisit", 5: "response", 3: "response", 4: "response", 6: "response", 7: "response", None: "revisit"}
    assert got[1].refers_to == "5" and got[None].refers_to == "7" and got[5].refers_to is None
    for i, _, html in data:
        body = (html or "").encode()
        assert bytes(got[i].payload) == body and got[i].payload_digest == hashlib.sha1(body).hexdigest()
        block = body if got[i].record_type == "response" else b""
        assert bytes(got[i].record) == bytes(got[i].header) + block + b"\r\n\r\n"
        assert f"Content-Length: {len(block)}\r\n".encode() in bytes(got[i].header) and bytes(got[i].header).startswith(b"WARC/1.1\r\n")
    assert bytes(got[5].header).count(b"\r\nX: 1") == 0
    damaged = payloads.withColumn("payload", F.encode(F.lit("z"), "UTF-8"))
    with pytest.raises(Exception, match="damaged payload"):
        archive.read(headers, damaged).collect()
    assert archive.read(*archive.write(pages.limit(0))).count() == 0
    twice = archive.read(*archive.write(pages.unionByName(pages.filter("page_id = 5"))))
    assert twice.count() == 9


# ------------------------------------------------------------------ 10
def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype("float32")
    x[100:400] = x[100]  # a common vector
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(2001, None), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1.0] * 3), (2020, [])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in vectors.search(df, F.col("id") % 20 == 0, 10).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    data_2005 = np.array([1.0] * 3 + [0.0] * 13)  # shorter vectors are continued with zeros
    d = np.vstack([x.astype(float), data_2005])
    ids = [*range(1500), 2005]
    recall = []
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and q not in {v for _, v, _ in found}
        assert all(s == pytest.approx(float(d[q] @ d[ids.index(v)]), rel=1e-12) for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        s = d @ d[q]
        s[q] = -np.inf
        best = [ids[v] for v in sorted(range(1501), key=lambda v: (-s[v], v))[:10]]
        recall.append(len(set(best) & {v for _, v, _ in found}) / 10)
    assert np.mean(recall) >= 0.9
    assert [v for _, v, _ in got[200]] == [v for v in range(100, 111)][:10] or got[200][0][2] >= d[200] @ d[100] - 1e-9
    few = vectors.search(df.filter("vec_id < 5"), F.col("id") % 20 == 0, 10).collect()
    assert [r.vec_id for r in few] and len(few) == 4
    assert vectors.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_pairs_fall_with_the_size(spark):
    """Recall, and the share of all pairs that the index looks at, at two sizes."""
    share = []
    for n in (5000, 20000):
        x = np.random.default_rng(n).normal(size=(n, 32))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame(list(zip(range(n), x.tolist(), strict=True)), "vec_id long, embedding array<double>").repartition(4).cache()
        every = F.col("id") % 100 == 0
        posted, probing, *_ = vectors.postings(df, every, 20, "vec_id", "embedding")
        pairs = posted.groupBy("pivot").agg(F.count("*").alias("a")).join(probing.groupBy("pivot").agg(F.count("*").alias("b")), "pivot").agg(F.sum(F.col("a") * F.col("b"))).first()[0]
        share.append(pairs / n / (n // 100))
        got = collections.defaultdict(set)
        for r in vectors.search(df, every, 20).collect():
            got[r.query_id].add(r.vec_id)
        recall = []
        for q in range(0, n, 100):
            s = x @ x[q]
            s[q] = -np.inf
            recall.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
        assert np.mean(recall) >= 0.9
        df.unpersist()
    assert share[1] < 0.65 * share[0] and share[1] < 0.5


def test_equal_vectors_are_searched_once(spark):
    """A vector that half of the rows hold: exact answers for all its queries, crowded files in blocks."""
    x = np.random.default_rng(9).normal(size=(400, 8))
    x[200:] = x[200]
    df = spark.createDataFrame([*zip(range(400), x.tolist(), strict=True), (None, x[0].tolist()), (17, x[17].tolist())], "vec_id long, embedding array<double>").withColumns({"id": F.lit(5), "v": F.lit("z"), "of": F.lit(1)})
    got = collections.defaultdict(list)
    for r in vectors.search(df, F.col("id") % 50 == 0, 5, block=16).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    assert [v for _, v in sorted(got[200])] == [201, 202, 203, 204, 205] and [v for _, v in sorted(got[250])] == [200, 201, 202, 203, 204]
    assert set(got) == set(range(0, 400, 50))
