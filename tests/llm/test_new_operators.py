"""URL filters, source divergence and fill-in-the-middle against plain versions, and their awkward cases."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkprep.llm import divergence, rope, url_filter

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ------------------------------------------------------------------ 11
def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def plain_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "", "block"), ("org", "/fr/x", "block"), ("", "", "block")]


@pytest.mark.parametrize("most_blocks", [1, url_filter.MOST_BLOCKS])
def test_urls_equal_plain_rules(spark, most_blocks):
    """With one block for some two thousand entries nearly all hits are false, and the join removes them."""
    rng = np.random.default_rng(1)
    more = [(f"h{i}.example.{'com' if i % 2 else 'net'}", f"/{i % 13}/"[: i % 4 + 1], "block" if i % 3 else "allow") for i in range(1000)]
    rules = [*RULES, *more] if most_blocks == 1 else RULES
    urls = [None, "", "http:/x", "://", "http://", "http://NET/", "HTTP://A.b.Example.NET/en/1?x#y", "http://example.net/en", "x://net?a", "x://net#a/", "x://evilnet/", "a://b://net/", "http://a.org", "http://b.a.org/fr/x", "http://net./", "http://u@net:80/", "http://é.org/fr/\nü?é", "x://org/fr/" + "y" * 100000, "x://" + "a." * 3000 + "net/q"]
    hosts = [h for h, _, _ in rules]
    urls += [f"http://{'www.' * int(rng.integers(0, 3))}{hosts[int(rng.integers(len(hosts)))]}/{rng.choice(['en', 'de', 'fr', '1', '12'])}/{i}" for i in range(300)]
    rows = [*enumerate(urls), (0, urls[5]), (None, urls[6]), (3, urls[6]), (3, urls[6])]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, host string, rule string").repartition(4)
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), most_blocks=most_blocks)
    want = [(i, *plain_url(u), *plain_rule(*plain_url(u), rules)) for i, u in rows]
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    if most_blocks > 1:
        entries = url_filter.listed(spark.createDataFrame([r for r in rules if r[0]], "host string, path string, verdict string"))
        bloom, blocks = url_filter.build(entries)
        words = bloom.collect()
        assert blocks == 1 and len(words) == 1 and all(w < 2**63 for w in words[0][1:])


def test_filter_passes_few_others(spark):
    rules = spark.range(3000).selectExpr("concat('h', id, '.example') AS host", "'/' AS path", "'block' AS verdict")
    entries = url_filter.listed(rules)
    others = spark.range(20000).selectExpr("concat('o', id, '.example') AS host", "'/a' AS path")
    assert url_filter.hits(others, entries).count() <= 100
    assert url_filter.hits(rules.select("host", "path"), entries).count() == 3000


def test_urls_without_rows_or_rules(spark):
    pages, rules = spark.createDataFrame([(1, "http://net/")], "page_id int, url string"), spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert [tuple(r) for r in url_filter.judge(pages, rules.limit(0)).collect()] == [(1, "net", "/", None, "allow")]
    twice = spark.createDataFrame([("NET", "/", "allow"), ("net", "/", "block"), (None, None, "allow")], rules.schema)
    assert [tuple(r)[3:] for r in url_filter.judge(pages, twice, "block").collect()] == [("net/", "block")]


# ------------------------------------------------------------------ 12
def plain_audit(rows, least=3, top=200):
    docs = [(lower(t or ""), la or "", s or "") for t, la, s in rows]
    df, n, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(set)
    for t, la, s in docs:
        terms = TERM.findall(t)
        df[la].update(set(terms))
        n[la, s].update(terms)
        n[la, None].update(terms)
        groups[la].add(s)
    out = []
    for la, sources in groups.items():
        kept = sorted(t for t, c in df[la].items() if c >= least)
        p = {s: {t: 1 + 10**9 * (n[la, s][t] + 1) // (sum(n[la, s][x] for x in kept) + len(kept)) for t in kept} for s in [*sources, None]}
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            out += [(la, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted(((-f(p[s][t], p[None][t]), t) for t in kept if n[la, s][t] and p[s][t] > p[None][t]), key=lambda x: (x[0], x[1].encode()))
            out += [(la, s, "term", t, -v, i + 1) for i, (v, t) in enumerate(terms[:top])]
    return out


@pytest.fixture(scope="module")
def sourced(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ["straße", "été", "漢字", "a", "the", "ZEBRA", "\U0001f600x"] for b in ["", "b", "É", "zz"]]
    rows = [(None, "en", "s1"), ("", "en", "s9"), ("12 34 .,", "xx", None), ("one two", None, None), ("one two", None, "b"), ("one", None, "b"), ("one", None, "c"), ("a\x00b\x7fthe_the-THE'the", "en", "s1")]
    rows += [("w" * 300 + " the", "en", "s2")] * 3 + [("w" * 300 + " " + "w" * 299, "de", "s2")] * 3 + [("x" * 3_000_000 + " end", "de", "s3")]
    for i in range(120):
        rows.append((" ".join(words[int(x)] for x in rng.zipf(1.4, 40) % len(words)), ["en", "de"][i % 2], f"s{i % 7}" if i % 5 else None))
    return spark.createDataFrame([(i, *r, "clash", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(5).cache(), rows


@pytest.mark.parametrize("part", [None, 64])
def test_divergence_equals_plain_counts(spark, sourced, part):
    """With one automaton, and with many shards."""
    docs, rows = sourced
    got = divergence.audit(docs, part=part)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_audit(rows))
    assert got.filter("part = 'term' AND length(item) = 300").count() > 0
    few = divergence.audit(docs, top=2).filter("part = 'term'")
    assert sorted(map(tuple, few.collect())) == sorted(r for r in plain_audit(rows, top=2) if r[2] == "term")


def test_small_tables_and_pieces_count_alike(sourced, monkeypatch):
    """The tasks' functions, called here with small bounds: short pieces, tables that are given out early, chunks of few postings."""
    rows = [r for r in sourced[1] if len(r[0] or "") < 10**6]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] if i == 0 else r[i] or "" for r in rows], pa.string()) for i in range(3)], ["text", "lang", "source"])

    def total(batches, *by):
        out, n = collections.Counter(), 0
        for b in batches:
            n += 1
            for r in b.to_pylist():
                out[tuple(r[c] for c in by)] += r["n"]
        return out, n

    found = divergence.automaton([b"the", "straße".encode(), b"ab", b"zebra"])
    walk = lambda: collections.Counter(i for t in batch.column("text") for p in divergence.pieces(t) for i in divergence.occurrences(found, {}, p))
    whole, times = total(divergence._frequencies(iter([batch])), "lang", "term"), walk()
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 40)
    small = total(divergence._frequencies(iter([batch])), "lang", "term")
    assert small[0] == whole[0] and small[1] > whole[1] and walk() == times and times[0] > 10
    rng = np.random.default_rng(0)
    numbers, tally, sums = rng.integers(0, 300, (40, 60), np.int32), divergence.Tally(), collections.Counter()
    given = 0
    for i, x in enumerate(numbers):
        if tally.add((str(i % 3), ""), x):
            given += 1
            for g, (a, n) in tally.take().items():
                sums.update({(g[0], int(y)): int(k) for y, k in zip(a, n, strict=True)})
    for g, (a, n) in tally.take().items():
        sums.update({(g[0], int(y)): int(k) for y, k in zip(a, n, strict=True)})
    assert sums == collections.Counter((str(i % 3), int(y)) for i, x in enumerate(numbers) for y in x) and given > 1
    made = [(0, la, f"t{t:03}", f"s{s}", int(rng.integers(2, 10**8))) for la in ("de", "en") for t in range(60) for s in range(5) if rng.random() < 0.4]
    made = [(0, la, None, f"s{s}", 1 + s) for la in ("de", "en") for s in range(5)] + made
    made.sort(key=lambda r: (r[1], r[2] or "", r[3]))
    postings = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["block", "lang", "term", "source", "p"])

    def sums():
        out = collections.Counter()
        for b in divergence._pair_sums(iter([postings])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["item"]] += r["value"]
        return out

    want = sums()
    monkeypatch.setattr(divergence, "CHUNK", 7)
    assert sums() == want and len(want) == 40


def test_shards_and_one_automaton_agree(spark, corpus):
    docs = divergence._documents(corpus, "text", "lang", "source")
    kept = divergence.vocabulary(docs).cache()
    one, many = divergence.recount(docs, kept), divergence.recount(docs, kept, 1000)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty() and one.count() > 1000


def test_divergence_of_nothing(spark, corpus, empty):
    assert divergence.audit(empty).count() == 0
    two = spark.createDataFrame([("a", "en", "s"), ("b", "en", "t"), ("c", "de", "t")], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(two).collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_shares_are_exact_at_any_size(spark):
    from pyspark.sql import functions as F

    n, total, terms = 9_000_000_000_123, 18_000_000_000_457, 12345
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    assert df.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 1) // (total + terms)


# ------------------------------------------------------------------ 13
def plain_middle(key, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (key, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("leaf", [3, rope.LEAF])
def test_middles_equal_plain_cuts(spark, corpus, empty, monkeypatch, leaf):
    monkeypatch.setattr(rope, "LEAF", leaf)
    monkeypatch.setattr(rope.build, "__defaults__", (leaf,))
    odd = [(None, "a b"), (None, None), (1, "<P>"), (2, "x<S>y"), (3, "<P<S<M>>"), (3, "<P<S<M"), (4, "<<<>>>"), (5, "Zeile\r\n\r\n漢字 é́ \U0001f600!"), (6, "q" * 100_000), (7, "é" * 50_001), (8, "\x00\x7f")] + [(i, "ab<" + "P>x"[i % 3 :] + " S> M") for i in range(100, 140)]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame([*odd, odd[4]], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = rope.restore(rope.fill_in_middle(docs.selectExpr("*", "'clash' AS n", "'clash' AS output"))).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == sorted((plain_middle(*r) for r in rows), key=str)
    assert sorted((r.doc_id, r.restored) for r in out if r.doc_id is not None) == sorted((i, t or "") for i, t in rows if i is not None)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert rope.restore(rope.fill_in_middle(docs.limit(0))).count() == 0


def test_ropes_split_anywhere():
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abc é漢\U0001f600\n.,")) for _ in range(500))
    data = text.encode()
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    whole = rope.build(data, 7)
    assert (whole.units, whole.chars, whole.size) == (len(units), len(text), len(data))
    join = lambda r: b"".join(r.leaves()) if r else b""
    for k in range(len(units) + 1):
        a, b = rope.split(whole, k)
        assert join(a).decode() == "".join(units[:k]) and join(b).decode() == "".join(units[k:])
        assert (a.units if a else 0, a.chars if a else 0) == (k, len("".join(units[:k])))
    for k in range(len(text) + 1):
        a, b = rope.split(whole, k, "chars")
        assert join(a).decode() == text[:k] and join(b).decode() == text[k:]
    assert join(rope.concat(*rope.split(whole, 11, "size"))) == data


def test_output_without_sentinels_is_refused(spark):
    with pytest.raises(ValueError, match="lacks a sentinel"):
        rope.invert(b"<P>a<S>b", "psm")
    with pytest.raises(ValueError, match="share a beginning"):
        rope.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"), sentinels=("<P>", ">S", "M"))
