"""Registered queries of readers, stores, sessions, seeded operators and reports, with their DuckDB equivalents.

Seeded operators order rows by the MD5 of their seed and key, which DuckDB has, too; so they are compared row by row.
"""

from __future__ import annotations

import io
import json
import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from sparkprep import cli, repl, viewer
from sparkprep.content import BOOK, COURSE, ContentRegistry, documents
from sparkprep.errors import LicenseExpired
from sparkprep.functions import text as tx
from sparkprep.operators import columns as co
from sparkprep.operators import doctests, federated, rows, splits, tensors, values, watermark
from sparkprep.plans.catalogue import _SIDES, ORACLE_SQL, _dd_sql, _histogram_sql, _place, _sides, big, load, query, r6
from sparkprep.profile import drift, imbalance, quality, sketches
from sparkprep.registry import Registry
from sparkprep.sources import arrow_ipc, batches, chunks, container, crypto, files, hub, raw
from sparkprep.sources.storage import HadoopStorage, HttpClient, HttpStorage, MemoryStorage
from sparkprep.streaming import frames
from sparkprep.streaming.drift import windowed_drift


def seed_sql(seed: int | str, key: str) -> str:
    """What core.seeded() computes."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {key}::VARCHAR)), 1, 15))::BIGINT"


# ------------------------------------------------------------------ readers and writers
_NATION = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


def _nation(df):
    return df.select(F.col("n_nationkey").cast("bigint"), "n_name", F.col("n_regionkey").cast("bigint"))


@query("SELECT * FROM nation")
def parquet_bytes(spark, d):
    return files.from_parquet_bytes(spark, files.to_parquet_bytes(load(spark, d, "nation")))


@query("SELECT * FROM region")
def arrow_batches(spark, d):
    return files.from_batches(spark, load(spark, d, "region").toArrow().to_batches(2))


@query(_NATION)
def csv_string(spark, d):
    out = io.StringIO()
    load(spark, d, "nation").toPandas().to_csv(out, index=False)
    return _nation(files.from_csv_str(spark, out.getvalue()))


@query(_NATION)
def csv_inferred(spark, d):
    path = _place(spark, "t.csv")
    files.save(load(spark, d, "nation"), path)
    return _nation(files.load(spark, path))


@query(_NATION)
def csv_without_header(spark, d):
    path = _place(spark, "t")
    load(spark, d, "nation").write.option("sep", ";").csv(path)
    return _nation(files.read_csv(spark, path, files.CsvOptions(header=False, delimiter=";", schema="n_nationkey int, n_name string, n_regionkey int")))


@query(_NATION)
def json_string(spark, d):
    lines = [r[0] for r in load(spark, d, "nation").select(F.to_json(F.struct("*"))).collect()]
    return _nation(files.from_json_str(spark, "\n".join(lines)))


@query(_NATION)
def json_inferred(spark, d):
    path = _place(spark, "t.jsonl")
    files.save(load(spark, d, "nation"), path)
    return _nation(files.load(spark, path))


@query("SELECT p_partkey, p_name, p_size FROM part")
def ipc_stream_round_trip(spark, d):
    path = _place(spark, "t.arrows")
    arrow_ipc.write_ipc(load(spark, d, "part").select("p_partkey", "p_name", "p_size"), path, stream=True)
    return files.load(spark, path)


@query("SELECT p_partkey, p_size FROM part")
def parquet_projection(spark, d):
    return files.read_parquet(spark, f"{d}/part.parquet", ["p_partkey", "unknown", "p_size"])


def _loaded(spark, loader, key):
    rows_of = [(i, k) for i, batch in enumerate(loader) for k in batch.column(key).to_pylist()]
    return spark.createDataFrame(rows_of, f"batch bigint, {key} bigint")


@query("SELECT ((row_number() OVER (ORDER BY p_partkey) - 1) // 300)::BIGINT AS batch, p_partkey FROM part")
def loader_batches(spark, d):
    return _loaded(spark, splits.DataLoader(load(spark, d, "part").select("p_partkey"), 300, key="p_partkey"), "p_partkey")


@query(f"SELECT ((row_number() OVER (ORDER BY {seed_sql(5, 'p_partkey')}, p_partkey) - 1) // 300)::BIGINT AS batch, p_partkey FROM part")
def loader_shuffled(spark, d):
    return _loaded(spark, splits.DataLoader(load(spark, d, "part").select("p_partkey"), 300, shuffle=True, seed=5, key="p_partkey"), "p_partkey")


@query("SELECT b AS batch, p_partkey FROM (SELECT ((row_number() OVER (ORDER BY p_partkey) - 1) // 300)::BIGINT AS b, p_partkey, count(*) OVER () AS n FROM part) WHERE b < n // 300")
def loader_drop_last(spark, d):
    return _loaded(spark, splits.DataLoader(load(spark, d, "part").select("p_partkey"), 300, drop_last=True, key="p_partkey"), "p_partkey")


@query("SELECT ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000)::BIGINT AS batch, o_orderkey FROM orders")
def loader_parallel(spark, d):
    return _loaded(spark, splits.ParallelDataLoader(load(spark, d, "orders").select("o_orderkey"), 1000, key="o_orderkey", workers=4), "o_orderkey")


@query("SELECT b::BIGINT AS batch, least(4, (SELECT count(*) FROM nation) - 4 * b)::BIGINT AS n FROM range((SELECT (count(*) + 3) // 4 FROM nation)) t(b)")
def streamed_batches(spark, d):
    sizes = [(i, b.num_rows) for i, b in enumerate(files.iterate(load(spark, d, "nation"), 4))]
    return spark.createDataFrame(sizes, "batch bigint, n bigint")


@query("SELECT c_custkey, ['csv', 'tsv', 'json', 'jsonl', 'text', 'unknown'][c_custkey % 6 + 1] AS format FROM customer")
def raw_formats(spark, d):
    """A text for each customer, in one of six formats."""
    n = F.col("c_name")
    forms = (F.format_string("a,b\n1,%s\n", n), F.format_string("a\tb\n1\t%s", n), F.to_json(F.struct(n.alias("a"))), F.format_string('{"a": "%s"}\n{"a": 2}', n), n, F.lit(" \n"))
    texts = load(spark, d, "customer").select("c_custkey", F.element_at(F.array(*forms), (F.col("c_custkey") % 6 + 1).cast("int")).alias("text"))
    return raw.detected(texts, "text").drop("text")


@query(_NATION)
def raw_parsed(spark, d):
    out = io.StringIO()
    load(spark, d, "nation").toPandas().to_csv(out, index=False, sep="\t")
    return _nation(raw.parse(spark, out.getvalue()))


@query("SELECT * FROM region")
def raw_bytes(spark, d):
    return raw.parse_bytes(spark, files.to_parquet_bytes(load(spark, d, "region")))


@query("SELECT * FROM nation")
def own_source(spark, d):
    held = load(spark, d, "nation").toArrow().to_batches(10)
    batches.register(spark, "nations_at_hand", batches.MemoryBatches("n_nationkey int, n_name string, n_regionkey int", held))
    return batches.read_batches(spark, "nations_at_hand")


@query("SELECT b::BIGINT AS batch, least(4, (SELECT count(*) FROM nation) - 4 * b)::BIGINT AS n, round::BIGINT AS round FROM range((SELECT (count(*) + 3) // 4 FROM nation)) t(b), range(2) r(round) WHERE round = 1 OR b < 2")
def prefetched_batches(spark, d):
    """Two batches, then a reset and all of them, waiting or not."""
    ahead, out = batches.Prefetched(splits.DataLoader(load(spark, d, "nation"), 4, key="n_nationkey"), depth=3), []
    out += [(i, ahead.next().num_rows, 0) for i in range(2)]
    ahead.reset()
    while not ahead.done:
        got = ahead.try_next() if ahead.buffered else ahead.next()
        if got is not None:
            out.append((sum(r for *_, r in out), got.num_rows, 1))
    return spark.createDataFrame(out, "batch bigint, n bigint, round bigint")


# ------------------------------------------------------------------ stores
@query("SELECT store, n_name || '.txt' AS key, strlen(n_name)::BIGINT AS bytes, n_name AS body FROM nation, (SELECT unnest(['folder', 'memory']) AS store) WHERE n_nationkey % 2 = 0")
def stored_objects(spark, d):
    out = []
    for name, store in (("memory", MemoryStorage()), ("folder", HadoopStorage(spark, _place(spark, "objects")))):
        for r in load(spark, d, "nation").collect():
            store.put(f"{r.n_name}.txt", r.n_name.encode())
            if r.n_nationkey % 2:
                store.delete(f"{r.n_name}.txt")
        out += [(name, k, store.size(k), store.get(k).decode()) for k in store.list("") if store.exists(k)]
    return spark.createDataFrame(out, "store string, key string, bytes bigint, body string")


class _Served(HttpClient):
    """A web server over a few strings."""

    def __init__(self, pages: dict[str, bytes]):
        super().__init__()
        self.pages = pages

    def request(self, method, url, headers=None, body=None):
        data = self.pages.get(url.rsplit("/", 1)[-1])
        if data is None:
            return 404, {}, b""
        about = {"content-length": str(len(data)), "accept-ranges": "bytes"}
        if "Range" in (headers or {}):
            a, b = map(int, headers["Range"].removeprefix("bytes=").split("-"))
            return 206, about, data[a : b + 1]
        return 200, about, data if method == "GET" else b""


@query("SELECT n_name AS name, substr(n_name, 2, 3) AS part, strlen(n_name)::BIGINT AS bytes, true AS ranges FROM nation")
def http_ranges(spark, d):
    names = [r.n_name for r in load(spark, d, "nation").collect()]
    store = HttpStorage("http://example.org/x", _Served({n.replace(" ", "%20"): n.encode() for n in names}))
    found = [(n, store.get_range(k, 1, 3).decode(), store.size(k), store.supports_range(k)) for n in names for k in [n.replace(" ", "%20")]]
    return spark.createDataFrame(found, "name string, part string, bytes bigint, ranges boolean")


@query("SELECT s_name || CASE WHEN s_suppkey % 2 = 0 THEN '.parquet' ELSE '.md' END AS path, CASE WHEN s_suppkey % 2 = 1 THEN base64(s_name::BLOB) END AS content, CASE WHEN s_suppkey % 2 = 0 THEN sha256(s_name) END AS stored, CASE WHEN s_suppkey % 2 = 0 THEN length(s_name)::BIGINT END AS size, sha256(s_name) AS oid, s_suppkey % 2 = 0 AS large FROM supplier")
def hub_commits(spark, d):
    """A file for each supplier, small ones as base64, large ones by their hash."""
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, ".parquet").otherwise(".md"))
    made = hub.commits(load(spark, d, "supplier").select(name.alias("path"), F.col("s_name").cast("binary").alias("body")), "m", content="body")
    value = lambda k: F.get_json_object(F.element_at(F.split("commit", "\n"), 2), f"$.value.{k}")
    return made.select(value("path").alias("path"), value("content").alias("content"), value("oid").alias("stored"), value("size").cast("bigint").alias("size"), "oid", "large")


# ------------------------------------------------------------------ columns and rows
@query("SELECT p_partkey, p_size * 2 AS p_size FROM part")
def mapped_batches(spark, d):
    import pyarrow as pa
    import pyarrow.compute as pc

    double = lambda b: pa.RecordBatch.from_arrays([b.column(0), pc.multiply(b.column(1), pa.scalar(2, pa.int32()))], b.schema.names)
    return load(spark, d, "part").select("p_partkey", "p_size").transform(co.map_batches(double, "p_partkey bigint, p_size int"))


@query("SELECT * FROM (VALUES (0, 'r_regionkey', 'int', true), (1, 'r_name', 'string', true)) t(position, name, type, nullable)")
def schema_columns(spark, d):
    return co.schema_table(load(spark, d, "region"))


@query("SELECT count(*)::BIGINT AS rows, 5::BIGINT AS columns FROM customer")
def table_info(spark, d):
    found = co.info(load(spark, d, "customer"))
    return spark.createDataFrame([(found["rows"], found["columns"])], "rows bigint, columns bigint")


@query("SELECT 'text' AS documents, 'n_name' AS nation")
def text_column(spark, d):
    return spark.createDataFrame([tuple(tx.find_text_column(load(spark, d, t)) for t in ("documents", "nation"))], "documents string, nation string")


_MARKERS, _OPENERS = ("|".join(x.replace(":", "\\:") for x in words) for words in (doctests.MARKERS, doctests.OPENERS))


@query(
    rf"""SELECT doc_id, count(*) FILTER (CASE WHEN t = '' THEN false
      WHEN regexp_matches(w, '(Error|Exception|Warning)$') AND length(w) > 7 AND length(regexp_replace(w, '[^\p{{Lu}}]', '', 'g')) >= 2 THEN false
      WHEN regexp_matches(t, '^({_MARKERS})') THEN true WHEN regexp_matches(t, '^({_OPENERS})') THEN NOT contains(t, '>>>')
      WHEN w IN ('True', 'False', 'None', 'Traceback') THEN false
      WHEN regexp_matches(t, '^\p{{Lu}}\p{{Ll}}\S*(\s+\S+){{2}}') THEN NOT contains(t, '>>>') ELSE false END)::BIGINT AS prose
    FROM (SELECT doc_id, t, regexp_extract(t, '^[^:\s]*') AS w FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS t FROM documents)) GROUP BY doc_id"""
)
def prose_lines(spark, d):
    count = F.udf(lambda t: sum(map(doctests.is_prose, t.split("\n"))), "bigint", useArrow=True)
    return load(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", count("text").alias("prose"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 777")
def row_at(spark, d):
    found = rows.row(load(spark, d, "orders").select("o_orderkey", "o_custkey"), 777, "o_orderkey")
    return spark.createDataFrame([tuple(found)], "o_orderkey bigint, o_custkey bigint")


@query("SELECT * FROM region ORDER BY r_regionkey LIMIT 3")
def first_rows(spark, d):
    return rows.head(load(spark, d, "region").orderBy("r_regionkey"), 3)


@query(f"SELECT o_orderkey FROM orders ORDER BY {seed_sql(3, 'o_orderkey')}, o_orderkey LIMIT 500")
def sample_rows(spark, d):
    return load(spark, d, "orders").transform(rows.sample(500, seed=3, key="o_orderkey")).select("o_orderkey")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {seed_sql(3, 'o_orderkey')}, o_orderkey) AS n, count(*) OVER () AS c FROM orders) WHERE n <= floor(c * 0.1::DOUBLE + 0.5)")
def sample_fraction_rows(spark, d):
    return load(spark, d, "orders").transform(rows.sample(fraction=0.1, seed=3, key="o_orderkey")).select("o_orderkey")


@query(f"SELECT p_partkey, (row_number() OVER (ORDER BY {seed_sql(11, 'p_partkey')}, p_partkey) - 1)::BIGINT AS place FROM part")
def shuffle_order(spark, d):
    got = load(spark, d, "part").select("p_partkey").transform(rows.shuffle(11, "p_partkey")).toArrow().column(0).to_pylist()
    return spark.createDataFrame(list(zip(got, range(len(got)), strict=True)), "p_partkey bigint, place bigint")


@query("WITH n AS (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) - 1 AS spot, n_name ILIKE '%ia%' AS hit FROM nation) SELECT coalesce(min(spot) FILTER (hit AND spot >= 15), min(spot) FILTER (hit))::BIGINT AS place FROM n")
def search_from(spark, d):
    place = rows.search(load(spark, d, "nation"), "IA", "n_nationkey", start=15)
    return spark.createDataFrame([(place,)], "place bigint")


@query("SELECT s_name, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE, 6) AS {c}" for c in ("s_suppkey", "s_nationkey", "s_acctbal")) + " FROM supplier")
def normalize_all(spark, d):
    scaled = load(spark, d, "supplier").transform(values.normalize("minmax"))
    return scaled.select("s_name", *[r6(F.col(c), c) for c in ("s_suppkey", "s_nationkey", "s_acctbal")])


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS value FROM events")
def fill_zero(spark, d):
    holes = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return holes.transform(values.fill_zero("value"))


@query("SELECT p_partkey, p_retailprice AS price, p_size::BIGINT AS size FROM part")
def column_vectors(spark, d):
    parts = load(spark, d, "part").orderBy("p_partkey")
    keys, price, size = (tensors.column(parts, c, k) for c, k in (("p_partkey", "bigint"), ("p_retailprice", "double"), ("p_size", "bigint")))
    return spark.createDataFrame(list(zip(keys.tolist(), price.tolist(), size.tolist(), strict=True)), "p_partkey bigint, price double, size bigint")


@query("SELECT count(*)::BIGINT AS rows, 2::BIGINT AS columns, max(CASE WHEN n = 3 THEN p_size END)::DOUBLE AS fourth, -1.0::DOUBLE AS changed, true AS outside FROM (SELECT p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)")
def tensor_places(spark, d):
    t = tensors.tensor(load(spark, d, "part").orderBy("p_partkey"), ["p_partkey", "p_size"], "double")
    fourth = t.get(3, 1)
    t.set(0, 0, -1.0)
    return spark.createDataFrame([(*t.shape, fourth, float(t.values()[0]), t.get(-1, 0) is None and t.get(0, 2) is None)], "rows bigint, columns bigint, fourth double, changed double, outside boolean")


# ------------------------------------------------------------------ seeded splits and draws
@query(f"SELECT o_orderkey, CASE WHEN n <= greatest(1, floor(c * 0.8::DOUBLE + 0.5)) THEN 'train' ELSE 'test' END AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {seed_sql(9, 'o_orderkey')}, o_orderkey) AS n, count(*) OVER () AS c FROM orders)")
def split_seeded(spark, d):
    return splits.assign(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, 0.2, seed=9).select("o_orderkey", F.col("_split").alias("part"))


@query(f"SELECT vec_id, CASE WHEN n <= least(greatest(floor(c * 0.8::DOUBLE + 0.5), 1), c) THEN 'train' ELSE 'test' END AS part FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {seed_sql(7, 'vec_id')}, vec_id) AS n, count(*) OVER (PARTITION BY label) AS c FROM embeddings WHERE label IS NOT NULL)")
def split_stratified_rows(spark, d):
    parts = splits.assign_stratified(load(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 0.8, 0.2, seed=7)
    return parts.select("vec_id", F.col("_split").alias("part"))


@query(f"SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {seed_sql(42, 'doc_id')}, doc_id) AS n FROM labels WHERE toxic IS NOT NULL) WHERE n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM labels WHERE toxic IS NOT NULL GROUP BY toxic))")
def undersample_rows(spark, d):
    return splits.resample(load(spark, d, "labels"), "toxic", "undersample", "doc_id").select("doc_id", "toxic")


def _mix_sql(table: str, name: str, i: int, weight: float) -> str:
    return f"SELECT {name} AS name, (w // c + CASE WHEN n < w % c THEN 1 ELSE 0 END)::BIGINT AS copies FROM (SELECT {name}, row_number() OVER (ORDER BY {seed_sql(42 + i, name)}, {name}) - 1 AS n, count(*) OVER () AS c, trunc(((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)) * {weight}::DOUBLE / 4)::BIGINT AS w FROM {table})"


@query(f"SELECT * FROM ({_mix_sql('customer', 'c_name', 0, 1)} UNION ALL {_mix_sql('supplier', 's_name', 1, 3)}) WHERE copies > 0")
def mix_rows(spark, d):
    a, b = load(spark, d, "customer").select(F.col("c_name").alias("name")), load(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return splits.mix([(a, 1.0), (b, 3.0)], "name").groupBy("name").agg(F.count("*").alias("copies"))


@query(f"WITH p AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey)::DOUBLE AS upto, sum(p_size) OVER ()::DOUBLE / count(*) OVER () AS step FROM part), d AS (SELECT i, (i + ({seed_sql(5, 'i')} % 4503599627370496) / 4503599627370496::DOUBLE) * (SELECT max(step) FROM p) AS spot FROM range((SELECT count(*) FROM part)) r(i)) SELECT p_partkey, count(*)::BIGINT AS draws FROM p JOIN d ON spot >= upto - p_size AND spot < upto GROUP BY 1")
def weighted_rows(spark, d):
    drawn = splits.weighted_sample(load(spark, d, "part"), "p_size", "p_partkey", seed=5)
    return drawn.groupBy("p_partkey").agg(F.count("*").alias("draws"))


@query(f"SELECT o_orderkey, CASE WHEN n <= greatest(1, floor(c * 0.8::DOUBLE + 0.5)) THEN 'train' ELSE 'test' END AS part FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 4 ORDER BY {seed_sql(42, 'o_orderkey')}, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey % 4) AS c FROM orders)")
def federated_rows(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).cast("string").alias("node"))
    plan = federated.plan(orders.select(F.col("node").alias("node_id")).distinct(), federated.Strategy("local_with_seed"))
    return federated.execute(orders, plan, "node", "o_orderkey").select("o_orderkey", F.col("_split").alias("part"))


# ------------------------------------------------------------------ profiles
def _flawed(spark, d):
    return load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("holes"), F.lit("k").alias("fixed"))


_LOST = "(30 * (SELECT (count(*) FILTER (event_id % 3 = 0))::DOUBLE / count(*) FROM events) / 3 + 10 + 5 + 2 + 15)"


@query("""
WITH e AS (SELECT count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS holes, count(DISTINCT event_id) FILTER (event_id % 3 <> 0) AS filled FROM events),
c AS (SELECT 'holes' AS "column", n, holes AS nulls, filled AS kinds FROM e UNION ALL SELECT 'fixed', n, 0, 1 FROM e),
r AS (SELECT *, nulls / n AS null_ratio, 1 - kinds / (n - nulls) AS repeated FROM c)
SELECT 'high_null_ratio' AS kind, "column", CASE WHEN null_ratio > 0.5 THEN 4 ELSE 3 END AS severity, round(null_ratio, 6) AS value, NULL::BIGINT AS count FROM r WHERE null_ratio > 0.1
UNION ALL SELECT 'high_duplicate_ratio', "column", 2, round(repeated, 6), NULL FROM r WHERE repeated > 0.5
UNION ALL SELECT 'low_cardinality', "column", 1, NULL, kinds FROM r WHERE kinds < 2 AND n > 1
UNION ALL SELECT 'constant_column', "column", 4, NULL, NULL FROM r WHERE kinds <= 1""")
def quality_issues(spark, d):
    found = quality.check(_flawed(spark, d)).issues
    return spark.createDataFrame([(i.kind, i.column, i.severity, round(i.value, 6) if isinstance(i.value, float) else None, i.count) for i in found], "kind string, column string, severity int, value double, count bigint")


@query(f"SELECT count(*)::BIGINT AS rows, 3::BIGINT AS columns, round(100 - {_LOST}, 6) AS score, 4::BIGINT AS max_severity, 'fixed,holes' AS problems, 0::BIGINT AS repeated FROM events")
def quality_report(spark, d):
    r = quality.check(_flawed(spark, d))
    return spark.createDataFrame([(r.row_count, r.column_count, round(r.score, 6), r.max_severity(), ",".join(r.problematic_columns()), r.duplicate_row_count)], "rows bigint, columns bigint, score double, max_severity bigint, problems string, repeated bigint")


@query("SELECT unnest(['default', 'doctest-corpus', 'ml-training', 'time-series']) AS profile, round(100 * 10.5 / 15.5, 6)::DOUBLE AS score, 'D' AS grade, false AS publishable, 5::BIGINT AS failed")
def quality_scorecards(spark, d):
    out = []
    for name, p in quality.PROFILES.items():
        card = quality.scorecard(quality.checklist(quality.check(_flawed(spark, d), p.thresholds), p))
        out.append((name, round(json.loads(card.to_json())["score"], 6), card.grade, card.publishable, len(card.failed())))
    return spark.createDataFrame(out, "profile string, score double, grade string, publishable boolean, failed bigint")


@query("SELECT i::BIGINT AS id, ['critical', 'critical', 'critical', 'high', 'high', 'high', 'medium', 'medium', 'medium', 'medium', 'low', 'low'][i] AS severity, i NOT IN (3, 7, 8, 11, 12) AS passed FROM range(1, 13) t(i)")
def checklist_items(spark, d):
    items = quality.checklist(quality.check(_flawed(spark, d)))
    return spark.createDataFrame([(c.id, c.severity, c.passed) for c in items], "id bigint, severity string, passed boolean")


@query("SELECT i::BIGINT AS id, i NOT IN (3, 5) AS passed FROM range(1, 6) t(i)")
def basic_checks(spark, d):
    return spark.createDataFrame([(c.id, c.passed) for c in quality.basic_checklist(quality.check(_flawed(spark, d)))], "id bigint, passed boolean")


@query("SELECT 'embedding' AS \"column\", count(*)::BIGINT AS total_count, count(DISTINCT embedding)::BIGINT AS unique_count FROM embeddings UNION ALL SELECT 'pair', count(*), count(DISTINCT label) FROM embeddings")
def nested_profile(spark, d):
    nested = load(spark, d, "embeddings").select("embedding", F.struct(F.col("label").alias("a"), F.lit(1).alias("b")).alias("pair"))
    return quality.column_profile(nested).select("column", big(F.col("total_count"), "total_count"), big(F.col("unique_count"), "unique_count"))


_TOXIC = "(SELECT toxic::VARCHAR AS c, count(*) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1)"


@query(f"SELECT c AS class, n::BIGINT AS n, round(n / sum(n) OVER (), 6) AS share FROM {_TOXIC}")
def class_shares(spark, d):
    found = imbalance.analyze(load(spark, d, "labels"), "toxic")
    counts = imbalance.class_counts(load(spark, d, "labels"), "toxic").collect()
    return spark.createDataFrame([(str(r[0]), r[1], round(found.proportion(str(r[0])), 6)) for r in counts], "class string, n bigint, share double")


# ------------------------------------------------------------------ drift and sketches
def _halves(spark, d):
    orders = load(spark, d, "orders")
    return [orders.filter(F.col("o_orderkey") % 2 == i).select("o_totalprice") for i in (0, 1)]


_HALVES = "s AS (SELECT 'o_totalprice' AS \"column\", o_totalprice AS v, o_orderkey % 2 = 0 AS r FROM orders)"
_GRADES = "CASE WHEN p > 0.05 THEN 'None' WHEN p <= 0.0001 THEN 'Critical' WHEN p <= 0.001 THEN 'High' WHEN p <= 0.01 THEN 'Medium' ELSE 'Low' END"


@query(f"WITH {_HALVES}, n AS (SELECT v, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS b FROM s GROUP BY 1), c AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb, sum(a) OVER () AS nr, sum(b) OVER () AS nc FROM n WINDOW w AS (ORDER BY v)), z AS (SELECT max(abs(fa - fb)) * sqrt(max(nr) / (max(nr) + max(nc)) * max(nc)) AS z FROM c), p AS (SELECT CASE WHEN z <= 0 THEN 1 WHEN z > 3 THEN 0 ELSE least(greatest(2 * (SELECT sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * z * z)) FROM range(1, 101) t(k)), 0), 1) END::DOUBLE AS p FROM z) SELECT 'o_totalprice' AS \"column\", round(p, 6) AS p_value, {_GRADES} AS severity, {_GRADES} <> 'None' AS drifted FROM p")
def drift_ks_p_value(spark, d):
    return drift.detect(*_halves(spark, d), tests=["ks"]).select("column", r6(F.col("p_value"), "p_value"), "severity", "drifted")


def _erf_sql(x: str) -> str:
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({x})))"
    poly = f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))"
    return f"(sign({x}) * (1 - {poly} * exp(-({x}) * ({x}))))"


@query(f"WITH {_histogram_sql('least(greatest(ceil(sqrt(nr)), 5), 20)').replace(_SIDES, _HALVES)}, x AS (SELECT sum(CASE WHEN a + b > 0 THEN (a - (a + b) * nr / (nr + nc)) ** 2 / ((a + b) * nr / (nr + nc)) + (b - (a + b) * nc / (nr + nc)) ** 2 / ((a + b) * nc / (nr + nc)) ELSE 0 END) AS x, greatest(count(*) FILTER (a + b > 0) - 1, 1)::DOUBLE AS k FROM h), z AS (SELECT (cbrt(x / k) - (1 - 2 / (9 * k))) / sqrt(2 / (9 * k)) / sqrt(2::DOUBLE) AS z FROM x), p AS (SELECT 1 - 0.5 * (1 + {_erf_sql('z')}) AS p FROM z) SELECT 'o_totalprice' AS \"column\", round(p, 6) AS p_value, {_GRADES} AS severity FROM p")
def drift_chi2_p_value(spark, d):
    return drift.detect(*_halves(spark, d), tests=["chi2"]).select("column", r6(F.col("p_value"), "p_value"), "severity")


@query(f"SELECT {_GRADES.replace('p ', 'x ')} AS by_p, CASE WHEN 10 * x < 0.1 THEN 'None' WHEN 10 * x < 0.2 THEN 'Low' WHEN 10 * x < 0.25 THEN 'Medium' WHEN 10 * x < 0.5 THEN 'High' ELSE 'Critical' END AS by_psi, count(*)::BIGINT AS n FROM (SELECT ((event_id % 997) / 10000.0)::DOUBLE AS x FROM events) GROUP BY 1, 2")
def drift_severities(spark, d):
    x = load(spark, d, "events").select(((F.col("event_id") % 997) / 10000.0).alias("x"))
    return x.groupBy(drift.severity_p(F.col("x"), 0.05).alias("by_p"), drift.severity_rising(10 * F.col("x"), drift.PSI_LIMITS).alias("by_psi")).agg(F.count("*").alias("n"))


@query("SELECT c AS \"column\", t AS test FROM (SELECT unnest(['l_extendedprice', 'l_quantity']) AS c), (SELECT unnest(['ks', 'chi2', 'psi', 'js']) AS t)")
def drift_report(spark, d):
    found = drift.report(*_sides(spark, d), tests=["ks", "chi2", "psi", "js"])
    return spark.createDataFrame([(r["column"], r["test"]) for r in found.rows], "column string, test string")


def _quantiles(spark, parts):
    return sketches.quantiles(parts, sketches.steps()).select("column", F.round("q", 2).alias("q"), r6(F.col("value"), "value"))


@query(ORACLE_SQL["ddsketch_quantiles"])
def sketch_bytes(spark, d):
    return _quantiles(spark, sketches.from_bytes(spark, sketches.to_bytes(sketches.sketch(load(spark, d, "events"), "ddsketch", ["value"]))))


@query(f"SELECT 'value' AS \"column\", round(q, 2) AS q, round(value, 6) AS value FROM {_dd_sql('true')}")
def sketch_merged(spark, d):
    events = load(spark, d, "events")
    return _quantiles(spark, sketches.merge(*(sketches.sketch(events.filter(F.col("event_id") % 3 == i), "ddsketch", ["value"]) for i in range(3))))


@query("SELECT round(i / 20, 2) AS q, true AS close FROM range(1, 20) t(i)")
def tdigest_ranks(spark, d):
    """The rank of each estimated quantile is within a hundredth of the asked one; merged digests, through bytes."""
    events = load(spark, d, "events")
    digest = sketches.merge(*(sketches.from_bytes(spark, sketches.to_bytes(sketches.sketch(events.filter(F.col("event_id") % 2 == i), "tdigest", ["value"]))) for i in range(2)))
    got = sketches.quantiles(digest, sketches.steps()).collect()
    ranks = events.agg(F.count("value").alias("n"), *(F.count_if(F.col("value") <= r.value).alias(f"r{i}") for i, r in enumerate(got))).first()
    return spark.createDataFrame([(round(r.q, 2), abs(ranks[f"r{i}"] / ranks.n - r.q) <= 0.01) for i, r in enumerate(got)], "q double, close boolean")


# ------------------------------------------------------------------ containers
@query("SELECT * FROM region")
def container_encrypted(spark, d):
    data = container.dumps(load(spark, d, "region").toArrow(), spark=spark, password="a word")
    return spark.createDataFrame(container.loads(data, spark, password="a word").table)


@query("SELECT * FROM region")
def container_for_recipient(spark, d):
    keys = crypto.recipient_keys(spark)
    data = container.dumps(load(spark, d, "region").toArrow(), spark=spark, recipient=keys.public)
    return spark.createDataFrame(container.loads(data, spark, private=keys.private).table)


@query("SELECT * FROM region")
def container_signed(spark, d):
    keys = crypto.signing_keys(spark)
    data = container.dumps(load(spark, d, "region").toArrow(), spark=spark, signer=keys)
    return spark.createDataFrame(container.loads(data, spark, trusted=keys.public).table)


@query("SELECT how AS compression, count(*)::BIGINT AS rows, sum(s_suppkey)::BIGINT AS keys, false AS damaged_intact FROM supplier, (SELECT unnest(['LZ4', 'NONE', 'ZSTD_19', 'ZSTD_3']) AS how) GROUP BY how")
def container_checksums(spark, d):
    """Containers made and read by executors, whole and with one bit changed."""
    suppliers, out = load(spark, d, "supplier"), None
    for how in container.Compression:
        made = container.packed(suppliers, 64, compression=how)
        damaged = made.withColumn("container", F.expr("concat(substring(container, 1, 60), unhex(IF(hex(substring(container, 61, 1)) = '00', '01', '00')), substring(container, 62))"))
        kept = container.intact(damaged).agg(F.bool_or("intact").alias("damaged_intact"))
        read = container.unpacked(made, suppliers.schema).agg(F.count("*").alias("rows"), F.sum("s_suppkey").cast("bigint").alias("keys"))
        one = read.withColumn("k", F.lit(1)).join(kept.withColumn("k", F.lit(1)), "k").select(F.lit(how.name).alias("compression"), "rows", "keys", "damaged_intact")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT c_name AS licensee, (c_custkey % 7 + 1)::BIGINT AS seats, (c_custkey % 5 + 1)::BIGINT AS days FROM customer")
def license_terms(spark, d):
    """A license for each customer; days: the last day on which it is valid."""

    def run(batches):
        for batch in batches:
            names, keys, days = batch.column("c_name").to_pylist(), batch.column("c_custkey").to_pylist(), []
            held = [container.License.from_bytes(container.License.issue(n, days=k % 5 + 1, now=1000, seat_limit=k % 7 + 1, terms=n.encode()).to_bytes()) for n, k in zip(names, keys, strict=True)]
            for x in held:
                day = 0
                try:
                    while day < 9:
                        x.verify(now=1000 + 86400 * (day + 1))
                        day += 1
                except LicenseExpired:
                    pass
                days.append(day)
            yield pa.RecordBatch.from_arrays([pa.array([x.terms.decode() for x in held]), pa.array([x.seat_limit for x in held], pa.int64()), pa.array(days, pa.int64())], ["licensee", "seats", "days"])

    return load(spark, d, "customer").select("c_name", "c_custkey").mapInArrow(run, "licensee string, seats bigint, days bigint")


@query("SELECT * FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS row, o_orderkey FROM orders) WHERE row IN (0, 497, 994)")
def chunk_lookup(spark, d):
    path = _place(spark, "t.spd")
    chunks.write_chunks(load(spark, d, "orders").orderBy("o_orderkey"), path, 400)
    held, out = chunks.Chunked(spark, path), None
    for row in (0, 497, 994):
        i = held.find(row)
        one = held.get_rows(row, 1, ["o_orderkey"]).select(F.lit(row).cast("bigint").alias("row"), "o_orderkey").filter(F.lit(held.chunks[i].row_offset) <= row)
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT row, o_orderkey, o_totalprice FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS row, * FROM orders) WHERE row >= 1000 AND row < 9000 AND o_totalprice > 1000")
def chunk_scan(spark, d):
    """A container as a format: the filter on the row number chooses chunks, the one on another column is Spark's."""
    path = _place(spark, "t.spd")
    chunks.write_chunks(load(spark, d, "orders").orderBy("o_orderkey"), path, 512)
    found = chunks.scan(spark, path, [chunks.ROW, "o_orderkey", "o_totalprice"]).filter(f"{chunks.ROW} >= 1000 AND {chunks.ROW} < 9000 AND o_totalprice > 1000")
    return found.select(F.col(chunks.ROW).alias("row"), "o_orderkey", "o_totalprice")


@query("SELECT * FROM customer")
def chunks_encrypted(spark, d):
    """Two runs of encrypted chunks, each under its own key."""
    path, half = _place(spark, "t.spd"), F.col("c_custkey") % 2 == 0
    chunks.write_chunks(load(spark, d, "customer").filter(half), path, 300, password="a word")
    chunks.write_chunks(load(spark, d, "customer").filter(~half), path, 300, mode="append", password="a word")
    held = chunks.Chunked(spark, path, password="a word")
    held.verify()
    return held.rows()


@query("SELECT event_type, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def chunk_stream(spark, d):
    """A stream of chunks that stops, and goes on from its checkpoint with the chunks that were appended meanwhile."""
    base = _place(spark, "stream")
    path, name, half = f"{base}/t.spd", f"chunks_{uuid.uuid4().hex}", F.col("event_id") % 2 == 0
    events = load(spark, d, "events").select("event_id", "event_type")
    for part, mode in ((half, "error"), (~half, "append")):
        chunks.write_chunks(events.filter(part), path, 1000, mode=mode)
        batches.register(spark, name, chunks.ChunkBatches(spark, path))
        batches.stream_batches(spark, name).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT ts::DATE AS day, count(*)::BIGINT AS n, min(value) AS low, max(value) AS high FROM events WHERE isfinite(value) AND ts IS NOT NULL GROUP BY 1")
def stream_windows(spark, d):
    """Digests of days, given out when a later event closes them; the stream stops in between and goes on from its checkpoint."""
    base, events = _place(spark, "windows"), load(spark, d, "events").select("ts", "value")
    later = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(0.0).alias("value"))
    for part in (events, later):
        part.write.mode("append").parquet(f"{base}/in")
        windows = windowed_drift(frames.read_stream(spark, f"{base}/in", events.schema), "ts", ["value"], 86_400_000)
        windows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.to_date("start").alias("day"), "n", "low", "high")


# ------------------------------------------------------------------ registry, content, viewer
@query("SELECT 'nation' AS name, '2.0' AS latest, '1.0,2.0' AS versions, (SELECT count(*) FROM nation)::BIGINT AS num_rows, 'place,small' AS tags UNION ALL SELECT 'region', '1.0', '1.0', (SELECT count(*) FROM region), 'place'")
def registry_records(spark, d):
    r = Registry(spark, _place(spark, "registry"))
    r.init()
    r.publish("nation", "1.0", load(spark, d, "nation").limit(1), tags=["place", "small"])
    r.publish("nation", "2.0", load(spark, d, "nation"))
    r.publish("region", "1.0", load(spark, d, "region"), tags=["place"], description="the parts of the world")
    r.publish("supplier", "1.0", load(spark, d, "supplier"), tags=["people"])
    r.delete("supplier", "1.0")
    both = r.search("nat").unionByName(r.search("WORLD")).unionByName(r.search_tags(["small"])).distinct()
    return both.select("name", "latest", F.array_join("versions", ",").alias("versions"), "num_rows", F.array_join("tags", ",").alias("tags"))


@query("SELECT n_name AS id, 'About ' || n_name AS title, 'd' AS description, n_regionkey::VARCHAR AS weeks, 'a, b' AS categories FROM nation")
def course_rows(spark, d):
    course = F.struct(F.col("n_name").alias("id"), F.concat(F.lit("About "), F.col("n_name")).alias("title"), F.lit("d").alias("description"), F.col("n_regionkey").alias("weeks"), F.array(F.lit("a"), F.lit("b")).alias("categories"))
    return COURSE.to_rows(load(spark, d, "nation").select(F.to_json(course).alias("json")))


@query("WITH c AS (SELECT n_regionkey AS book, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, n_nationkey AS k FROM nation) SELECT book, 'author' AS path, 'author is required' AS message FROM c WHERE i = 0 AND book % 2 = 0 UNION ALL SELECT book, 'chapters[' || i || '].title', 'title is required' FROM c WHERE k % 3 = 0 UNION ALL SELECT book, 'chapters[' || i || '].id', 'id is required' FROM c WHERE k % 4 = 1")
def content_issues(spark, d):
    """A book for each region, of its nations, some without a title, an id or an author."""
    key = F.col("n_nationkey")
    chapter = F.struct(key.alias("at"), F.when(key % 4 != 1, key.cast("string")).alias("id"), F.when(key % 3 != 0, F.col("n_name")).alias("title"))
    books = load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("book")).agg(F.sort_array(F.collect_list(chapter)).alias("chapters"))
    text = F.to_json(F.struct(F.col("book").cast("string").alias("id"), F.lit("t").alias("title"), F.when(F.col("book") % 2 == 1, "a").alias("author"), "chapters"))
    return BOOK.issues(books.select("book", text.alias("json")), "book")


@query("SELECT i::BIGINT AS chunk, least(2, 5 - 2 * i)::BIGINT AS n FROM range(3) t(i)")
def content_chunks(spark, d):
    book = json.dumps({"id": "b", "title": "t", "author": "a", "chapters": [{"id": str(r.r_regionkey), "title": r.r_name, "order": r.r_regionkey} for r in load(spark, d, "region").collect()]})
    return spark.createDataFrame([(i, b.num_rows) for i, b in enumerate(BOOK.chunks(documents(spark, [book]), 2))], "chunk bigint, n bigint")


@query("SELECT s_suppkey, printf('%.2f', s_acctbal) AS balance, CASE WHEN length(s_name) <= 10 THEN s_name ELSE substr(s_name, 1, 7) || '...' END AS name FROM supplier ORDER BY s_suppkey LIMIT 10 OFFSET 5")
def viewer_page(spark, d):
    v = viewer.Viewer(load(spark, d, "supplier"), "s_suppkey", 10)
    v.move(5)
    return spark.createDataFrame([(r.s_suppkey, viewer.cell(r.s_acctbal), viewer.truncate(viewer.cell(r.s_name), 10)) for r in v.rows(v.at, v.page)], "s_suppkey bigint, balance string, name string")


@query("SELECT name, n::BIGINT AS n, 'table' AS chart FROM (VALUES ('dataset', (SELECT count(*) FROM region)), ('raw', (SELECT count(*) FROM nation))) t(name, n)")
def content_tables(spark, d):
    kinds, out = ContentRegistry(), io.StringIO()
    load(spark, d, "nation").toPandas().to_csv(out, index=False)
    data = {"dataset": files.to_parquet_bytes(load(spark, d, "region")), "raw": out.getvalue().encode()}
    return spark.createDataFrame([(k, sum(b.num_rows for b in kinds.get(k).chunks(spark, v, 7)), kinds.get(k).hints.chart_type) for k, v in data.items()], "name string, n bigint, chart string")


@query("SELECT * FROM (VALUES ('page', 10::BIGINT, NULL::BIGINT), ('end', (SELECT count(*) FROM nation) - 10, NULL), ('select', (SELECT count(*) FROM nation) - 10, (SELECT count(*) FROM nation) - 3), ('step', 2, 3)) t(key, \"offset\", selected)")
def viewer_scroll(spark, d):
    s, out = viewer.Scroll(load(spark, d, "nation").count(), 10), []
    for key, act in (("page", lambda: s.page(1)), ("end", s.end), ("select", lambda: s.select(s.total - 3)), ("step", lambda: (s.select(2), s.step(1)))):
        act()
        out.append((key, s.offset, s.selected))
    return spark.createDataFrame(out, "key string, offset bigint, selected bigint")


@query("SELECT unnest(['column      | type   | null', 'r_regionkey | int    | yes', 'r_name      | string | yes']) AS line")
def schema_lines(spark, d):
    return spark.createDataFrame([(x,) for x in viewer.SchemaInspector(load(spark, d, "region")).lines()], "line string")


# ------------------------------------------------------------------ command line and session
def _cli(spark, *words: str) -> str:
    out = io.StringIO()
    cli.run(list(words), spark, out)
    return out.getvalue()


@query("SELECT * FROM region")
def cli_convert(spark, d):
    path = _place(spark, "t.arrow")
    _cli(spark, "convert", f"{d}/region.parquet", path)
    return files.load(spark, path)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def cli_dedup(spark, d):
    path = _place(spark, "t.parquet")
    _cli(spark, "dedup", f"{d}/documents.parquet", path, "--key", "doc_id")
    return files.load(spark, path).select("doc_id")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def cli_head(spark, d):
    lines = _cli(spark, "head", f"{d}/nation.parquet", "--rows", "100").splitlines()
    return spark.createDataFrame([(x["n_nationkey"], x["n_name"]) for x in map(json.loads, lines)], "n_nationkey bigint, n_name string")


@query("SELECT count(*)::BIGINT AS rows, 0::BIGINT AS repeated FROM customer")
def cli_quality(spark, d):
    found = json.loads(_cli(spark, "quality", "check", f"{d}/customer.parquet", "--json"))
    return spark.createDataFrame([(found["rows"], found["duplicates"])], "rows bigint, repeated bigint")


@query("SELECT 'o_totalprice' AS \"column\", 2 * count(*)::BIGINT AS n, 0.0::DOUBLE AS statistic, 'None' AS severity FROM orders WHERE o_totalprice IS NOT NULL")
def cli_sketches(spark, d):
    path = {x: _place(spark, f"{x}.parquet") for x in ("in", "one", "two")}
    files.save(load(spark, d, "orders").select("o_totalprice"), path["in"])
    _cli(spark, "drift", "sketch", path["in"], path["one"])
    _cli(spark, "drift", "merge", path["one"], path["one"], "--output", path["two"])
    found = json.loads(_cli(spark, "drift", "compare", path["one"], path["two"]))
    return files.load(spark, path["two"]).groupBy("column").agg(F.sum("n").alias("n")).select("column", "n", F.lit(found["statistic"]).alias("statistic"), F.lit(found["severity"]).alias("severity"))


@query("SELECT (o_custkey % 3)::VARCHAR AS node, o_orderkey FROM orders WHERE o_custkey % 3 = 1")
def cli_federated(spark, d):
    path = {x: _place(spark, f"{x}.parquet") for x in ("in", "manifest", "plan", "out")}
    files.save(load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 3).cast("string").alias("node"), F.lit("train").alias("_split")), path["in"])
    _cli(spark, "fed", "manifest", path["in"], path["manifest"], "--node", "node")
    _cli(spark, "fed", "plan", path["manifest"], path["plan"])
    files.save(files.load(spark, path["in"]).drop("_split"), path["in"].replace("in.parquet", "bare.parquet"))
    _cli(spark, "fed", "split", path["in"].replace("in.parquet", "bare.parquet"), path["plan"], path["out"], "--node", "node", "--key", "o_orderkey")
    return files.load(spark, path["out"]).filter("node = '1' AND _split IN ('train', 'test')").select("node", "o_orderkey")


@query("SELECT * FROM region")
def cli_registry(spark, d):
    root, path = _place(spark, "registry"), _place(spark, "t.parquet")
    _cli(spark, "registry", "init", root)
    _cli(spark, "registry", "push", root, "region", "1", f"{d}/region.parquet", "--tags", "a,b")
    _cli(spark, "registry", "pull", root, "region", path)
    return files.load(spark, path)


@query("SELECT 'nation' AS active, count(*)::BIGINT AS rows, 'nation> ' AS prompt, 'head,help,history' AS verbs, '* nation' AS listed FROM nation")
def session_commands(spark, d):
    s = repl.Session(spark)
    s.execute(f"load {d}/nation.parquet")
    found = json.loads(s.execute("INFO"))
    return spark.createDataFrame([(s.active, found["rows"], s.prompt(), ",".join(s.complete("h")), s.execute("datasets"))], "active string, rows bigint, prompt string, verbs string, listed string")


@query("SELECT s_suppkey, 'head' AS verb, s_suppkey::VARCHAR AS args FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'convert', s_name || '.csv' FROM supplier WHERE s_suppkey % 2 = 1")
def session_parsing(spark, d):
    """A command for each supplier, parsed by the executors."""
    lines = load(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.format_string("HEAD %d", "s_suppkey")).otherwise(F.format_string("Convert '%s.csv'", "s_name")).alias("line"))

    def parsed(batches):
        for batch in batches:
            found = [repl.parse(x) for x in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("s_suppkey"), pa.array([c.verb for c in found]), pa.array([" ".join(c.args) for c in found])], ["s_suppkey", "verb", "args"])

    return lines.mapInArrow(parsed, f"s_suppkey {dict(lines.dtypes)['s_suppkey']}, verb string, args string")


# ------------------------------------------------------------------ doctests, texts, watermarks
_EXAMPLES = "SELECT 'demo' AS source, '1.0' AS version, 'pkg.m' || n_nationkey AS module, 'f' || n_nationkey AS function, '>>> f' || n_nationkey || '(2)' AS input, (2 * n_nationkey)::VARCHAR AS expected, 'def f' || n_nationkey || '(x)' AS signature FROM nation"


def _code(i: int) -> str:
    return f'def f{i}(x):\n    """Multiply.\n\n    >>> f{i}(2)\n    {2 * i}\n\n    The rest is prose.\n    """\n    return {i} * x\n'


@query(_EXAMPLES)
def doctest_rows(spark, d):
    n = F.col("n_nationkey").cast("string")
    content = F.concat(F.lit("def f"), n, F.lit('(x):\n    """Multiply.\n\n    >>> f'), n, F.lit("(2)\n    "), (2 * F.col("n_nationkey")).cast("string"), F.lit('\n\n    The rest is prose.\n    """\n    return 0\n'))
    return doctests.extract(load(spark, d, "nation").select(content.alias("content"), F.concat(F.lit("pkg.m"), n).alias("module")), "demo", "1.0")


@query(_EXAMPLES)
def doctest_folder(spark, d):
    root = _place(spark, "code")
    store = HadoopStorage(spark, root)
    for r in load(spark, d, "nation").collect():
        store.put(f"pkg/m{r.n_nationkey}.py", _code(r.n_nationkey).encode())
    store.put("pkg/__init__.py", b'"""No examples."""\n')
    found = doctests.from_directory(spark, root, "demo", "1.0")
    return doctests.merge(found.filter("function < 'f2'"), found.filter("function >= 'f2'"))


@query(f"SELECT doc_id, text IS NOT NULL AND {seed_sql(42, 'doc_id')} % 4503599627370496 < 2251799813685248 AND strlen(text) >= 10 AS cut, sha256(text) AS sha256 FROM documents")
def fim_reassembled(spark, d):
    """Prefix, middle and suffix, put together again, are the text."""
    from sparkprep.operators import fim

    whole = r"(?s)^<\|fim_prefix\|>(.*)<\|fim_suffix\|>(.*)<\|fim_middle\|>(.*)$"
    cut = load(spark, d, "documents").select("doc_id", "text").transform(fim.fim("text", "doc_id", rate=0.5, seed=42))
    again = F.concat(*[F.regexp_extract("text", whole, i) for i in (1, 3, 2)])
    was = F.coalesce(F.startswith(F.col("text"), F.lit("<|fim_prefix|>")), F.lit(False))
    return cut.select("doc_id", was.alias("cut"), F.sha2(F.when(was, again).otherwise(F.col("text")), 256).alias("sha256"))


@query("SELECT true AS verified, false AS by_another, true AS same_buyer, true AS close FROM (SELECT 1)")
def watermark_extracted(spark, d):
    parts, buyer, seller = load(spark, d, "part").select("p_partkey", "p_retailprice"), bytes(range(32)), bytes(32)
    marked = watermark.embed(parts, buyer, seller, ["p_retailprice"], "p_partkey")
    far = marked.join(parts.withColumnRenamed("p_retailprice", "was"), "p_partkey").agg(F.max(F.abs(F.col("p_retailprice") - F.col("was")))).first()[0]
    found = watermark.extract(marked, seller, "p_partkey", ["p_retailprice"])
    same = found is not None and found[0] == buyer
    out = (watermark.verify(marked, buyer, seller, "p_partkey", ["p_retailprice"]), watermark.verify(marked, bytes(32), bytes([1]) * 32, "p_partkey", ["p_retailprice"]), same, far < 1e-6)
    return spark.createDataFrame([out], "verified boolean, by_another boolean, same_buyer boolean, close boolean")
