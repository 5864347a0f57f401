import io
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkprep.errors import ChecksumMismatch, DecryptionFailed, EmptyDataset, FormatError, InvalidConfig, LicenseExpired, NotFound, ParseError, SchemaMismatch, SignatureInvalid, StorageError, UnsupportedFormat
from sparkprep.content import BOOK, COURSE, Constraint, ContentRegistry, Field, Schema, documents
from sparkprep.registry import Registry
from sparkprep.repl import Session, parse as parse_command
from sparkprep import content
from sparkprep.sources import builtin, container, crypto, files, hub, raw, storage
from sparkprep.streaming import frames
from sparkprep.viewer import Viewer, cell, truncate, width
from sparkprep import cli


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, f"item_{i}", 1.5 * i) for i in range(30)], "id long, name string, score double")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "arrow", "arrows"])
def test_round_trips(spark, items, tmp_path, kind):
    path = str(tmp_path / f"t.{kind}")
    files.save(items, path)
    back = files.load(spark, path).select("id", "name", "score")
    assert rows(back.select(F.col("id").cast("long"), "name", "score")) == rows(items)


def test_bytes_strings_and_batches(spark, items):
    assert rows(files.from_parquet_bytes(spark, files.to_parquet_bytes(items))) == rows(items)
    assert files.from_csv_str(spark, "a,b\n1,x\n2,y").dtypes == [("a", "int"), ("b", "string")]
    assert files.from_json_str(spark, '{"a": 1}\n\n{"a": 2}').count() == 2
    b = pa.RecordBatch.from_pydict({"x": [1, 2]})
    assert files.from_batches(spark, [b, b]).count() == 4
    with pytest.raises(EmptyDataset):
        files.from_batches(spark, [])
    with pytest.raises(SchemaMismatch):
        files.from_batches(spark, [b, pa.RecordBatch.from_pydict({"y": [1]})])
    with pytest.raises(UnsupportedFormat):
        files.kind_of("x.txt")
    assert sum(x.num_rows for x in files.iterate(items, 7)) == 30


def test_projection_reaches_the_scan(spark, items, tmp_path):
    path = str(tmp_path / "p.parquet")
    files.save(items, path)
    df = files.read_parquet(spark, path, ["score", "unknown"]).filter("score > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.columns == ["score"] and "name" not in plan.split("ReadSchema")[1] and "GreaterThan(score,3.0)" in plan
    assert files.read_parquet(spark, path, ["unknown"]).columns == ["id", "name", "score"]


def test_container(spark, items):
    table = items.toArrow()
    for how in container.Compression:
        assert container.loads(container.dumps(table, compression=how)).table.equals(table)
    data = container.dumps(table, kind=container.DatasetType.TEXT_CORPUS, metadata=container.Metadata(name="n", tags=["a"]))
    back = container.loads(data)
    assert back.kind == container.DatasetType.TEXT_CORPUS and back.metadata.name == "n" and back.metadata.sha256
    with pytest.raises(ChecksumMismatch):
        container.loads(data[:100] + b"\x00" + data[101:])
    with pytest.raises(FormatError):
        container.loads(b"nope" * 20)


def test_container_protection(spark, items):
    table = items.toArrow()
    data = container.dumps(table, spark=spark, password="p")
    assert container.loads(data, spark, password="p").table.equals(table)
    with pytest.raises(DecryptionFailed):
        container.loads(data, spark, password="q")
    with pytest.raises(InvalidConfig):
        container.loads(data)
    to = crypto.recipient_keys(spark)
    assert container.loads(container.dumps(table, spark=spark, recipient=to.public), spark, private=to.private).table.equals(table)
    keys = crypto.signing_keys(spark)
    lic = container.License.issue("someone", days=1, now=1000, seat_limit=3, terms=b"be nice")
    data = container.dumps(table, spark=spark, signer=keys, license=lic)
    back = container.loads(data, spark, trusted=keys.public, now=1001)
    assert back.signer == keys.public and back.license == lic
    with pytest.raises(SignatureInvalid):
        container.loads(data, spark, trusted=bytes(32), now=1001)
    with pytest.raises(LicenseExpired):
        container.loads(data, spark, now=10**6)


def test_raw(spark):
    for text, kind in (("a,b\n1,2", "csv"), ("a\tb\n1\t2", "tsv"), ('{"a": 1}\n{"a": 2}', "jsonl"), ('[{"a": 1}]', "json"), ("plain words", "text"), ("  ", "unknown")):
        assert raw.detect(text) == kind
    assert raw.parse(spark, "one\ntwo").columns == ["line"]
    assert raw.parse(spark, '[{"a": 1}, {"a": 2}]').count() == 2
    assert raw.parse(spark, "a,b\n1,2\n3,4", raw.RawConfig(max_rows=1, infer_types=False)).dtypes == [("a", "string"), ("b", "string")]
    with pytest.raises(EmptyDataset):
        raw.parse(spark, " ")
    assert raw.parse_bytes(spark, b"a,b\n1,2").count() == 1


@pytest.mark.parametrize("kind", ["local", "memory", "hadoop"])
def test_storage(spark, tmp_path, kind):
    s = {"local": lambda: storage.LocalStorage(str(tmp_path)), "memory": storage.MemoryStorage, "hadoop": lambda: storage.HadoopStorage(spark, f"file://{tmp_path}/h")}[kind]()
    s.put("a/x.bin", b"\x00\xff12")
    s.put("b", b"")
    assert s.get("a/x.bin") == b"\x00\xff12" and s.size("a/x.bin") == 4 and s.exists("b") and not s.exists("c")
    assert [k for k in s.list("") if not k.endswith(".crc")] == ["a/x.bin", "b"] and s.list("zz") == []
    s.delete("b")
    s.delete("b")
    assert not s.exists("b")
    with pytest.raises(NotFound):
        s.get("b")


class FakeClient(storage.HttpClient):
    def __init__(self, answers):
        super().__init__()
        self.answers, self.asked = answers, []

    def request(self, method, url, headers=None, body=None):
        self.asked.append((method, url, headers, body))
        return self.answers.get((method, url), (404, {}, b""))


def test_http():
    c = FakeClient({("GET", "http://h/f"): (206, {}, b"234"), ("HEAD", "http://h/f"): (200, {"accept-ranges": "bytes", "content-length": "9"}, b"")})
    s = storage.HttpStorage("http://h/", c)
    assert s.get_range("f", 2, 4) == b"234" and c.asked[-1][2]["Range"] == "bytes=2-4"
    assert s.supports_range("f") and s.size("f") == 9 and not s.exists("g")
    for bad in (lambda: s.put("x", b""), lambda: s.list(), lambda: s.delete("x")):
        with pytest.raises(StorageError):
            bad()
    assert storage.s3_options("http://minio", "a", "b")["spark.hadoop.fs.s3a.path.style.access"] == "true"


def test_hub(spark, items, tmp_path):
    url = "https://huggingface.co/datasets/o/n/resolve/main/data/default/train.parquet"
    tree = json.dumps([{"type": "file", "path": "data/a.parquet"}, {"type": "file", "path": "README.md"}]).encode()
    c = FakeClient({("GET", url): (200, {}, files.to_parquet_bytes(items)), ("GET", "https://huggingface.co/api/datasets/o/n/tree/main?recursive=true"): (200, {}, tree)})
    d = hub.HubDataset("o/n", cache=str(tmp_path), client=c)
    assert rows(d.download(spark)) == rows(items) and d.download(spark).count() == 30 and len(c.asked) == 1
    assert d.files() == ["data/a.parquet"]
    d.clear_cache()
    assert not d.cached.exists()
    with pytest.raises(NotFound):
        hub.HubDataset("o/n", split="none", cache=str(tmp_path), client=c).fetch()
    lines = [json.loads(x) for x in hub.commit_large("m", "p", "oid", 3).split("\n")]
    assert [x["key"] for x in lines] == ["header", "lfsFile"] and hub.is_binary("x.PARQUET") and not hub.is_binary("README.md")
    errors = hub.validate_card("---\ntask_categories:\n- text-generatio\n- other\nsize_categories: [n<1K, huge]\n---\n# x")
    assert [(e.name, e.value) for e in errors] == [("task_categories", "text-generatio"), ("size_categories", "huge")] and "text-generation" in errors[0].suggestions
    assert hub.levenshtein("kitten", "sitting") == 3 and hub.suggest_task("ner") == "token-classification" and hub.is_license("MIT")
    p = hub.Publisher("o/n", "t", FakeClient({("POST", "https://huggingface.co/api/datasets/o/n/commit/main"): (200, {}, b"{}")}))
    p.upload("README.md", b"hi")
    with pytest.raises(InvalidConfig):
        p.upload_card("---\ntask_categories:\n- nonsense-task-xyz\n---")


def test_registry(spark, items, tmp_path):
    r = Registry(spark, f"file://{tmp_path}/reg")
    r.init()
    assert r.list() == []
    r.publish("d", "2.0", items, description="Some items", tags=["x"])
    r.publish("d", "1.0", items.limit(3))
    assert r.info("d").latest == "1.0" and r.pull("d").count() == 3 and r.pull("d", "2.0").count() == 30
    assert r.search("SOME").count() == 1 and r.search_tags(["x", "y"]).count() == 1 and r.search_tags(["z"]).count() == 0
    r.delete("d", "1.0")
    assert r.info("d").latest == "2.0"
    r.delete("d", "2.0")
    with pytest.raises(NotFound):
        r.info("d")
    r.storage.put("registry-index.json", b"damaged")
    with pytest.raises(ParseError):
        r.publish("e", "1", items)


def test_content(spark):
    schema = Schema("s", fields=(Field("a", "integer", constraints=(Constraint("min", 2),)), Field("b", "string", nullable=True, constraints=(Constraint("pattern", "^x"), Constraint("max_length", 3)))))
    df = spark.createDataFrame([(1, "x"), (2, "yyyy"), (None, None), (3, "xx")], "a long, b string")
    got = [r["_violations"] for r in schema.validate(df).collect()]
    assert got == [["a:min"], ["b:pattern", "b:max_length"], ["a:required"], []] and not schema.is_valid(df)
    book = json.dumps({"id": "b", "title": "T", "author": "A", "chapters": [{"id": "c1", "title": "One", "order": 1, "settings": {"difficulty": "easy"}}, {"id": "c2", "title": "Two", "order": 2}]})
    out = BOOK.to_rows(documents(spark, [book])).collect()
    assert [(r.chapter_id, r.order, r.difficulty) for r in out] == [("c1", "1", "easy"), ("c2", "2", None)]
    assert [i.path for i in BOOK.validate('{"id": "b", "chapters": [{"id": ""}]}')] == ["title", "author", "chapters[0].id", "chapters[0].title"]
    course = json.dumps({"id": "c", "title": "T", "description": "d", "weeks": 3, "categories": ["x", "y"]})
    assert COURSE.to_rows(documents(spark, [course])).first().categories == "x, y" and not COURSE.validate(course)
    assert ContentRegistry().names() == ["book", "course", "dataset", "raw"]
    with pytest.raises(ParseError):
        BOOK.validate("{")


def test_builtin(spark):
    d = builtin.iris(spark)
    assert len(d) == 150 and d.data.groupBy("species").count().count() == 3
    s = d.split()
    assert s.train.count() == 120 and s.test.count() == 30
    assert d.data.select(builtin.species_code().alias("x")).agg(F.max("x")).first()[0] == 2
    m = builtin.mnist(spark)
    assert len(m.wide().columns) == 785 and m.data.filter("size(pixels) = 784").count() == 100
    assert builtin.cifar100(spark).data.select("coarse_label").distinct().count() == 20


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 3).alias("k"), (F.col("id") + 1.0).alias("v"))
    df.repartition(2).write.parquet(src)
    stream = frames.read_stream(spark, src, df.schema)
    q = frames.windowed_counts(stream, "ts", ["k"]).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 100
    q = frames.windowed_ddsketch(stream, "ts", "v").writeStream.format("memory").queryName("dd").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("dd").agg(F.sum("n")).first()[0] == 100
    q = frames.each_batch(stream, lambda d: d.filter("k = 1"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 33


def test_viewer(items):
    v = Viewer(items, "id", 10)
    assert "item_0" in v.render() and "rows 1-10 of 30" in v.render()
    v.down()
    assert "item_10" in v.render() and v.find("item_25") == 25
    assert v.detail(3).startswith("id: 3")
    assert width("日本") == 4 and truncate("abcdefgh", 6) == "abc..." and cell(None) == "NULL" and cell([1]) == "<list>" and cell(1.234) == "1.23"


def test_cli(spark, items, tmp_path):
    src, out = str(tmp_path / "t.parquet"), io.StringIO()
    docs = spark.createDataFrame([(1, "Some text of a fair length here."), (2, "Some text of a fair length here."), (3, "!!!")], "doc_id long, text string")
    files.save(docs, src)
    go = lambda *a: cli.run([str(x) for x in a], spark, out)
    assert go("convert", src, tmp_path / "t.csv") == 0 and go("info", src) == 0 and go("schema", src) == 0 and go("head", src, "--rows", 2) == 0
    go("dedup", src, tmp_path / "d.parquet", "--key", "doc_id")
    assert spark.read.parquet(str(tmp_path / "d.parquet")).count() == 2
    go("filter-text", src, tmp_path / "f.parquet", "--min-score", 0.8)
    assert spark.read.parquet(str(tmp_path / "f.parquet")).count() == 2
    go("fim", src, tmp_path / "m.parquet", "--key", "doc_id", "--rate", 1.0)
    assert spark.read.parquet(str(tmp_path / "m.parquet")).filter("text LIKE '%fim_middle%'").count() == 2
    go("mix", f"{src}:1", f"{src}:2", "--output", tmp_path / "x.parquet", "--key", "doc_id")
    assert spark.read.parquet(str(tmp_path / "x.parquet")).count() == 6
    assert go("quality", "score", src, "--suggest") in (0, 1) and go("quality", "check", src, "--json") == 0 and go("quality", "profiles") == 0
    a = str(tmp_path / "i.parquet")
    files.save(items, a)
    assert go("drift", "detect", a, a) == 0 and "drifted: none" in out.getvalue()
    go("drift", "sketch", a, tmp_path / "s.parquet")
    assert go("drift", "compare", tmp_path / "s.parquet", tmp_path / "s.parquet") == 0
    reg = f"file://{tmp_path}/reg"
    assert go("registry", "init", reg) == 0 and go("registry", "push", reg, "n", "1", src) == 0 and go("registry", "list", reg) == 0
    assert go("view", src, "--order", "doc_id") == 0 and "of 3" in out.getvalue()


def test_session(spark, items, tmp_path):
    path = str(tmp_path / "t.parquet")
    files.save(items, path)
    s = Session(spark)
    assert s.prompt() == "prep> " and s.execute(f"LOAD {path}") == "loaded t"
    assert "item" in s.execute("head 2") and "id: bigint" in s.execute("schema") and '"rows": 30' in s.execute("info")
    assert s.execute("quality score --suggest").startswith(("A", "B", "C", "D", "F")) and s.execute("quality check").startswith("score")
    assert "none" in s.execute("drift detect t") and "t" in s.complete("use t") and s.complete("he") == ["head", "help"]
    schema = tmp_path / "s.json"
    schema.write_text(json.dumps({"fields": [{"name": "id", "type": "integer", "constraints": {"max": 10}}]}))
    assert s.execute(f"validate --schema {schema}") == "19 rows break the schema"
    assert "head 2" in s.execute("history --export") and s.execute("datasets") == "* t"
    for bad in ("", "nope", "load", "quality", "drift detect", "validate", "head x"):
        with pytest.raises(ParseError):
            parse_command(bad)
    with pytest.raises(EOFError):
        s.execute("exit")


def test_issues_of_all_documents_are_those_of_each(spark):
    books = [{"id": "b", "title": "t", "author": "a", "chapters": []}, {"id": "0", "chapters": [{"id": "0", "title": ""}, {"title": "x"}]}, {"title": "", "author": None}, {}]
    courses = [{"id": "c", "title": "t", "weeks": 0}, {"id": "c", "title": "t", "weeks": 3}, {}]
    for kind, documents in ((content.BOOK, books), (content.COURSE, courses)):
        rows_ = [(i, json.dumps(x)) for i, x in enumerate(documents)]
        got = kind.issues(spark.createDataFrame(rows_, "k int, json string"), "k").collect()
        assert sorted((r.k, r.path, r.message) for r in got) == sorted((i, x.path, x.message) for i, t in rows_ for x in kind.validate(t))
