"""Chunked containers: what is fetched, failed and competing writes, encryption, and stores that open() can't reach."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkprep.errors import ChecksumMismatch, ColumnNotFound, DecryptionFailed, EmptyDataset, InvalidConfig, StorageError
from sparkprep.sources import batches, chunks, container, crypto

ROWS = "id long, name string, at timestamp, tags array<string>, size int"


@pytest.fixture(scope="module")
def items(spark):
    df = spark.range(1000).selectExpr("id", "concat('n', id) AS name", "timestamp_seconds(id) AS at", "array(string(id), null) AS tags", "IF(id % 7 = 0, null, int(id % 10)) AS size")
    return df.repartitionByRange(4, "id").sortWithinPartitions("id").cache()


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def all_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("how", list(container.Compression))
def test_rows_return(spark, items, tmp_path, how):
    path = str(tmp_path / "c.spd")
    index = chunks.write_chunks(items, path, 70, how)
    held = chunks.Chunked(spark, path)
    assert held.num_rows == 1000 and sum(c.num_rows for c in held.chunks) == 1000 and all(c.num_rows <= 70 for c in held.chunks) and held.chunks == index.chunks
    assert all_rows(held.rows()) == all_rows(items) and held.rows().schema == items.schema and all_rows(container.read_container(spark, path)) == all_rows(items)
    for start, count in ((0, 1), (69, 2), (5, 400), (999, 1), (990, 50), (1000, 5), (3, 0)):
        got = held.get_rows(start, count)
        assert ids(got) == list(range(start, min(1000, start + count)))
    for i in (0, len(held.chunks) - 1):
        assert ids(held.get_chunk(i)) == list(range(held.chunks[i].row_offset, held.chunks[i].row_offset + held.chunks[i].num_rows))
    assert held.find(999) == len(held.chunks) - 1 and held.find(1000) == -1 and held.chunks[held.find(70)].row_offset <= 70
    held.verify()
    with pytest.raises(ColumnNotFound):
        held.rows(["nothing"])


def test_only_what_is_asked_for_is_fetched(spark, items, tmp_path):
    """Input partitions are chunks, and the files hold no column but those asked for in what is read."""
    path = str(tmp_path / "c.spd")
    chunks.write_chunks(items, path, 50)
    table, index = chunks.scan(spark, path), chunks.Chunked(spark, path).index
    assert table.rdd.getNumPartitions() == len(index.chunks)
    for condition, low, high in ((f"{chunks.ROW} >= 120 AND {chunks.ROW} < 210", 120, 210), (f"{chunks.ROW} = 7", 7, 8), (f"{chunks.ROW} > 120 AND {chunks.ROW} <= 210 AND size = 3", 121, 211)):
        found = table.filter(condition)
        assert found.rdd.getNumPartitions() == len(index.between(low, high)) < len(index.chunks)
        assert ids(found) == sorted(r.id for r in items.filter(condition.replace(chunks.ROW, "id")).collect())
    some = table.filter(F.col(chunks.ROW).isin(3, 4, 777, 5000))
    assert ids(some) == [3, 4, 777] and some.rdd.getNumPartitions() == 2
    assert table.filter(f"{chunks.ROW} = id").count() == 1000 and table.filter(f"{chunks.ROW} > 5000").count() == 0
    narrow = chunks.scan(spark, path, ["size", chunks.ROW])
    assert narrow.columns == ["size", chunks.ROW] and narrow.filter(f"{chunks.ROW} = 11").first().size == 1
    plan = chunks.Chunked(spark, path).get_rows(60, 100, ["size"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<run:bigint,part:bigint,seq:bigint,n:bigint,c4:binary>" in plan and "GreaterThanOrEqual(part," in plan
    for file in glob.glob(f"{path}/chunks-*/*.parquet"):
        assert pq.ParquetFile(file).num_row_groups == pq.read_metadata(file).num_rows


def test_nothing_and_few(spark, items, tmp_path):
    path = str(tmp_path / "c.spd")
    with pytest.raises(EmptyDataset):
        chunks.Chunked(spark, path)
    chunks.write_chunks(items.limit(0), path)
    assert chunks.Chunked(spark, path).rows().count() == 0 and chunks.scan(spark, path).count() == 0
    chunks.write_chunks(items.filter("id = 3"), path)
    assert ids(chunks.Chunked(spark, path).rows()) == [3]
    for bad in ({"chunk_rows": 0}, {"mode": "x"}, {"mode": "error"}):
        with pytest.raises(InvalidConfig):
            chunks.write_chunks(items, path, **bad)


def test_failed_writes_leave_the_table(spark, items, tmp_path):
    path = str(tmp_path / "c.spd")
    chunks.write_chunks(items.filter("id < 100"), path, 30)
    broken = items.withColumn("size", F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).otherwise(F.col("size")).cast("int"))
    for mode in ("append", "overwrite"):
        with pytest.raises(PySparkException):
            chunks.write_chunks(broken, path, 30, mode=mode)
        assert ids(chunks.Chunked(spark, path).rows()) == list(range(100))
        assert len(glob.glob(f"{path}/chunks-*")) == 1 and len(glob.glob(f"{path}/*")) == 2


def test_versions(spark, items, tmp_path):
    """Appended runs are new versions; older readers keep theirs; of two writers of one version one fails and leaves nothing."""
    path = str(tmp_path / "c.spd")
    chunks.write_chunks(items.filter("id < 100"), path, 30)
    first = chunks.Chunked(spark, path)
    chunks.write_chunks(items.filter("id >= 100 AND id < 150"), path, 30, mode="append")
    second = chunks.Chunked(spark, path)
    assert first.rows().count() == 100 and ids(second.rows()) == list(range(150)) and ids(second.get_rows(90, 20)) == list(range(90, 110))
    assert ids(chunks.scan(spark, path).filter(f"{chunks.ROW} >= 95 AND {chunks.ROW} < 105")) == list(range(95, 105))
    assert ids(chunks.Chunked(spark, path, version=0).rows()) == list(range(100))
    with pytest.raises(InvalidConfig):
        chunks.write_chunks(items.select("id"), path, mode="append")
    store = first.store
    with pytest.raises(StorageError):
        store.put("x", b"") or store.rename("x", "index-00000001")
    store.delete("x")
    chunks.write_chunks(items.filter("id < 7"), path)
    assert chunks.Chunked(spark, path).num_rows == 7 and len(glob.glob(f"{path}/*")) == 2


def test_stores_that_only_spark_reaches(spark, items, tmp_path):
    """A mount table has no folder of that name: chunks and index go through Hadoop's file systems."""
    (tmp_path / "in").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.chunks.link./in", f"file://{tmp_path}/in")
    path = "viewfs://chunks/in/c.spd"
    chunks.write_chunks(items, path, 300)
    assert ids(chunks.Chunked(spark, path).get_rows(250, 100)) == list(range(250, 350))
    assert chunks.scan(spark, path).filter(f"{chunks.ROW} < 10").count() == 10 and not glob.glob("viewfs*")


def test_encrypted_chunks(spark, items, tmp_path):
    path = str(tmp_path / "c.spd")
    chunks.write_chunks(items.filter("id < 500"), path, 40, password="p")
    chunks.write_chunks(items.filter("id >= 500"), path, 40, mode="append", password="p")
    held = chunks.Chunked(spark, path, password="p")
    assert all_rows(held.rows()) == all_rows(items) and ids(held.get_rows(30, 50, ["id"])) == list(range(30, 80))
    assert b"n123" not in b"".join(open(f, "rb").read() for f in glob.glob(f"{path}/chunks-*/*.parquet"))
    with pytest.raises(DecryptionFailed):
        chunks.Chunked(spark, path, password="q")
    with pytest.raises(InvalidConfig):
        chunks.Chunked(spark, path)
    with pytest.raises(PySparkException):
        chunks.scan(spark, path).count()
    with pytest.raises(InvalidConfig):
        chunks.write_chunks(items, path, mode="append")
    to = crypto.recipient_keys(spark)
    chunks.write_chunks(items, path, 400, recipient=to.public)
    assert chunks.Chunked(spark, path, private=to.private).rows().count() == 1000


@pytest.mark.parametrize("password", ["p", None])
def test_changed_chunks_are_found(spark, items, tmp_path, password):
    path = str(tmp_path / "c.spd")
    chunks.write_chunks(items.coalesce(1), path, 100, password=password)
    held = chunks.Chunked(spark, path, password=password)
    folder = f"{held.store.root}/{held.index.folders[0]}"
    stored = spark.createDataFrame(spark.read.parquet(folder).toArrow())

    def put(df):
        df.coalesce(1).write.mode("overwrite").parquet(folder)

    if password:  # two chunks of one size change places
        put(stored.withColumn("seq", F.expr("CASE seq WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE seq END")))
        assert ids(held.get_rows(0, 300, ["id"])) == list(range(300))
        with pytest.raises(PySparkException):
            held.rows(["id"]).collect()
    else:
        put(stored.withColumn("c0", F.when(F.col("seq") == 4, F.concat(F.expr("substring(c0, 1, 50)"), F.lit(b"x"), F.expr("substring(c0, 52)"))).otherwise(F.col("c0"))))
        with pytest.raises(PySparkException, match="damaged"):
            held.rows(["id"]).collect()
    put(stored.filter("seq != 5"))
    with pytest.raises(ChecksumMismatch):
        held.verify()
    data = bytearray(held.store.get("index-00000000"))
    data[60] ^= 1
    held.store.put("index-00000000", bytes(data))
    with pytest.raises(ChecksumMismatch):
        chunks.Chunked(spark, path, password=password)
    if password:  # a check sum that fits doesn't help
        held.store.put("index-00000000", chunks.replace(held.index, chunks=held.chunks[:5]).dumps(b"guess"))
        with pytest.raises(DecryptionFailed):
            chunks.Chunked(spark, path, password=password)


def test_streams_go_on_from_their_checkpoint(spark, items, tmp_path):
    path, out = str(tmp_path / "c.spd"), str(tmp_path / "out-a")
    chunks.write_chunks(items.filter("id < 300"), path, 50)

    def run(checkpoint):
        batches.register(spark, "held_chunks", chunks.ChunkBatches(spark, path))
        query = batches.stream_batches(spark, "held_chunks").writeStream.format("parquet").option("path", str(tmp_path / f"out-{checkpoint}")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    assert run("a") == 300 and run("a") == 0
    chunks.write_chunks(items.filter("id >= 300 AND id < 420"), path, 50, mode="append")
    assert run("a") == 120 and ids(spark.read.parquet(out)) == list(range(420))
    assert run("b") == 420  # a new checkpoint begins anew
    assert spark.read.format("held_chunks").load().count() == 420
