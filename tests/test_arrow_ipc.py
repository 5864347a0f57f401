"""Arrow IPC files: ranges of large files, failed writes, and mount tables."""

import glob
import os

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkprep.errors import EmptyDataset
from sparkprep.sources import arrow_ipc


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_file_of_many_batches_is_read_by_many_tasks(spark, tmp_path):
    schema = pa.schema([("id", pa.int64()), ("s", pa.string())])
    with pa.OSFile(str(tmp_path / "many of them.arrow"), "wb") as f, pa.ipc.new_file(f, schema) as sink:
        for i in range(100):
            sink.write_batch(pa.RecordBatch.from_arrays([pa.array(range(10 * i, 10 * i + 10)), pa.array([f"{i}"] * 10)], schema=schema))
    for path in (str(tmp_path), str(tmp_path / "many of them.arrow"), str(tmp_path / "many*.arrow")):
        runs = arrow_ipc.runs(spark, path, 5)
        assert runs.count() == 20 and runs.agg(F.sum("n")).first()[0] == 100
        df = arrow_ipc.read_ipc(spark, path, batches=5)
        assert ids(df) == list(range(1000))
        assert df.select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("stream", [False, True])
def test_round_trip(spark, tmp_path, stream):
    df = spark.range(100).selectExpr("id", "array(id, null) AS a", "IF(id % 3 = 0, null, string(id)) AS s").repartition(3)
    path = str(tmp_path / "out")
    arrow_ipc.write_ipc(df, path, stream)
    assert sorted(map(str, arrow_ipc.read_ipc(spark, path, stream).collect())) == sorted(map(str, df.collect()))
    arrow_ipc.write_ipc(df.filter("id < 5"), path, stream)
    assert ids(arrow_ipc.read_ipc(spark, path, stream)) == list(range(5)) and not glob.glob(f"{path}/_*")


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    arrow_ipc.write_ipc(spark.range(10), path)
    with pytest.raises(PySparkException):
        arrow_ipc.write_ipc(spark.range(1000).withColumn("id", F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long")), path)
    assert ids(arrow_ipc.read_ipc(spark, path)) == list(range(10)) and not glob.glob(f"{path}/_*")
    os.mkdir(tmp_path / "none")
    with pytest.raises(EmptyDataset):
        arrow_ipc.read_ipc(spark, str(tmp_path / "none"))


def test_mount_tables(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.ipc.link./in", f"file://{tmp_path}")
    arrow_ipc.write_ipc(spark.range(30).repartition(2), "viewfs://ipc/in/out")
    assert ids(arrow_ipc.read_ipc(spark, "viewfs://ipc/in/out")) == list(range(30))
