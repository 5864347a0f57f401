import duckdb
import pytest

import corpus_pipeline
from sparkprep.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    columns = ", ".join(sorted(got.columns))
    want = con.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=str) == sorted(want, key=str)


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{len(seen)}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        seen.append((name, docs.count()))
        assert name == "packing" or docs.columns == columns
    assert [n for n, _ in seen] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    assert all(n > 0 for _, n in seen)
    assert corpus_pipeline.run(spark, SF).count() == seen[-1][1]
