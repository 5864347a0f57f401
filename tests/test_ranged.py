"""Parquet over HTTP, from a server of this process that answers ranges and keeps what it was asked for."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException

from sparkprep.errors import ColumnNotFound, EmptyDataset, NotFound, StorageError
from sparkprep.sources import hub, ranged


@pytest.fixture(scope="module")
def served(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hub")
    rng = np.random.default_rng(0)
    for k in range(2):
        ids = np.arange(5000) + 5000 * k
        table = pa.table({"id": ids, "name": [f"n{i}" for i in ids], "wide": [rng.bytes(200) for _ in ids]})
        pq.write_table(table, folder / f"f{k}.parquet", row_group_size=500)
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if "/api/" in self.path:
                body = json.dumps([{"type": "file", "path": f"f{k}.parquet"} for k in range(2)] + [{"type": "file", "path": "x.md"}]).encode()
                self.send_response(200)
            else:
                path = folder / self.path.rpartition("/")[2]
                if not path.exists():
                    self.send_response(404)
                    self.end_headers()
                    return
                data, span = path.read_bytes(), re.fullmatch(r"bytes=(\d*)-(\d*)", self.headers.get("Range", ""))
                if span and "noranges" not in self.path:
                    a, b = (max(0, len(data) - int(span[2])), len(data)) if not span[1] else (int(span[1]), int(span[2]) + 1)
                    body = data[a:b]
                    self.send_response(206)
                    self.send_header("Content-Range", f"bytes {a}-{b - 1}/{len(data)}")
                    asked.append((path.name, len(body)))
                else:
                    body = data
                    self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", folder, asked
    server.shutdown()


def test_executors_fetch_their_ranges(spark, served):
    root, folder, asked = served
    urls = [f"{root}/f0.parquet", f"{root}/f1.parquet"]
    groups = ranged.row_groups(spark, urls, ranged.HttpClient()).collect()
    assert len(groups) == 20 and sum(g.rows for g in groups) == 10000
    asked.clear()
    got = ranged.read_ranged(spark, urls, columns=["name", "id"])
    assert got.columns == ["name", "id"] and sorted((r.id, r.name) for r in got.collect()) == [(i, f"n{i}") for i in range(10000)]
    size = sum((folder / f"f{k}.parquet").stat().st_size for k in range(2))
    plain = [n for _, n in asked if n != ranged.TAIL]
    assert sum(plain) < size / 4 and max(plain) < size / 20  # neither the wide column nor more than a row group's columns at once
    assert ranged.read_ranged(spark, urls).exceptAll(spark.read.parquet(str(folder))).isEmpty()


def test_hub_datasets_are_scanned(spark, served):
    root = served[0]
    dataset = hub.HubDataset("o/n", split="f0", hub=root)
    assert dataset.scan(spark, ["id"]).count() == 5000
    assert dataset.scan(spark, ["id"], all_files=True).selectExpr("sum(id)").first()[0] == sum(range(10000))
    with pytest.raises(NotFound):
        hub.HubDataset("o/n", split="none", hub=root).scan(spark)


def test_ranges_are_needed(spark, served):
    root = served[0]
    with pytest.raises(StorageError, match="no ranges"):
        ranged.read_ranged(spark, [f"{root}/noranges/f0.parquet"])
    with pytest.raises(ColumnNotFound):
        ranged.read_ranged(spark, [f"{root}/f0.parquet"], columns=["x"])
    with pytest.raises(EmptyDataset):
        ranged.read_ranged(spark, [])
    with pytest.raises(PySparkException):
        ranged.read_ranged(spark, [f"{root}/f0.parquet", f"{root}/gone.parquet"]).count()
