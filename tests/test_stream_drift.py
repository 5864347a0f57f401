"""Windows of a replayed table: digests within their bound, counts exact, late rows dropped, restarts, and verdicts."""

import datetime

import numpy as np
import pytest

from sparkprep.profile import sketches
from sparkprep.streaming import drift

HOUR = 3_600_000


@pytest.fixture(scope="module")
def replayed(spark, tmp_path_factory):
    """Four hours of values, the third one shifted, in six files; a row of hour 0 comes last, and a row of hour 9 closes what is open."""
    rng, folder = np.random.default_rng(4), str(tmp_path_factory.mktemp("replayed"))
    values = {h: rng.lognormal(2 if h != 2 else 3, 0.5, 3000) for h in range(4)}
    at = lambda h, m: datetime.datetime(2024, 1, 1, h) + datetime.timedelta(minutes=m)
    rows = [(at(h, int(i % 60)), float(v), None if i % 3 else 1) for h in range(4) for i, v in enumerate(values[h])] + [(None, 1.0, 1), (at(1, 5), float("nan"), None), (at(1, 5), None, None)]
    schema = "ts timestamp, v double, w int"
    for k, part in enumerate([rows[i : i + 2501] for i in range(0, len(rows), 2501)]):
        spark.createDataFrame(part, schema).repartition(3).write.parquet(f"{folder}/a{k}")
    spark.createDataFrame([(at(9, 0), 1.0, None)], schema).write.parquet(f"{folder}/b")
    spark.createDataFrame([(at(0, 1), 1e9, None)], schema).write.parquet(f"{folder}/c")
    spark.createDataFrame([(at(20, 0), 1.0, None)], schema).write.parquet(f"{folder}/d")
    return folder, values, schema


def test_windows_close_with_their_digests(spark, replayed, tmp_path):
    folder, values, schema = replayed
    reference = sketches.td_quantiles(sketches.tdigest(spark.createDataFrame([(float(x),) for x in values[0]], "v double")), sketches.steps())

    def run(*parts):
        for p in parts:
            files = spark.readStream.schema(schema).parquet(f"{folder}/{p}*")
            out = drift.windowed_drift(files, "ts", ["v", "w"], HOUR, reference, late="30 minutes")
            stream = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
            stream.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    run("a")
    got = run("[ab]", "[abc]", "[abcd]")  # each run is a restart from the checkpoint
    by = {(r.start.hour, r.column): r for r in got}
    assert sorted(by) == sorted([*((h, c) for h in range(4) for c in ("v", "w")), (9, "v")]) and len(got) == len(by)
    for h, v in values.items():
        r = by[h, "v"]
        assert r.n == 3000 and r.low == v.min() and r.high == v.max() and by[h, "w"].n == 1000  # the late row isn't among them
        q = drift.digest_quantiles(np.array(r.means), np.array(r.weights), r.low, r.high, sketches.steps())
        assert np.abs(np.searchsorted(np.sort(v), q) / 3000 - sketches.steps()).max() < 0.01
    assert by[0, "v"].severity == by[1, "v"].severity == "None" and by[2, "v"].severity == "Critical" and by[2, "w"].severity is None
    assert by[2, "v"].statistic == pytest.approx(np.e - 1, rel=0.2)


def test_verdicts_are_those_of_tables(spark):
    a, b = (spark.createDataFrame([("x", q, v) for q, v in zip((0.2, 0.5, 0.8), x, strict=True)], "column string, q double, value double") for x in ((0.0, 2.0, -4.0), (1e-3, 2.5, -4.1)))
    for x, y in ((a, b), (b, a), (a, a)):
        want = sketches.compare(x, y).first()
        left, right = (np.array([r.value for r in t.orderBy("q").collect()]) for t in (x, y))
        assert drift.relative_difference(left, right) == pytest.approx(want.statistic) and sketches.severity_of(want.statistic, 0.1) == want.severity
