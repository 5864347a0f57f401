import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkprep import core
from sparkprep.errors import ColumnNotFound, EmptyDataset, IndexOutOfBounds, InvalidConfig, SchemaMismatch
from sparkprep.operators import columns, doctests, federated, fim, rows, similarity, splits, tensors, values, watermark


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, f"item_{i}", 1.5 * i if i % 3 else None) for i in range(20)], "id int, name string, score double").repartition(3).cache()


def ids(df, name="id"):
    return [r[0] for r in df.select(name).collect()]


def test_columns(spark, items):
    assert items.transform(columns.select("score", "id")).columns == ["score", "id"]
    with pytest.raises(ColumnNotFound):
        items.transform(columns.select("x"))
    assert items.transform(columns.drop("name", "x")).columns == ["id", "score"]
    with pytest.raises(InvalidConfig):
        items.transform(columns.drop("id", "name", "score"))
    assert items.transform(columns.rename({"id": "key", "x": "y"})).columns == ["key", "name", "score"]
    got = items.transform(columns.cast({"name": "int", "x": "int"})).filter("name IS NOT NULL").count()
    assert got == 0
    double = columns.map_batches(lambda b: pa.RecordBatch.from_arrays([pa.array([2 * x for x in b.column(0).to_pylist()], pa.int32())], ["id"]), "id int")
    assert sorted(ids(items.select("id").transform(double))) == list(range(0, 40, 2))
    chain = columns.Chain().then(columns.where(F.col("score") > 3)).then(columns.select("id"))
    assert len(chain) == 2 and sorted(ids(chain(items)))[:2] == [4, 5]
    with pytest.raises(SchemaMismatch):
        columns.union_all(items, items.select("id"))
    assert columns.union_all(items, items).count() == 40
    assert columns.info(items)["rows"] == 20 and columns.schema_table(items).count() == 3


def test_order(items):
    assert ids(items.transform(rows.sort("score", descending=True)))[-1] % 3 == 0
    assert ids(items.transform(rows.sort("score", nulls_first=True)))[0] % 3 == 0
    assert ids(items.transform(rows.take(3, F.col("id").desc()))) == [19, 18, 17]
    assert sorted(ids(items.transform(rows.skip(15, "id")))) == [15, 16, 17, 18, 19]
    assert rows.row(items, 7, "id").id == 7
    with pytest.raises(IndexOutOfBounds):
        rows.row(items, 20, "id")
    numbered = core.with_row_id(items, "id")
    assert all(r.id == r["_row_id"] for r in numbered.collect())


def test_samples_are_reproducible(items):
    a, b = (ids(items.transform(rows.shuffle(5, "id"))) for _ in range(2))
    assert a == b and a != sorted(a) and sorted(a) == list(range(20))
    assert ids(items.repartition(7).transform(rows.shuffle(5, "id"))) == a
    assert items.transform(rows.sample(5, key="id")).count() == 5
    assert items.transform(rows.sample(fraction=0.25, key="id")).count() == 5
    assert items.transform(rows.sample(99, key="id")).count() == 20


def test_unique(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, 1.0), (4, None, 1.0), (5, "b", None)], "id int, k string, v double")
    assert sorted(ids(df.transform(rows.unique("k", "id")))) == [1, 3, 5]
    assert sorted(ids(df.transform(rows.unique("k", "id", keep="last")))) == [2, 4, 5]
    assert sorted(ids(df.transform(rows.unique(["k", "v"], F.col("id").desc())))) == [2, 4, 5]
    assert rows.duplicate_rows(df.drop("id")).first().duplicate_rows == 2
    assert rows.duplicate_rows(df.limit(0)).first().duplicate_rows == 0


@pytest.mark.parametrize("backward", [False, True])
def test_fill_over_partitions(spark, backward):
    """Whole partitions of nulls, nulls at the ends, keys that are null, nested values, clashing names, and orders by expressions."""
    rows = [(i if i % 37 else None, [str(i)] if i % 50 == 20 else None, i) for i in range(37, 400)]
    df = spark.createDataFrame(rows, "k int, v array<string>, _part int").repartition(5)
    df = df.filter("k IS NOT NULL")
    fill = values.fill_backward if backward else values.fill_forward
    want, now = {}, None
    for k, v, _ in sorted((r for r in rows if r[0]), reverse=backward):
        now = v or now
        want[k] = now
    for order in ("k", ["k", "_part"], F.col("k").asc(), [F.col("k")]):
        got = df.transform(fill("v", order))
        assert got.columns == df.columns and {r.k: r.v for r in got.collect()} == want
    assert df.limit(0).transform(fill("v", "k")).count() == 0
    nothing = spark.createDataFrame([(i, None) for i in range(9)], "k int, v double")
    assert {r.v for r in nothing.transform(fill("v", "k")).collect()} == {None}
    last = spark.createDataFrame([(None, None, 5), (1, 1.0, 5), (2, None, 5)], "k int, v double, x int").transform(fill("v", "k"))
    assert {r.k: r.v for r in last.collect()} == ({1: 1.0, 2: None, None: None} if backward else {1: 1.0, 2: 1.0, None: 1.0})


def test_fill(spark, items):
    got = {r.id: r.score for r in items.transform(values.fill_forward("score", "id")).collect()}
    assert got[0] is None and got[3] == 3.0 and got[4] == 6.0
    got = {r.id: r.score for r in items.transform(values.fill_backward("score", "id")).collect()}
    assert got[0] == 1.5 and got[18] == 28.5
    assert items.transform(values.fill_value("score", 9.0)).filter("score = 9.0").count() >= 7
    assert items.transform(values.fill_zero("score")).filter("score = 0").count() == 7
    for bad in (1, "x", True):
        with pytest.raises(InvalidConfig):
            items.transform(values.fill_value("score", bad))


def test_normalize(spark, items):
    got = [r.score for r in items.transform(values.normalize("minmax", ["score"])).orderBy("id").collect()]
    assert got[0] is None and got[1] == 0.0 and got[19] == 1.0
    z = np.array([r.score for r in items.transform(values.normalize("zscore", ["score"])).collect() if r.score is not None])
    assert abs(z.mean()) < 1e-12 and abs(z.std() - 1) < 1e-12
    n = np.array([r.score for r in items.transform(values.normalize("l2", ["score"])).collect() if r.score is not None])
    assert abs((n**2).sum() - 1) < 1e-12
    flat = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    assert [r.x for r in flat.transform(values.normalize("minmax")).collect()] == [0.0, 0.0, None]
    with pytest.raises(InvalidConfig):
        items.transform(values.normalize("minmax", ["name"]))


def test_search(items):
    assert rows.search(items, "ITEM_1", "id") == 1
    assert rows.search(items, "item_1", "id", start=12) == 12
    assert rows.search(items, "item_0", "id", start=5) == 0
    assert rows.search(items, "zzz", "id") is None


def test_splits(items):
    s = splits.from_ratios(items, "id", 0.7, 0.2, 0.1)
    assert (s.train.count(), s.test.count(), s.validation.count()) == (14, 4, 2)
    assert sorted(ids(s.train)) == list(range(14))
    a = splits.from_ratios(items, "id", 0.5, 0.5, seed=1)
    assert sorted(ids(a.train) + ids(a.test)) == list(range(20)) and sorted(ids(a.train)) != list(range(10))
    for bad in ((0.5, 0.6, None), (1.0, 0.0, None), (0.9, 0.2, -0.1)):
        with pytest.raises(InvalidConfig):
            splits.from_ratios(items, "id", *bad)
    with pytest.raises(EmptyDataset):
        splits.from_ratios(items.limit(0), "id", 0.5, 0.5)
    labelled = items.withColumn("label", F.when(F.col("id") < 15, "a").when(F.col("id") < 19, "b"))
    s = splits.stratified(labelled, "label", "id", 0.8, 0.2, seed=3)
    assert {r.label: r["count"] for r in s.train.groupBy("label").count().collect()} == {"a": 12, "b": 3}
    assert s.train.count() + s.test.count() == 19


def test_resample_mix_weights(spark, items):
    labelled = items.withColumn("label", (F.col("id") >= 15).cast("int"))
    over = splits.resample(labelled, "label", "oversample", "id")
    assert {r["count"] for r in over.groupBy("label").count().collect()} == {15}
    assert over.filter("label = 1").groupBy("id").count().agg(F.max("count"), F.min("count")).first() == (3, 3)
    assert splits.resample(labelled, "label", "undersample", "id").count() == 10
    mixed = splits.mix([(items, 3.0), (items.limit(5), 1.0)], "id", max_rows=40)
    assert mixed.count() == 40
    drawn = splits.weighted_sample(items.withColumn("w", (F.col("id") % 2).cast("double")), "w", "id", n=200)
    assert drawn.count() == 200 and drawn.filter("id % 2 = 0").count() == 0
    assert drawn.select(F.count_distinct("_draw")).first()[0] == 200
    assert splits.weighted_sample(items.withColumn("w", F.lit(0)), "w", "id", n=30).count() == 30
    with pytest.raises(InvalidConfig):
        splits.weighted_sample(items.withColumn("w", F.lit(-1)), "w", "id")


def test_loader(items):
    loader = splits.DataLoader(items, 6, key="id")
    got = list(loader)
    assert [b.num_rows for b in got] == [6, 6, 6, 2] and len(loader) == 4
    assert [x for b in got for x in b.column("id").to_pylist()] == list(range(20))
    assert len(list(splits.DataLoader(items, 6, key="id", drop_last=True))) == 3
    a, b = ([x for y in splits.DataLoader(items, 7, shuffle=True, seed=2, key="id") for x in y.column("id").to_pylist()] for _ in range(2))
    assert a == b and sorted(a) == list(range(20)) and a != sorted(a)
    assert splits.batches(items, 8, "id").groupBy("_batch_id").count().count() == 3
    assert splits.batches(items, 8, "id", drop_last=True).count() == 16
    with pytest.raises(InvalidConfig):
        splits.DataLoader(items, 0)


def test_parallel_loader(spark):
    """Batches are those of one worker, so many jobs run at once as there are workers, and failures are raised."""
    df = spark.range(600).selectExpr("id", "id * 2 AS x").repartitionByRange(8, "id")
    want = [b.to_pydict() for b in splits.DataLoader(df, 70)]
    for options in ({"workers": 1}, {"workers": 4}, {"workers": 16, "ahead": 1}):
        loader = splits.ParallelDataLoader(df, 70, **options)
        assert [b.to_pydict() for b in loader] == want and loader.most_at_once <= min(options["workers"], 8)
        assert [b.to_pydict() for b in loader] == want

    def slowly(batches):
        time.sleep(0.3)
        yield from batches

    slow = splits.ParallelDataLoader(df.mapInArrow(slowly, df.schema), 600, workers=3)
    assert next(iter(slow)).num_rows == 600 and slow.most_at_once == 3
    plain, many = (list(c(df, 50, shuffle=True, seed=4, key="id", drop_last=True, **o)) for c, o in ((splits.DataLoader, {}), (splits.ParallelDataLoader, {"workers": 3})))
    assert [b.to_pydict() for b in plain] == [b.to_pydict() for b in many]
    broken = df.withColumn("x", F.when(F.col("id") == 500, F.raise_error(F.lit("no"))).otherwise(F.col("x")).cast("long"))
    with pytest.raises(Exception, match="no"):
        list(splits.ParallelDataLoader(broken, 10, workers=2))
    assert next(iter(splits.ParallelDataLoader(df, 10, workers=2))).num_rows == 10  # the rest is left
    assert list(splits.ParallelDataLoader(df.limit(0), 10, workers=2)) == []
    for bad in ({"workers": -1}, {"ahead": 0}):
        with pytest.raises(InvalidConfig):
            splits.ParallelDataLoader(df, 10, **bad)


def test_gram_filters_lose_nothing(spark):
    """A filter that is far too small passes more, and the results stay the same."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    ref = [(i, " ".join(word() for _ in range(8))) for i in range(40)]
    train = [(i, " ".join(word() for _ in range(20)) + (ref[i % 40][1] if i % 3 == 0 else "")) for i in range(90)] + [(None, ref[0][1]), (7, None), (8, "short")]
    a, b = spark.createDataFrame(train, "k long, text string").repartition(3), spark.createDataFrame(ref, "r long, text string")
    want = {}
    for k, t in train:
        best = min(((-similarity.overlap(t, x, 10), r) for r, x in ref), default=(0, 0))
        if best[0] < 0:
            want[k] = min(want.get(k, best), best)
    for words in (1, 1 << 10):
        found = similarity.grams(b, "r", "text", 10)
        bits = similarity.gram_filter(found, words=words)
        assert len(bits) == words
        held = np.array([r.gram for r in found.collect()]).view(np.uint64)
        assert similarity.may_hold(bits, held).all()
        passed = similarity.may_hold(bits, rng.integers(0, 2**63, 20000, dtype=np.uint64)).mean()
        assert passed > 0.9 if words == 1 else passed < 0.05
    old, similarity.WORDS = similarity.WORDS, 1
    try:
        for size in (1, old):
            similarity.WORDS = size
            got = {r.k: (-r.overlap, r.r) for r in similarity.contamination(a, b, "k", "r").collect()}
            assert got == want
    finally:
        similarity.WORDS = old


def test_fim_reassembles(spark):
    df = spark.createDataFrame([(i, f"abc{i}déf ghi jkl {i}") for i in range(50)] + [(50, "short"), (51, None)], "id int, text string")
    t = fim.Sentinels("<P>", "<S>", "<M>")
    original = {r.id: r.text for r in df.collect()}
    for layout in ("psm", "spm"):
        got = {r.id: r.text for r in df.transform(fim.fim("text", "id", 1.0, layout, tokens=t)).collect()}
        assert got[50] == "short" and got[51] is None
        for i in range(50):
            if layout == "psm":
                p, rest = got[i].removeprefix("<P>").split("<S>")
                s, m = rest.split("<M>")
            else:
                s, rest = got[i].removeprefix("<S>").split("<P>")
                p, m = rest.split("<M>")
            assert p + m + s == original[i]
    assert {r.id: r.text for r in df.transform(fim.fim("text", "id", 0.0)).collect()} == original


def test_contamination(spark):
    train = spark.createDataFrame([(1, "The quick brown fox"), (2, "nothing alike here at all"), (3, None), (4, "short")], "doc_id long, text string")
    ref = spark.createDataFrame([(7, "a quick  BROWN fox jumps"), (8, "quick brown fox jumps")], "item_id long, text string")
    got = similarity.contamination(train, ref, "doc_id", "item_id", n=5).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)]
    assert got[0].overlap == pytest.approx(similarity.overlap("The quick brown fox", "a quick brown fox jumps", 5))
    assert sorted(ids(similarity.decontaminate(train, ref, "doc_id", "item_id", 0.5, n=5), "doc_id")) == [2, 3, 4]
    assert similarity.char_grams("ab c", 3) == {"abc"} and similarity.char_grams("ab", 3) == set()


def test_tensors(items):
    m = tensors.matrix(items.fillna(0.0).orderBy("id"), ["id", "score"])
    assert m.shape == (20, 2) and m.dtype == np.float32 and m[4, 1] == 6.0
    with pytest.raises(InvalidConfig):
        tensors.vector(items, ["score"], "bigint")
    assert items.select(tensors.labels("score").alias("x")).filter("x IS NULL").count() == 0


def test_federated(spark):
    df = spark.range(300).withColumn("node", F.col("id") % 3)
    nodes = df.select(F.col("node").cast("string").alias("node_id")).distinct()
    plan = federated.plan(nodes, federated.Strategy("proportional_iid", 0.8))
    assert sorted(r.seed for r in plan.collect()) == [0, 1, 2]
    parts = federated.execute(df, plan, "node", "id")
    found = federated.manifests(parts, "node", label="_split")
    report = federated.global_report(found)
    assert report["quality_passed"] and report["total_rows"] == 300 and report["effective_train_ratio"] == pytest.approx(0.8)
    assert report["label_distribution"] == {"train": 240, "test": 60}
    stratified = federated.plan(nodes, federated.Strategy("global_stratified", label="node"))
    assert {(r.seed, r.train_ratio, r.stratify_column) for r in stratified.collect()} == {(42, 0.8, "node"), (43, 0.8, "node"), (44, 0.8, "node")}
    with pytest.raises(InvalidConfig):
        federated.Strategy("other")
    with pytest.raises(EmptyDataset):
        federated.plan(nodes.limit(0), federated.Strategy("local_with_seed"))


def test_watermark(spark):
    df = spark.range(2000).select("id", F.sin(F.col("id") * 1.7).alias("x"), F.when(F.col("id") % 10 != 0, F.cos(F.col("id").cast("float")).cast("float")).alias("y"))
    buyer, seller = bytes(range(32)), bytes(range(100, 132))
    marked = watermark.embed(df, buyer, seller, ["x", "y"], "id").cache()
    assert watermark.verify(marked, buyer, seller, "id")
    assert not watermark.verify(df, buyer, seller, "id")
    far = marked.alias("m").join(df.alias("d"), "id").agg(F.max(F.abs(F.col("m.x") - F.col("d.x")))).first()[0]
    assert far < 1e-12
    assert marked.filter("y IS NULL").count() == 200
    found = watermark.detect(marked, "id")
    assert "x" in found["anomalous_columns"] and found["confidence"] > 0.9
    assert "x" not in watermark.detect(df, "id")["anomalous_columns"]
    assert watermark.evidence(df, buyer, "id")["dataset_hash"] == watermark.evidence(df.repartition(5), buyer, "id")["dataset_hash"]


SOURCE = '''
"""Module.

>>> 1 + 1
2
"""

class A:
    def f(self, x: int) -> int:
        """Do.

        >>> A().f(
        ...     2)
        4

        >>> A().f("x")
        Traceback (most recent call last):
        TypeError: bad
        The text goes on here.
        """
'''


def test_doctests(spark, tmp_path):
    got = doctests.parse(SOURCE, "m")
    assert [(x[1], x[2], x[3]) for x in got] == [("__module__", ">>> 1 + 1", "2"), ("A.f", ">>> A().f(\n...     2)", "4"), ("A.f", '>>> A().f("x")', "Traceback (most recent call last):\nTypeError: bad")]
    assert got[1][4].startswith("def f(self, x: int)")
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "mod.py").write_text(SOURCE)
    (tmp_path / "pkg" / "__init__.py").write_text('"""\n>>> 0\n0\n"""\n')
    df = doctests.from_directory(spark, str(tmp_path), "s", "1")
    assert {(r.module, r.source) for r in df.collect()} == {("pkg.mod", "s"), ("pkg", "s")} and df.count() == 4


@given(st.text())
def test_prose_never_fails(line):
    assert doctests.is_prose(line) in (True, False)
    assert not doctests.is_prose(">>> " + line)
