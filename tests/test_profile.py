import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.errors import EmptyDataset, InvalidConfig, SchemaMismatch
from sparkprep.functions import text as tx
from sparkprep.profile import drift, imbalance, quality, sketches


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, None if i % 10 == 0 else f"n{i % 30}", None if i % 15 == 0 else 999.0 if i % 50 == 0 else float(i % 20), "abc"[i % 3], "k") for i in range(1, 201)]
    return spark.createDataFrame(rows, "id int, name string, score double, category string, fixed string").cache()


def test_profile_and_issues(messy):
    p = {r["column"]: r for r in quality.column_profile(messy).collect()}
    assert p["name"].null_count == 20 and p["name"].null_ratio == 0.1 and p["id"].unique_ratio == 1.0
    assert p["category"].unique_count == 3 and p["category"].duplicate_count == 197
    r = quality.check(messy)
    kinds = {(i.kind, i.column) for i in r.issues}
    assert ("constant_column", "fixed") in kinds and ("high_duplicate_ratio", "category") in kinds and ("low_cardinality", "fixed") in kinds
    assert r.max_severity() == 4 and "fixed" in r.problematic_columns() and r.has_issues()
    assert next(i for i in r.issues if i.kind == "constant_column").value == "k"
    lost = sum(quality.PENALTY[i.severity] for i in r.issues) + 30 * sum(x["null_ratio"] for x in r.columns.values()) / 5
    assert r.score == pytest.approx(max(0, 100 - lost))


def test_numeric_stats(messy):
    s = {r["column"]: r for r in quality.numeric_stats(messy, ["score"]).collect()}["score"]
    v = np.sort([r.score for r in messy.collect() if r.score is not None])
    n = len(v)
    assert (s.q1, s.median, s.q3) == (v[n // 4], v[n // 2], v[3 * n // 4])
    assert s.std_dev == pytest.approx(v.std()) and s.mean == pytest.approx(v.mean())
    assert s.outlier_count == ((v < s.lower) | (v > s.upper)).sum() > 0


def test_numeric_strings(spark):
    df = spark.createDataFrame([(x,) for x in ("1", "2.5", "-3e2", "x", "1d", None, "7")], "v string")
    s = quality.numeric_stats(df).first()
    assert s["count"] == 4 and s["min"] == -300.0


def test_empty_tables(spark, messy):
    r = quality.check(messy.limit(0))
    assert r.score == 0 and [i.kind for i in r.issues] == ["empty_dataset"]
    assert quality.text_stats(messy.limit(0), "name").first().total == 0
    with pytest.raises(EmptyDataset):
        imbalance.analyze(messy.limit(0), "category")


def test_text_stats(spark):
    texts = ["", " \t", "#!/bin", "é" * 10] + ["x" * i for i in range(1, 97)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    s = quality.text_stats(df, "t", "#!/").first()
    n = sorted(len(t.encode()) for t in texts if t is not None)
    assert (s.min_len, s.max_len, s.p50_len, s.p95_len, s.p99_len) == (n[0], n[-1], n[50], n[95], n[99])
    assert (s.empty_count, s.preamble_count, s.total) == (2, 1, 100) and s.mean_len == pytest.approx(np.mean(n))
    with pytest.raises(InvalidConfig):
        quality.text_stats(df.select(F.lit(1).alias("t")), "t")


def test_checklists(messy):
    r = quality.check(messy)
    card = quality.scorecard(quality.checklist(r))
    assert len(card.checks) == 12 and card.failed("critical") and 0 < card.score < 100
    assert quality.scorecard([]).grade == "A" and quality.grade(84.9)[0] == "C" and not quality.scorecard([quality.Check(1, "x", "low", False)]).publishable
    expected = quality.Profile("p", "", expected_constants=frozenset({"fixed"}))
    assert not quality.scorecard(quality.checklist(r, expected)).failed("critical")
    assert "data_quality" in card.badge_url() and '"grade"' in card.to_json()
    assert len(quality.basic_checklist(r)) == 5
    with pytest.raises(InvalidConfig):
        quality.profile_by_name("none")


def test_imbalance(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10 + [(None,)] * 5, "c string")
    r = imbalance.analyze(df, "c")
    assert r.counts == {"a": 90, "b": 10} and (r.majority, r.minority) == ("a", "b")
    assert r.ratio == 9 and r.severity == "Moderate" and r.is_imbalanced
    assert r.entropy == pytest.approx(-(0.9 * math.log(0.9) + 0.1 * math.log(0.1))) and r.gini == pytest.approx(0.18)
    assert "consider_oversampling" in r.recommendations() and r.proportion("b") == 0.1
    with pytest.raises(InvalidConfig):
        imbalance.analyze(df.select(F.lit(1.5).alias("c")), "c")


def test_text_scores(spark):
    cases = ["", "abc", "a\na\na\na\n", "x" * 300, "!!!! ????", "Hello world, this is a line.\nAnother line of text.\r\n", "aaaa"]
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "t string")
    t = F.col("t")
    got = df.select(tx.alnum_ratio_score(t), tx.line_length_score(t), tx.duplicate_lines_score(t), tx.entropy_score(t), tx.byte_entropy(t)).collect()
    assert tuple(got[0]) == (0.0, 0.0, 1.0, 0.0, 0.0)
    assert got[2][2] == 0.2 and got[3][1] == 0.5 and got[4][0] == 0.0 and got[5][2] == 1.0
    assert got[6][4] == 0.0 and got[6][3] == 0.2 and got[7][4] is None
    assert tx.filter_text(df, min_score=0.0).count() == len(cases)
    assert tx.find_text_column(spark.createDataFrame([("a", "b")], "x string, content string")) == "content"


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.range(1000).select((30 + F.col("id") % 40).cast("double").alias("age"), (50000.0 + F.col("id") * 50).alias("income"), F.lit("x").alias("c"))
    b = spark.range(1000).select((45 + F.col("id") % 30).cast("double").alias("age"), (50000.0 + F.col("id") * 50).alias("income"), F.lit("x").alias("c"))
    return a, b


def test_drift(sides):
    r = drift.report(*sides, tests=list(drift.TESTS))
    got = {(x["column"], x["test"]): x for x in r.rows}
    assert len(got) == 8 and r.drifted_columns == ["age"] and r.max_severity == "Critical" and r.has_drift()
    a, b = (np.array([x.age for x in s.collect()]) for s in sides)
    grid = np.unique(np.concatenate([a, b]))
    d = max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)
    assert got["age", "ks"]["statistic"] == pytest.approx(d) and got["age", "ks"]["p_value"] == 0.0
    assert got["income", "ks"]["p_value"] == 1.0 and got["income", "psi"]["statistic"] == pytest.approx(0)
    edges = np.linspace(min(grid), max(grid), 11)
    h = [np.histogram(x, edges)[0] for x in (a, b)]
    p, q = ((x + 0.5) / (1000 + 5) for x in h)
    assert got["age", "psi"]["statistic"] == pytest.approx(((q - p) * np.log(q / p)).sum())
    with pytest.raises(SchemaMismatch):
        drift.detect(sides[0], sides[1].drop("c"))
    with pytest.raises(InvalidConfig):
        drift.detect(*sides, tests=["x"])
    with pytest.raises(EmptyDataset):
        drift.detect(sides[0], sides[1].limit(0))


def test_p_values(spark):
    z = [-1.0, 0.5, 1.0, 1.36, 2.9, 3.5]
    df = spark.createDataFrame([(x,) for x in z], "z double")
    got = [r[0] for r in df.select(drift.ks_p_value(F.col("z"))).collect()]
    want = [1.0, *[2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)) for x in z[1:5]], 0.0]
    assert got == pytest.approx(want, abs=1e-9)
    erf = [r[0] for r in df.select(drift.erf(F.col("z"))).collect()]
    assert erf == pytest.approx([math.erf(x) for x in z], abs=2e-7)


def test_ddsketch(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(1, 2, 3000), -rng.lognormal(0, 1, 1000), np.zeros(100)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    sk = sketches.ddsketch(df)
    q = [0.0, 0.01, 0.2, 0.5, 0.9, 0.99, 1.0]
    got = {r.q: r.value for r in sketches.dd_quantiles(sk, q).collect()}
    s = np.sort(x)
    for p in q[1:-1]:
        assert got[p] == pytest.approx(s[math.ceil(p * len(s)) - 1], rel=0.0101, abs=1e-12)
    assert got[0.0] == s[0] and got[1.0] == s[-1]
    parts = [sketches.ddsketch(df.filter(c)) for c in ("v < 1 OR v IS NULL", "v >= 1")]
    merged = sketches.merge_ddsketches(*parts)
    key = ["column", "sign", "bucket", "n"]
    assert sorted(map(tuple, merged.select(key).collect())) == sorted(map(tuple, sk.select(key).filter("n > 0").collect()))
    with pytest.raises(InvalidConfig):
        sketches.merge_ddsketches(sk, sketches.ddsketch(df, alpha=0.05))


def test_tdigest(spark):
    x = np.random.default_rng(1).normal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(5)
    d = sketches.tdigest(df)
    got = {r.q: r.value for r in sketches.td_quantiles(d, [0.01, 0.5, 0.99]).collect()}
    for q, v in got.items():
        assert abs((x <= v).mean() - q) < 0.01
    two = sketches.merge_tdigests(d.unionByName(d))
    assert sum(two.first().weights) == pytest.approx(10000)


def test_sketch_compare(spark):
    a = spark.createDataFrame([("x", q, 10.0) for q in sketches.steps()], "column string, q double, value double")
    same = sketches.compare(a, a).first()
    assert same.statistic == 0 and same.severity == "None"
    assert sketches.compare(a, a.withColumn("value", F.lit(13.0))).first().severity == "Medium"


def test_ranks_are_those_of_sorted_values(spark):
    """Values that equal parts separate badly: huge and tiny ones, long tails, repeats, one value, and groups of few."""
    rng = np.random.default_rng(8)
    groups = {
        "even": rng.random(3000), "tail": np.exp(rng.normal(0, 200, 500)), "huge": np.array([-1.7e308, 1.7e308, 1e308, -1.0, 0.0, 5e-324, 1e-323, 1.5e-323] * 3), "same": np.full(9, 2.5),
        "near": np.array([1.0, np.nextafter(1, 2), np.nextafter(1, 0), 1e300]), "one": np.array([7.0]), "zeros": np.array([0.0, -0.0, 0.0, -0.0, 1.0]), None: rng.integers(0, 5, 100).astype(float),
    }
    rows = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "g string, v double").repartition(5)
    ranks = {"first": lambda n: 0, "third": lambda n: n // 3, "median": lambda n: n // 2, "last": lambda n: n - 1}
    want = {g: {k: sorted(v.tolist())[f(len(v))] for k, f in ranks.items()} for g, v in groups.items()}
    assert quality.select_ranks(rows, "g", "v", ranks) == want
    weighted = rows.groupBy("g", "v").agg(F.count("*").alias("n"))
    assert quality.select_ranks(weighted, "g", "v", ranks, "n") == want
    assert quality.select_ranks(rows.limit(0), "g", "v", ranks) == {}


def test_numeric_stats_of_plans(spark):
    """A shuffled input is run once; columns of text and of few values are told apart."""
    ran = spark.sparkContext.accumulator(0)
    source = spark.range(100).selectExpr("id", "string(id / 4) AS t", "IF(id < 3, id, null) AS few", "IF(id = 50, double('NaN'), id) AS n", "'x' AS word").repartition(3)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    df = source.mapInArrow(count, source.schema)
    got = {r["column"]: r for r in quality.numeric_stats(df).collect()}
    assert ran.value == 100 and sorted(got) == ["id", "n", "t"]
    assert (got["id"].q1, got["id"].median, got["id"].q3, got["id"]["count"], got["id"].outlier_count) == (25, 50, 75, 100, 0)
    assert (got["t"].max, got["n"]["count"], got["n"].median) == (24.75, 99, 49)
    assert quality.numeric_stats(source.select("word")).count() == 0 and quality.numeric_stats(source.limit(0)).count() == 0
