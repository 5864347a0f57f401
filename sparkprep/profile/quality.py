"""Column profiles, quality issues, scores and checklists."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.core import materialize, need, rereadable
from sparkprep.errors import ColumnNotFound, InvalidConfig
from sparkprep.operators.rows import duplicate_rows

BINS = 4096
_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"


# ------------------------------------------------------------------ profiles
def column_profile(df: DataFrame) -> DataFrame:
    """Per column: total_count, null_count, null_ratio, unique_count, unique_ratio, duplicate_count, duplicate_ratio.

    Values of all columns are counted together in long form, so skew in one of them is pre-aggregated away."""
    return _profile(df).drop("last")


def _profile(df: DataFrame) -> DataFrame:
    """column_profile() and the last value of each column, as text."""
    counts = value_counts(df)
    rows = counts.groupBy("column").agg(F.max("value").alias("last"), F.sum("n").alias("total_count"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"), F.count("value").alias("unique_count"))
    full = F.col("total_count") - F.col("null_count")
    share = lambda x, y: F.when(y > 0, x / F.when(y > 0, y)).otherwise(0.0)
    return rows.select("column", "total_count", "null_count", share(F.col("null_count"), F.col("total_count")).alias("null_ratio"), "unique_count", share(F.col("unique_count"), full).alias("unique_ratio"), (full - F.col("unique_count")).alias("duplicate_count"), share(full - F.col("unique_count"), full).alias("duplicate_ratio"), "last")


def _cell(name: str, kind: T.DataType) -> Column:
    c = F.col(name)
    return F.to_json(F.struct(c.alias("v"))) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value as text, n) of all columns."""
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.when(F.col(f.name).isNotNull(), _cell(f.name, f.dataType)).alias("value")) for f in df.schema])
    return df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.value").agg(F.count("*").alias("n"))


def select_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Callable[[int], int]], n: str | None = None, known: dict | None = None) -> dict:
    """{group: {name: value}}: per group, the values at 0-based places of its sorted values, exactly; nothing is sorted.

    Each pass counts the values of the ranges that are still open in BINS equal parts, all groups and ranks at once, and keeps for each rank the
    part that holds it, with the least and the largest value there. A rank is found when these are one. Parts keep the order of values
    and shrink by BINS each time, so some six passes tell any two doubles apart; a million evenly spread values take two.
    n: how often a row counts. known: {group: (total, least, largest)} spares the first pass."""
    spark, v, weight = rows.sparkSession, F.col(value).cast("double"), F.col(n) if n else F.lit(1)
    if known is None:
        known = {r[0]: (r[1], r[2], r[3]) for r in rows.groupBy(group).agg(F.sum(weight), F.min(v), F.max(v)).collect()}  # one row a group
    out: dict = {g: {} for g in known}
    open_ = {(g, name): (rank(total), low, high) for g, (total, low, high) in known.items() for name, rank in ranks.items()}
    kind = rows.schema[group].dataType.simpleString()
    while open_:
        for (g, name), (_, low, high) in list(open_.items()):
            if low == high:
                out[g][name] = low
                del open_[g, name]
        if not open_:
            break
        ids: dict = {}
        asked = [(ids.setdefault((g, low, high), len(ids)), name, rank) for (g, name), (rank, low, high) in open_.items()]
        ranges = spark.createDataFrame([(i, g, low, high) for (g, low, high), i in ids.items()], f"_id int, _g {kind}, _low double, _high double")
        # Halves, where the width itself would overflow.
        part = F.when(F.col("_high") - F.col("_low") < float("inf"), (v - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise((v / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2))
        inside = rows.join(F.broadcast(ranges), F.col(group).eqNullSafe(F.col("_g")) & v.between(F.col("_low"), F.col("_high")))
        parts = inside.groupBy("_id", F.least(F.floor(part * BINS), F.lit(BINS - 1)).alias("_bin")).agg(F.sum(weight).alias("_n"), F.min(v).alias("_least"), F.max(v).alias("_most"))
        before = Window.partitionBy("_id").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
        parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        found = parts.join(F.broadcast(spark.createDataFrame(asked, "_id int, name string, rank long")), "_id").filter("_before <= rank AND rank < _before + _n").collect()
        back = {i: g for (g, _, _), i in ids.items()}
        open_ = {(back[r["_id"]], r["name"]): (r["rank"] - r["_before"], r["_least"], r["_most"]) for r in found}  # one row a rank
    return out


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column (also of text that holds numbers): count, min, max, mean, population deviation, quartiles by
    rank, fences at 1.5 interquartile ranges and the number of outliers. Columns with fewer than 4 finite values are left out.

    It runs jobs: the columns are read once for the moments, two or three times for the ranks, and once for the outliers; what isn't a plain scan is written
    first."""
    names = list(columns) if columns is not None else [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))]
    need(df, *names)
    number = lambda f: F.col(f.name).cast("double") if isinstance(f.dataType, T.NumericType) else F.when(F.col(f.name).rlike(_NUMBER), F.col(f.name).try_cast("double"))
    own = [f for f in df.schema if f.name in names]
    narrow = rereadable(df.select(*[number(f).alias(f"v{i}") for i, f in enumerate(own)]))
    fit = lambda i: F.when(~F.isnan(f"v{i}") & (F.abs(f"v{i}") < F.lit(float("inf"))), F.col(f"v{i}"))
    moments = narrow.agg(F.lit(0), *[f(fit(i)) for i in range(len(own)) for f in (F.count, F.min, F.max, F.avg, F.stddev_pop)]).first()
    base = {i: moments[5 * i + 1 : 5 * i + 6] for i in range(len(own))}
    base = {i: x for i, x in base.items() if x[0] >= 4}
    rows = []
    if base:
        long = narrow.select(F.explode(F.array(*[F.struct(F.lit(i).alias("column"), fit(i).alias("value")) for i in base])).alias("c")).select("c.column", "c.value").filter("value IS NOT NULL")
        ranks = select_ranks(long, "column", "value", {f"q{k}": lambda total, k=k: total * k // 4 for k in (1, 2, 3)}, known={i: x[:3] for i, x in base.items()})
        fences = {i: (r["q1"] - 1.5 * (r["q3"] - r["q1"]), r["q3"] + 1.5 * (r["q3"] - r["q1"])) for i, r in ranks.items()}
        out = narrow.agg(*[F.count_if((fit(i) < low) | (fit(i) > high)) for i, (low, high) in fences.items()]).first()
        rows = [(own[i].name, *base[i], ranks[i]["q1"], ranks[i]["q2"], ranks[i]["q3"], *fences[i], n) for i, n in zip(fences, out, strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, count long, min double, max double, mean double, std_dev double, q1 double, median double, q3 double, lower double, upper double, outlier_count long")


def text_stats(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """One row: byte lengths min, max, mean, p50, p95, p99; blank texts, texts with a prefix, all texts that are not null."""
    need(df, column)
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise InvalidConfig(f"column {column!r} is not a string")
    t = F.col(column)
    head = t.startswith(prefix) if prefix is not None else F.lit(False)
    counts = df.filter(t.isNotNull()).groupBy(F.lit(0).alias("g"), F.octet_length(t).cast("long").alias("len")).agg(F.count("*").alias("n"), F.count_if(F.length(F.regexp_replace(t, r"(?U)\s", "")) == 0).alias("empty"), F.count_if(head).alias("preamble"))
    counts = materialize(counts)
    places = {"p50_len": lambda total: total // 2, "p95_len": lambda total: math.floor(total * 0.95), "p99_len": lambda total: math.floor(min(total * 0.99, total - 1))}
    ranks = select_ranks(counts, "g", "len", places, "n").get(0, {})
    zero = lambda e: F.coalesce(e, F.lit(0)).cast("long")
    base = counts.agg(zero(F.min("len")).alias("min_len"), zero(F.max("len")).alias("max_len"), F.coalesce(F.sum(F.col("len") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("mean_len"), zero(F.sum("empty")).alias("empty_count"), zero(F.sum("preamble")).alias("preamble_count"), zero(F.sum("n")).alias("total"))
    return base.select("min_len", "max_len", "mean_len", *(F.lit(int(ranks.get(c, 0))).cast("long").alias(c) for c in places), "empty_count", "preamble_count", "total")


# ------------------------------------------------------------------ issues
@dataclass(frozen=True)
class Thresholds:
    max_null_ratio: float = 0.1
    max_duplicate_ratio: float = 0.5
    min_cardinality: int = 2
    max_outlier_ratio: float = 0.05
    max_duplicate_row_ratio: float = 0.01


@dataclass(frozen=True)
class Issue:
    kind: str
    column: str | None = None
    value: float | str | None = None
    count: int | None = None

    @property
    def severity(self) -> int:
        # How bad each kind of issue is, 5 worst.
        fixed = {"empty_schema": 5, "empty_dataset": 5, "constant_column": 4, "high_duplicate_ratio": 2, "duplicate_rows": 2, "low_cardinality": 1}
        if self.kind == "high_null_ratio":
            return 4 if self.value > 0.5 else 3
        if self.kind == "outliers_detected":
            return 3 if self.value > 0.1 else 2
        return fixed[self.kind]


#: Points lost by severity.
PENALTY = {5: 25.0, 4: 15.0, 3: 10.0, 2: 5.0, 1: 2.0}


@dataclass
class QualityReport:
    row_count: int
    column_count: int
    columns: dict[str, dict] = field(default_factory=dict)
    issues: list[Issue] = field(default_factory=list)
    score: float = 0.0
    duplicate_row_count: int = 0

    def has_issues(self) -> bool:
        return bool(self.issues)

    def column_issues(self, name: str) -> list[Issue]:
        return [i for i in self.issues if i.column == name]

    def max_severity(self) -> int:
        return max((i.severity for i in self.issues), default=0)

    def problematic_columns(self) -> list[str]:
        return sorted({i.column for i in self.issues if i.column})


def check(df: DataFrame, thresholds: Thresholds | None = None, check_duplicates: bool = True, with_outliers: bool = True) -> QualityReport:
    """Profile a table and derive its issues and score (100 - 30 * mean null ratio - penalties, within 0 and 100)."""
    t = thresholds or Thresholds()
    if not df.columns:
        return QualityReport(0, 0, issues=[Issue("empty_schema")])
    profile = {r["column"]: r.asDict() for r in _profile(df).collect()}  # one row per column
    last = {c: p.pop("last") for c, p in profile.items()}
    rows = max((p["total_count"] for p in profile.values()), default=0)
    report = QualityReport(rows, len(df.columns))
    if not rows:
        report.issues.append(Issue("empty_dataset"))
        return report
    stats = {r["column"]: r.asDict() for r in numeric_stats(df).collect()} if with_outliers else {}
    for name in df.columns:
        p = report.columns[name] = profile[name] | {"numeric": stats.get(name)}
        if p["null_ratio"] > t.max_null_ratio:
            report.issues.append(Issue("high_null_ratio", name, p["null_ratio"]))
        if p["duplicate_ratio"] > t.max_duplicate_ratio:
            report.issues.append(Issue("high_duplicate_ratio", name, p["duplicate_ratio"]))
        if p["unique_count"] < t.min_cardinality and rows > 1:
            report.issues.append(Issue("low_cardinality", name, count=p["unique_count"]))
        if p["unique_count"] <= 1:
            report.issues.append(Issue("constant_column", name, last[name] or ""))
        if p["numeric"] and p["numeric"]["outlier_count"] / rows > t.max_outlier_ratio:
            report.issues.append(Issue("outliers_detected", name, p["numeric"]["outlier_count"] / rows, p["numeric"]["outlier_count"]))
    if check_duplicates:
        report.duplicate_row_count = int(duplicate_rows(df).first()["duplicate_rows"])
        if report.duplicate_row_count / rows > t.max_duplicate_row_ratio:
            report.issues.append(Issue("duplicate_rows", value=report.duplicate_row_count / rows, count=report.duplicate_row_count))
    report.score = score(report)
    return report


def score(report: QualityReport) -> float:
    if not report.row_count or not report.columns:
        return 0.0
    nulls = sum(p["null_ratio"] for p in report.columns.values()) / len(report.columns)
    return min(100.0, max(0.0, 100.0 - 30.0 * nulls - sum(PENALTY[i.severity] for i in report.issues)))


# ------------------------------------------------------------------ checklists
@dataclass(frozen=True)
class Profile:
    """Named thresholds, with columns that may be constant or null."""

    name: str
    description: str
    thresholds: Thresholds = Thresholds()
    expected_constants: frozenset[str] = frozenset()
    nullable: frozenset[str] = frozenset()


# The named profiles.
PROFILES = {
    "default": Profile("default", "General tables"),
    "doctest-corpus": Profile("doctest-corpus", "Extracted documentation examples", Thresholds(max_null_ratio=0.05, max_duplicate_ratio=0.3, max_duplicate_row_ratio=0.0), frozenset({"source", "version"}), frozenset({"signature"})),
    "ml-training": Profile("ml-training", "Training tables", Thresholds(max_null_ratio=0.0, max_duplicate_ratio=0.8, max_outlier_ratio=0.1)),
    "time-series": Profile("time-series", "Measurements over time", Thresholds(max_null_ratio=0.05, max_outlier_ratio=0.1, max_duplicate_row_ratio=0.0)),
}


def profile_by_name(name: str) -> Profile:
    if name not in PROFILES:
        raise InvalidConfig(f"no profile {name!r}; there are {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


#: What a check of each severity weighs.
WEIGHTS = {"critical": 2.0, "high": 1.5, "medium": 1.0, "low": 0.5}
#: The least score of each grade, and what it means for publishing.
GRADES = (("A", 95.0, "Publish immediately"), ("B", 85.0, "Publish with documented caveats"), ("C", 70.0, "Remediation required before publication"), ("D", 50.0, "Major rework needed"), ("F", 0.0, "Do not publish"))


@dataclass(frozen=True)
class Check:
    id: int
    text: str
    severity: str
    passed: bool
    suggestion: str | None = None


@dataclass(frozen=True)
class Scorecard:
    score: float
    grade: str
    decision: str
    checks: tuple[Check, ...]

    @property
    def publishable(self) -> bool:
        return self.grade in ("A", "B")

    def failed(self, severity: str | None = None) -> list[Check]:
        return [c for c in self.checks if not c.passed and severity in (None, c.severity)]

    def badge_url(self) -> str:
        colour = {"A": "brightgreen", "B": "green", "C": "yellow", "D": "orange", "F": "red"}[self.grade]
        return f"https://img.shields.io/badge/data_quality-{self.grade}_({self.score:.0f}%25)-{colour}"

    def to_json(self) -> str:
        return json.dumps({"score": self.score, "grade": self.grade, "decision": self.decision, "publishable": self.publishable, "checks": [vars(c) for c in self.checks]})


def grade(value: float) -> tuple[str, str]:
    return next((g, d) for g, least, d in GRADES if value >= least)


def grade_column(value: Column) -> Column:
    out = F.lit("F")
    for g, least, _ in reversed(GRADES[:-1]):
        out = F.when(value >= least, g).otherwise(out)
    return out


def scorecard(checks: Sequence[Check]) -> Scorecard:
    """100 * earned / possible over the checks' weights; no checks earn 100."""
    most = sum(WEIGHTS[c.severity] for c in checks)
    value = 100.0 * sum(WEIGHTS[c.severity] for c in checks if c.passed) / most if most else 100.0
    return Scorecard(value, *grade(value), tuple(checks))


def checklist(report: QualityReport, profile: Profile | None = None) -> list[Check]:
    """Twelve checks of a report; the profile's constants and nullable columns count as expected."""
    p = profile or PROFILES["default"]
    constants = [i.column for i in report.issues if i.kind == "constant_column" and i.column not in p.expected_constants | p.nullable]
    nulls = lambda least: [c for c, x in report.columns.items() if x["null_ratio"] > least and c not in p.nullable]
    repeated = report.duplicate_row_count / report.row_count if report.row_count else 0.0
    outliers = [c for c, x in report.columns.items() if x.get("numeric") and x["numeric"]["outlier_count"] > 0.1 * report.row_count]
    few = [c for c, x in report.columns.items() if x["unique_count"] <= 10 and c not in p.expected_constants]
    # The limits of the checks.
    items = [
        ("there are rows", "critical", report.row_count > 0, "load some data"),
        ("there are columns", "critical", report.column_count > 0, "define a schema"),
        ("no unexpected constant columns", "critical", not constants, f"drop or inspect {', '.join(constants)}"),
        (f"at most 5 % repeated rows (now {100 * repeated:.1f} %)", "high", repeated <= 0.05, "remove repeated rows"),
        ("no column is null in more than half of the rows", "high", not nulls(0.5), f"inspect {', '.join(nulls(0.5))}"),
        (f"100 rows or more (now {report.row_count})", "high", report.row_count >= 100, "collect more rows"),
        (f"a quality score of 70 or more (now {report.score:.1f})", "medium", report.score >= 70, "resolve the issues found"),
        ("no column is null in more than a tenth of the rows", "medium", not nulls(0.1), f"fill {', '.join(nulls(0.1))}"),
        (f"two columns or more (now {report.column_count})", "medium", report.column_count >= 2, "add columns"),
        ("no column has more than a tenth of outliers", "medium", not outliers, f"inspect {', '.join(outliers)}"),
        ("no issues at all", "low", not report.issues, "resolve the issues found"),
        ("every column has more than ten values", "low", not few, f"inspect {', '.join(few)}"),
    ]
    return [Check(i + 1, text, severity, ok, None if ok else hint) for i, (text, severity, ok, hint) in enumerate(items)]


def basic_checklist(report: QualityReport) -> list[Check]:
    """Five checks, for a quick look."""
    kinds = {i.kind for i in report.issues}
    items = [("the table has rows", "critical", report.row_count > 0), ("the table has columns", "critical", report.column_count > 0), ("no high null ratios", "high", "high_null_ratio" not in kinds), ("no duplicate rows beyond the threshold", "medium", "duplicate_rows" not in kinds), ("no constant columns", "medium", "constant_column" not in kinds)]
    return [Check(i + 1, text, severity, ok) for i, (text, severity, ok) in enumerate(items)]


def require_column(report: QualityReport, name: str) -> dict:
    if name not in report.columns:
        raise ColumnNotFound(name, list(report.columns))
    return report.columns[name]
