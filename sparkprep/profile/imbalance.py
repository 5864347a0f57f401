"""Class imbalance: distribution, measures, severity and advice."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.core import need
from sparkprep.errors import EmptyDataset, InvalidConfig

# Majority to minority ratios below which a severity holds.
SEVERITIES = (("None", 1.5), ("Low", 3.0), ("Moderate", 10.0), ("Severe", 100.0), ("Extreme", math.inf))


def severity(ratio: float) -> str:
    return next((s for s, below in SEVERITIES if ratio < below), "Extreme")


def severity_column(ratio: Column) -> Column:
    out = F.lit("Extreme")
    for s, below in reversed(SEVERITIES[:-1]):
        out = F.when(ratio < below, s).otherwise(out)
    return out


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(class, n); null labels are left out."""
    need(df, label)
    if not isinstance(df.schema[label].dataType, (T.StringType, T.IntegralType)):
        raise InvalidConfig(f"labels in {label!r} must be strings or integers")
    return df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class")).agg(F.count("*").alias("n"))


def metrics(df: DataFrame, label: str) -> DataFrame:
    """One row: total, num_classes, majority, minority (ties to the smaller name), ratio, entropy, normalized_entropy, gini, severity."""
    c = class_counts(df, label)
    n = F.col("n").cast("double")
    # With S = sum n: entropy = ln S - sum(n ln n) / S, so one pre-aggregated pass is enough.
    one = c.agg(F.sum("n").alias("total"), F.count("*").alias("num_classes"), F.max("n").alias("_max"), F.min("n").alias("_min"), F.min_by("class", F.struct("n", "class")).alias("minority"), F.min_by("class", F.struct(-F.col("n"), F.col("class"))).alias("majority"), F.sum(n * F.ln(n)).alias("_nln"), F.sum(n * n).alias("_sq"))
    total = F.col("total").cast("double")
    entropy = F.ln(total) - F.col("_nln") / total
    return one.select("total", "num_classes", "majority", "minority", (F.col("_max") / F.col("_min")).alias("ratio"), entropy.alias("entropy"), F.when(F.col("num_classes") > 1, entropy / F.ln(F.col("num_classes").cast("double"))).otherwise(1.0).alias("normalized_entropy"), (1 - F.col("_sq") / (total * total)).alias("gini")).withColumn("severity", severity_column(F.col("ratio")))


# Advice for each severity.
ADVICE = {
    "None": ["no_action"],
    "Low": ["use_stratified_split", "use_appropriate_metrics"],
    "Moderate": ["use_stratified_split", "use_class_weights", "use_appropriate_metrics"],
    "Severe": ["use_stratified_split", "use_class_weights", "consider_smote", "use_appropriate_metrics", "collect_more_data"],
    "Extreme": ["consider_anomaly_detection", "use_stratified_split", "consider_smote", "collect_more_data", "use_appropriate_metrics"],
}


@dataclass(frozen=True)
class ImbalanceReport:
    column: str
    counts: dict[str, int]
    majority: str
    minority: str
    ratio: float
    entropy: float
    normalized_entropy: float
    gini: float
    severity: str

    @property
    def is_imbalanced(self) -> bool:
        return self.severity != "None"

    def proportion(self, name: str) -> float:
        return self.counts.get(name, 0) / sum(self.counts.values())

    def recommendations(self) -> list[str]:
        out = list(ADVICE[self.severity])
        if self.severity == "Moderate":
            out.append("consider_oversampling" if sum(self.counts.values()) < 10_000 else "consider_undersampling")
        return out


def analyze(df: DataFrame, label: str) -> ImbalanceReport:
    counts = {r["class"]: r["n"] for r in class_counts(df, label).collect()}  # one row per class
    if not counts:
        raise EmptyDataset(f"no labels in {label!r}")
    m = metrics(df, label).first()
    return ImbalanceReport(label, counts, m.majority, m.minority, m.ratio, m.entropy, m.normalized_entropy, m.gini, m.severity)
