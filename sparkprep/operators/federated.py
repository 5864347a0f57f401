"""Splits over nodes that share only counts: manifests, a plan of instructions, and a global report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.core import running_totals, seeded
from sparkprep.errors import EmptyDataset, InvalidConfig

STRATEGIES = ("local_with_seed", "global_stratified", "proportional_iid")
# Least rows of a part, largest deviation of a node's train share, and what stratified plans use.
MIN_SAMPLES, MAX_DEVIATION = 10, 0.1
STRATIFIED_SEED, STRATIFIED_TRAIN = 42, 0.8


@dataclass(frozen=True)
class Strategy:
    name: str
    train_ratio: float = 0.8
    seed: int = 42
    label: str | None = None

    def __post_init__(self):
        if self.name not in STRATEGIES:
            raise InvalidConfig(f"strategy is one of {', '.join(STRATEGIES)}")
        if self.name == "global_stratified" and not self.label:
            raise InvalidConfig("a stratified plan needs a label")


def manifests(df: DataFrame, node: str, split: str = "_split", label: str | None = None) -> DataFrame:
    """Per node: total_rows, train_rows, test_rows, validation_rows and, with a label, its counts (map)."""
    n = lambda name: F.count_if(F.col(split) == name).alias(f"{name}_rows")
    rows = df.groupBy(F.col(node).cast("string").alias("node_id")).agg(F.count("*").alias("total_rows"), n("train"), n("test"), n("validation"))
    if label is None:
        return rows
    counts = df.filter(F.col(label).isNotNull()).groupBy(F.col(node).cast("string").alias("node_id"), F.col(label).cast("string").alias("_l")).count()
    maps = counts.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("_l", "count"))).alias("label_distribution"))
    return rows.join(maps, "node_id", "left")


def plan(nodes: DataFrame, strategy: Strategy) -> DataFrame:
    """Instructions (node_id, seed, train_ratio, test_ratio, stratify_column), numbering nodes by their id."""
    if nodes.isEmpty():
        raise EmptyDataset("no manifests")
    at = F.row_number().over(Window.orderBy("node_id")) - 1  # one row per node
    rows = nodes.select("node_id").withColumn("_i", at)
    train = STRATIFIED_TRAIN if strategy.name == "global_stratified" else strategy.train_ratio
    seed = {"local_with_seed": F.lit(strategy.seed), "global_stratified": F.col("_i") + STRATIFIED_SEED, "proportional_iid": F.col("_i")}[strategy.name]
    label = strategy.label if strategy.name == "global_stratified" else None
    return rows.select("node_id", seed.cast("long").alias("seed"), F.lit(train).alias("train_ratio"), F.lit(1 - train).alias("test_ratio"), F.lit(label).cast("string").alias("stratify_column"))


def execute(df: DataFrame, instructions: DataFrame, node: str, key: str) -> DataFrame:
    """df with _split: all nodes in one job. Within a node, or a node's class, the seeded order is cut at the rounded train share."""
    label = instructions.select("stratify_column").filter("stratify_column IS NOT NULL").distinct().head(2)
    group = [F.col(node).cast("string"), F.col(label[0][0]).cast("string") if label else F.lit("")]
    rows = df.join(F.broadcast(instructions), F.col(node).cast("string") == F.col("node_id")) if instructions.count() <= 100_000 else df.join(instructions, F.col(node).cast("string") == F.col("node_id"))
    rows = rows.withColumn("_group", F.concat_ws("\x1f", *group)).withColumn("_by", F.struct(seeded(F.col("seed"), key).alias("h"), F.col(key))).withColumn("_one", F.lit(1).cast("long"))
    sizes = rows.groupBy(F.col("_group").alias("_g")).agg(F.count("*").alias("_n"))
    placed = running_totals(rows, "_group", "_by", {"_upto": "_one"}).join(sizes, F.col("_group") == F.col("_g"))
    cut = F.greatest(F.floor(F.col("_n") * F.col("train_ratio") + 0.5), F.lit(1))
    return placed.withColumn("_split", F.when(F.col("_upto") <= cut, "train").otherwise("test")).select(*df.columns, "_split")


def verify(nodes: DataFrame) -> DataFrame:
    """Per node: contribution_ratio, train_ratio, test_ratio, mean_train_ratio, insufficient_samples, ratio_deviation."""
    every = Window.partitionBy()  # one row per node
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    rows = nodes.select("node_id", "total_rows", "train_rows", "test_rows", share(F.col("total_rows"), F.sum("total_rows").over(every)).alias("contribution_ratio"), share(F.col("train_rows"), F.col("total_rows")).alias("train_ratio"), share(F.col("test_rows"), F.col("total_rows")).alias("test_ratio"))
    rows = rows.withColumn("mean_train_ratio", F.avg("train_ratio").over(every))
    return rows.withColumn("insufficient_samples", (F.col("train_rows") < MIN_SAMPLES) | (F.col("test_rows") < MIN_SAMPLES)).withColumn("ratio_deviation", F.abs(F.col("train_ratio") - F.col("mean_train_ratio")) > MAX_DEVIATION)


def global_report(nodes: DataFrame) -> dict:
    """Totals, effective ratios, per-node summaries, label counts and whether all is well."""
    rows = [r.asDict() for r in verify(nodes).collect()]  # one row per node
    if not rows:
        raise EmptyDataset("no manifests")
    total = sum(r["total_rows"] for r in rows)
    part = lambda name: sum(r[name] for r in rows) / total if total else 0.0
    labels = None
    if "label_distribution" in nodes.columns:
        counts = nodes.select(F.explode("label_distribution").alias("label", "n")).groupBy("label").agg(F.sum("n").alias("n"))
        labels = {r.label: r.n for r in counts.collect()}
    issues = [(r["node_id"], kind) for r in rows for kind in ("insufficient_samples", "ratio_deviation") if r[kind]]
    return {"total_rows": total, "effective_train_ratio": part("train_rows"), "effective_test_ratio": part("test_rows"), "nodes": rows, "label_distribution": labels, "issues": issues, "quality_passed": not issues}


