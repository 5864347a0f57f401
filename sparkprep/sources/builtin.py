"""Small classic tables made by rule: flower measurements and images of fixed shapes.

The tables have the usual schemas and sizes; values are drawn from a seeded hash around each class's
characteristic. Real copies can be read from a path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.core import uniform
from sparkprep.operators.splits import Split, from_ratios, stratified


@dataclass(frozen=True)
class Canonical:
    name: str
    data: DataFrame
    features: tuple[str, ...]
    target: str
    num_classes: int
    description: str

    def __len__(self) -> int:
        return self.data.count()

    def wide(self) -> DataFrame:
        """One column per feature."""
        if "pixels" not in self.data.columns:
            return self.data
        n = len(self.features)
        return self.data.select(*[F.col("pixels")[i].alias(f"pixel_{i}") for i in range(n)], *[c for c in self.data.columns if c not in ("id", "pixels")])

    def split(self, train: float = 0.8, seed: int | None = 42) -> Split:
        """Stratified where there is a class, else by position."""
        return stratified(self.data, self.target, "id", train, 1 - train, seed=seed) if seed is not None else from_ratios(self.data, "id", train, 1 - train)


_MEASURES = ("sepal_length", "sepal_width", "petal_length", "petal_width")
# Species with the mean and deviation of each measure.
_SPECIES = {"setosa": ((5.006, 0.35), (3.428, 0.38), (1.462, 0.17), (0.246, 0.11)), "versicolor": ((5.936, 0.52), (2.770, 0.31), (4.260, 0.47), (1.326, 0.20)), "virginica": ((6.588, 0.64), (2.974, 0.32), (5.552, 0.55), (2.026, 0.27))}


def _normal(i: int) -> Column:
    """Nearly normal: a sum of twelve uniform numbers."""
    return sum((uniform(100 * i + k, "id") for k in range(12)), F.lit(-6.0))


def iris(spark: SparkSession, path: str | None = None) -> Canonical:
    """150 rows in three classes; from a CSV of the five columns if a path is given."""
    if path:
        df = spark.read.csv(path, header=True, inferSchema=True).withColumn("id", F.monotonically_increasing_id())
    else:
        rows = spark.range(150).withColumn("species", F.element_at(F.array(*map(F.lit, _SPECIES)), (F.floor(F.col("id") / 50) + 1).cast("int")))
        value = lambda j: F.round(sum((F.when(F.col("species") == s, m[j][0] + m[j][1] * _normal(j + 1)).otherwise(0.0) for s, m in _SPECIES.items()), F.lit(0.0)), 1)
        df = rows.select("id", *[F.greatest(value(j), F.lit(0.1)).alias(c) for j, c in enumerate(_MEASURES)], "species")
    return Canonical("iris", df, _MEASURES, "species", 3, "measurements of three species")


def species_code(name: str = "species") -> Column:
    """0, 1, 2 in the usual order."""
    out = F.lit(None).cast("int")
    for i, s in enumerate(_SPECIES):
        out = F.when(F.col(name) == s, i).otherwise(out)
    return out


def _images(spark: SparkSession, n: int, pixels: int, label: Column) -> DataFrame:
    """Class patterns: a wave whose frequency follows the label, with seeded noise."""
    wave = lambda i: (F.sin(i * (F.col("label") + 1) * 0.05) + 1) / 2 * 0.8 + F.pmod(F.xxhash64(F.col("id"), i), F.lit(1000)) / 1000.0 * 0.2
    return spark.range(n).withColumn("label", label.cast("int")).withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(pixels - 1)), lambda i: wave(i).cast("float"))).select("id", "pixels", "label")


def _names(pixels: int) -> tuple[str, ...]:
    return tuple(f"pixel_{i}" for i in range(pixels))


def mnist(spark: SparkSession) -> Canonical:
    return Canonical("mnist", _images(spark, 100, 784, F.col("id") % 10), _names(784), "label", 10, "100 images of 28 x 28")


def fashion_mnist(spark: SparkSession) -> Canonical:
    return Canonical("fashion_mnist", _images(spark, 100, 784, F.floor(F.col("id") / 10)), _names(784), "label", 10, "100 images of 28 x 28")


def cifar10(spark: SparkSession) -> Canonical:
    return Canonical("cifar10", _images(spark, 100, 3072, F.col("id") % 10), _names(3072), "label", 10, "100 colour images of 32 x 32")


def cifar100(spark: SparkSession) -> Canonical:
    """100 fine classes in 20 coarse ones."""
    df = _images(spark, 100, 3072, F.col("id")).withColumnRenamed("label", "fine_label").withColumn("coarse_label", (F.col("fine_label") % 20).cast("int"))
    return Canonical("cifar100", df, _names(3072), "fine_label", 100, "100 colour images of 32 x 32")
