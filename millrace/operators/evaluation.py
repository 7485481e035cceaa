"""Training, evaluation and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified_split(df: DataFrame, id_: str, label: str, share: float = 0.2) -> DataFrame:
    """``is_test``: of each label, the rows whose ids hash lowest, ``share`` of them rounded up.

    The rank in a label is a rank in a hash bucket on top of the buckets before,
    so no task holds all rows of a label.
    """
    keyed = df.withColumn("_h", F.md5(F.col(id_).cast("string"))).withColumn("_b", F.substring("_h", 1, 2))
    counts = keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_b")
    offsets = counts.select(label, "_b", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    number = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", id_)) + F.col("_before")
    joined = keyed.join(offsets, (keyed[label].eqNullSafe(offsets[label])) & (keyed["_b"] == offsets["_b"])).drop(offsets[label]).drop(offsets["_b"])
    return joined.withColumn("is_test", number <= F.ceil(F.col("_all") * F.lit(share))).drop("_h", "_b", "_before", "_all")


def scaler_stats(df: DataFrame, vector: str, width: int) -> DataFrame:
    """(feature, mean, std) with the population's standard deviation; one row a feature."""
    sums = df.agg(*[F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(width)], *[F.stddev_pop(F.get(vector, F.lit(i)).cast("double")).alias(f"s{i}") for i in range(width)])
    rows = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i in range(width)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def scaled(df: DataFrame, vector: str, stats: DataFrame) -> DataFrame:
    """``df`` with ``vector`` standardised; a feature that doesn't vary is centred alone. ``stats`` is one row a feature."""
    flat = stats.agg(F.array_sort(F.collect_list(F.struct("feature", "mean", "std"))).alias("_stats"))
    one = lambda x, s: (x.cast("double") - s["mean"]) / F.when(s["std"] == 0, 1.0).otherwise(s["std"])
    return df.crossJoin(F.broadcast(flat)).withColumn(vector, F.zip_with(vector, "_stats", one)).drop("_stats")


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) by class, and rows ``accuracy``, ``macro avg`` and ``weighted avg``; 0 where undefined.

    All come from the counts of (actual, predicted): one shuffle of as many rows.
    """
    pairs = df.groupBy(F.col(actual).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("mine"), F.lit(0).alias("said")), F.struct(F.col("p").alias("label"), F.lit(0).alias("mine"), F.lit(1).alias("said")))).alias("s"), "n", (F.col("y") == F.col("p")).alias("hit"))
    per = sides.groupBy("s.label").agg(F.sum(F.col("n") * F.col("s.mine")).alias("support"), F.sum(F.col("n") * F.col("s.said")).alias("said"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("s.mine")).otherwise(0)).alias("hits"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    scored = per.withColumns({"precision": ratio(F.col("hits"), F.col("said")), "recall": ratio(F.col("hits"), F.col("support"))})
    scored = scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    rows = scored.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / total).alias(c)
    right = (F.sum("hits") / total)
    sums = [
        scored.agg(F.lit("accuracy").alias("label"), right.alias("precision"), right.alias("recall"), right.alias("f1"), total.alias("support")),
        scored.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support")),
        scored.agg(F.lit("weighted avg").alias("label"), *map(weighted, ("precision", "recall", "f1")), total.alias("support")),
    ]
    for s in sums:
        rows = rows.unionByName(s)
    return rows


def train_forest(df: DataFrame, vector: str, label: str, trees: int = 100, depth: int = 5, seed: int = 42) -> PipelineModel:
    """A random forest on an array column."""
    return Pipeline(stages=[RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)]).fit(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))


def predict(model: PipelineModel, df: DataFrame, vector: str) -> DataFrame:
    """``df`` with ``prediction``; a whole batch in one pass."""
    scored = model.transform(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    return scored.drop("features", "rawPrediction", "probability")
