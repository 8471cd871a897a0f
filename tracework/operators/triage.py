"""Triage of rows into score bins by a tree or a forest, with a seeded split that keeps the bins' shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST_ROWS = 20


def binned(rows: DataFrame, score: str, bins: int = 3) -> DataFrame:
    """With label: the quantile bin of the score, from 0."""
    cuts = rows.agg(F.percentile_approx(score, F.array(*[F.lit(i / bins) for i in range(1, bins)]), 10_000).alias("c")).first()["c"] or []
    label = sum((F.when(F.col(score) > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    return rows.withColumn("label", label.cast("double"))


def split(rows: DataFrame, key: str, share: float = 0.8, seed: int = 42, by: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows for training and for testing: of each label's n rows, the first share * n (rounded) in the order of a seeded
    hash of the key, the same for any order or partitioning. Ranks are numbered in hash buckets and offset by the buckets
    before, so that no task holds all rows of a label."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("_b", F.substring("_h", 1, 2))
    upto, label = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(by)
    # 256 buckets of each label: a size fixed by parameters
    counts = hashed.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_c")).select(by, "_b", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_o"), F.sum("_c").over(label).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(by, "_b").orderBy("_h", key))
    placed = hashed.withColumn("_k", rank).join(F.broadcast(counts), [by, "_b"])
    train = F.col("_o") + F.col("_k") <= F.round(F.col("_n") * share)
    return tuple(placed.where(test).drop("_h", "_b", "_k", "_o", "_n") for test in (train, ~train))


def triage(rows: DataFrame, key: str, features: list[str], score: str, kind: str = "forest", seed: int = 42):
    """(predictions of the test rows, accuracy); None for fewer than LEAST_ROWS rows."""
    from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    if rows.limit(LEAST_ROWS).count() < LEAST_ROWS:
        return None
    ready = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(binned(rows.fillna(0, features), score))
    train, test = split(ready, key, seed=seed)
    model = RandomForestClassifier(numTrees=20, seed=seed) if kind == "forest" else DecisionTreeClassifier(impurity="entropy", seed=seed)
    found = model.fit(train).transform(test).select(key, "label", "prediction")
    return found, found.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
