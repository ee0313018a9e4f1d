"""Simple models and their metrics: least squares in closed form, a shallow tree, baselines."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import safe_ratio
from quillon.operators import joins
from quillon.operators.profile import running_counts


def cohort(df: DataFrame, conditions: str, features: list[str]) -> DataFrame:
    return df.filter(conditions).dropna(subset=features)


def split(df: DataFrame, key: str, held_out: int = 30) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a key's remainder modulo 100: the same at every run and partitioning."""
    at = F.pmod(F.col(key), F.lit(100))
    return df.filter(at >= held_out), df.filter(at < held_out)


def split_stratified(df: DataFrame, key: str, label: str, held_out: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each label's rows in the order of a scrambled key the first held_out share is the test. Rows of one key stay together."""
    place = F.pmod(F.col(key) * F.lit(7919), F.lit(100_003))
    rows = df.withColumn("_place", place)
    counts = running_counts(rows, [label], "_place")
    size = counts.groupBy(label).agg(F.sum("n").alias("_size"))
    first = joins.null_safe(counts, F.broadcast(size), [label], "inner").withColumn("_test", (F.col("before") < held_out * F.col("_size")).cast("int")).select(label, "_place", "_test")
    out = joins.null_safe(rows, first, [label, "_place"], "inner")
    return out.filter("_test = 0").drop("_place", "_test"), out.filter("_test = 1").drop("_place", "_test")


def with_retention(df: DataFrame, current: str, following: str, low: float = 0.70) -> DataFrame:
    """df with retention (next over current) and low_retention, 1 below `low`; both are null where it is unknown."""
    kept = safe_ratio(F.col(following), F.col(current))
    return df.withColumn("retention", kept).withColumn("low_retention", (F.col("retention") < low).cast("int"))


def above(df: DataFrame, c: str, limits: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """(limit, n): how many values lie above each limit."""
    one = df.agg(*[F.count_if(F.col(c) > x).alias(str(x)) for x in limits])
    return one.unpivot([], [F.col(f"`{c}`") for c in one.columns], "limit", "n")


def improvement(model_error: Column, baseline_error: Column) -> Column:
    """By how many percent the model's error is below the baseline's; null if that is 0."""
    return safe_ratio((baseline_error - model_error) * 100, baseline_error)


def coefficients(fit: DataFrame, features: list[str]) -> DataFrame:
    """(feature, coefficient) of ols2's row, with the intercept."""
    names = dict(zip(["intercept", "b1", "b2"], ["intercept", *features]))
    return fit.select(*[F.col(c).alias(n) for c, n in names.items()]).unpivot([], list(names.values()), "feature", "coefficient")


def importances(model: DecisionTreeClassificationModel, features: list[str], spark: SparkSession) -> DataFrame:
    """(feature, importance) of a tree: its share of the impurity that all splits removed."""
    return spark.createDataFrame([(f, float(x)) for f, x in zip(features, model.featureImportances.toArray())], "feature string, importance double")


def ols2(df: DataFrame, x1: str, x2: str, y: str) -> DataFrame:
    """(intercept, b1, b2, n) of y on two features, from one pass of covariances; null if they are collinear."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in (x1, x2, y)]).dropna()
    s = d.agg(F.var_pop(x1).alias("v1"), F.var_pop(x2).alias("v2"), F.covar_pop(x1, x2).alias("c12"), F.covar_pop(x1, y).alias("c1"), F.covar_pop(x2, y).alias("c2"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"), F.count("*").alias("n"))
    det = F.nullif(F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12"), F.lit(0.0))
    s = s.withColumns({"b1": (F.col("c1") * F.col("v2") - F.col("c2") * F.col("c12")) / det, "b2": (F.col("c2") * F.col("v1") - F.col("c1") * F.col("c12")) / det})
    return s.select((F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("intercept"), "b1", "b2", "n")


def errors(actual: Column, predicted: Column) -> list[Column]:
    gap = actual - predicted
    return [F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse")]


def classification(actual: Column, predicted: Column) -> list[Column]:
    """Confusion counts, balanced accuracy and F1 of label 1; a metric without cases is 0."""
    n = lambda a, p: F.count_if((actual == a) & (predicted == p))
    tp, tn, fp, fn = n(1, 1), n(0, 0), n(0, 1), n(1, 0)
    rate = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return [tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), ((rate(tp, tp + fn) + rate(tn, tn + fp)) / 2).alias("balanced_accuracy"), rate(2 * tp, 2 * tp + fp + fn).alias("f1")]


def tree(df: DataFrame, features: list[str], label: str, *, depth: int = 3, least: int = 20, bins: int = 256) -> DecisionTreeClassificationModel:
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    return DecisionTreeClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, minInstancesPerNode=least, maxBins=bins, seed=101).fit(rows)


def predicted(model: DecisionTreeClassificationModel, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=features, outputCol="_x").transform(df)).drop("_x", "rawPrediction", "probability")
