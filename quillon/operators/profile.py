"""Statistical profile: distributions, shape, correlation and association, each from few passes of aggregates."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillon.operators import aggregates, joins
from quillon.operators.aggregates import contingency


def long(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., column_name, x) of numeric columns as doubles."""
    return df.select(*(keep or []), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keep or [], columns, "column_name", "x")


#: Ranges of a column's values in which order statistics are looked for.
RANGES = 256


def _ranges(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, _splits): borders of about RANGES equal parts of each group's values."""
    return df.groupBy(*by).agg(F.array_distinct(F.percentile_approx(x, [i / RANGES for i in range(1, RANGES)], 50 * RANGES)).alias("_splits"))


def running_counts(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """(by, x, n, before): how often each value occurs in its group, and how many of the group's values are less. Null values are left out.

    Values are counted first. Running sums go by ranges of values, whose totals are summed up apart, so a group is no single task.
    """
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    counts = joins.null_safe(counts, F.broadcast(_ranges(counts, by, x)), by, "inner")
    counts = counts.withColumn("_range", F.size(F.filter("_splits", lambda s: s < F.col(x)))).drop("_splits")
    within = F.sum("n").over(Window.partitionBy(*by, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    totals = counts.groupBy(*by, "_range").agg(F.sum("n").alias("_m"))
    totals = totals.withColumn("_start", F.sum("_m").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_m")).drop("_m")
    rows = joins.null_safe(counts.withColumn("_within", within), totals, [*by, "_range"], "inner")
    return rows.select(*by, x, "n", (F.col("_start") + F.col("_within")).alias("before"))


def quantiles(df: DataFrame, by: list[str], x: str, probs: dict[str, float]) -> DataFrame:
    """(by, one column for each of probs): exact quantiles with linear interpolation, from running counts."""
    rows = running_counts(df, by, x).withColumn("_upto", F.col("before") + F.col("n"))
    size = joins.null_safe(rows, df.filter(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("_size")), by, "inner")
    out, at = [], {}
    for name, p in probs.items():
        rank = p * (F.col("_size") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        at[name] = (F.min(F.when(F.col("_upto") > low, F.col(x))), F.min(F.when(F.col("_upto") > high, F.col(x))), F.first(rank - low))
        out += [at[name][0].alias(f"_a_{name}"), at[name][1].alias(f"_b_{name}"), at[name][2].alias(f"_f_{name}")]
    value = lambda q: (F.col(f"_a_{q}") + (F.col(f"_b_{q}") - F.col(f"_a_{q}")) * F.col(f"_f_{q}")).alias(q)
    return size.groupBy(*by).agg(*out).select(*by, *[value(q) for q in probs])


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, distinct, mean, std (n - 1), min, exact quartiles and max of each numeric column."""
    rows = long(df, columns)
    values = rows.filter("x is not null").groupBy("column_name", "x").agg(F.count("*").alias("_n")).groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    one = rows.groupBy("column_name").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    out = one.join(values, "column_name", "left").join(quantiles(rows, ["column_name"], "x", QUARTILES), "column_name", "left")
    return out.select("column_name", "n", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "mean", "std", "min", *QUARTILES, "max")


def described_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, n_distinct, top, freq) of text columns, null not counted; of values as frequent the least is top."""
    counts = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "v").groupBy("column_name", "v").agg(F.count("*").alias("n"))
    known = F.col("v").isNotNull()
    return counts.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n"), F.count("v").alias("n_distinct"), F.min_by("v", F.when(known, F.struct(-F.col("n"), F.col("v")))).alias("top"), F.max(F.when(known, F.col("n"))).alias("freq")
    )


def described_all(df: DataFrame, numeric: list[str], text: list[str]) -> DataFrame:
    """One row for each column with what fits its kind, the rest null."""
    return described(df, numeric).unionByName(described_text(df, text), allowMissingColumns=True)


def shape(df: DataFrame, roles_of: dict[str, str] | None = None) -> DataFrame:
    """(metric, name, value): rows, columns, columns of each type and of each role."""
    facts = [("columns", "all", len(df.columns)), *[("type", k, n) for k, n in Counter(f.dataType.simpleString() for f in df.schema).items()], *[("role", k, n) for k, n in Counter((roles_of or {}).values()).items()]]
    spark = df.sparkSession
    return df.agg(F.lit("rows").alias("metric"), F.lit("all").alias("name"), F.count("*").alias("value")).unionByName(spark.createDataFrame(facts, "metric string, name string, value long"))


def identifiers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, n_distinct, unique) of identifier columns."""
    return described_text(df, columns).select("column_name", "n", "n_distinct", (F.col("n") == F.col("n_distinct")).cast("int").alias("unique"))


def scatter(df: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """The points of a scatter plot: rows in which both values are known."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(by).alias("by")] if by else []))


def centers(df: DataFrame, group: str, c: str) -> DataFrame:
    """(group, mean, median, n) of a measure; groups without a value have null."""
    one = df.groupBy(group).agg(F.avg(c).alias("mean"), F.count(c).alias("n"))
    return joins.null_safe(one, quantiles(df, [group], c, {"median": 0.5}), [group]).select(group, "mean", "median", "n")


def top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_distinct, top, top_share, constant, near_constant); null is a value for the share; ties go to the lesser text."""
    counts = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "v").groupBy("column_name", "v").agg(F.count("*").alias("n"))
    one = counts.groupBy("column_name").agg(F.count("v").alias("n_distinct"), F.min_by("v", F.struct(-F.col("n"), F.coalesce("v", F.lit("")))).alias("top"), (F.max("n") / F.sum("n")).alias("top_share"))
    return one.withColumns({"constant": (F.col("n_distinct") <= 1).cast("int"), "near_constant": ((F.col("n_distinct") <= 5) & (F.col("top_share") >= 0.95)).cast("int")})


def adjusted_skewness(c: str) -> Column:
    """Bias-adjusted skewness; null below 3 values, 0 for a constant."""
    n = F.count(c)
    return F.when(n >= 3, F.coalesce(F.skewness(c) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2), F.lit(0.0)))


def skewness_table(df: DataFrame, columns: list[str]) -> DataFrame:
    out = long(df, columns).groupBy("column_name").agg(adjusted_skewness("x").alias("skew"))
    size = F.abs(F.col("skew"))
    return out.withColumn("label", F.when(size <= 0.5, "symmetric").when(size <= 1, "moderate").when(size > 1, "high"))


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """(bin, n) over bins of equal width from least to greatest, the last one closed; empty bins count 0."""
    x = df.select(F.col(c).cast("double").alias("x")).filter("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = x.crossJoin(F.broadcast(ends))
    at = F.when(F.col("lo") == F.col("hi"), F.lit(1)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1, F.lit(bins)))
    found = rows.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin").join(found, "bin", "left").fillna(0, ["n"])


def pearson(a: str, b: str) -> Column:
    """Correlation over rows with both values; null if either is constant there (Spark's corr would raise)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def average_ranks(counts: DataFrame) -> Column:
    """The rank of a value of running_counts with ties averaged."""
    return counts["before"] + (counts["n"] + 1) / 2


def correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column_name, pearson, spearman, max_abs) to a target over pairs without null.

    Equal pairs are counted first; ranks come from running counts of each column's values among its pairs, and sums are weighted.
    """
    rows = long(df.withColumn("_y", F.col(target).cast("double")), columns, ["_y"]).filter("x is not null and _y is not null")
    cells = rows.groupBy("column_name", "x", "_y").agg(F.count("*").alias("w"))
    x, y = running_counts(rows, ["column_name"], "x"), running_counts(rows, ["column_name"], "_y")
    ranked = cells.join(x.select("column_name", "x", average_ranks(x).alias("rx")), ["column_name", "x"]).join(y.select("column_name", "_y", average_ranks(y).alias("ry")), ["column_name", "_y"])
    # moments about the mean, which is known before the second pass
    means = ranked.groupBy("column_name").agg(F.sum("w").alias("n"), *[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"m_{c}") for c in ("x", "_y", "rx", "ry")])
    at = ranked.join(F.broadcast(means), "column_name")
    gap = lambda c: F.col(c) - F.col(f"m_{c}")
    moment = lambda a, b: F.sum(gap(a) * gap(b) * F.col("w"))
    r = lambda a, b: moment(a, b) / F.nullif(F.sqrt(moment(a, a) * moment(b, b)), F.lit(0.0))
    out = at.groupBy("column_name").agg(r("x", "_y").alias("pearson"), r("rx", "ry").alias("spearman"))
    return out.withColumn("max_abs", F.greatest(F.abs("pearson"), F.abs("spearman")))


def two_column(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, pearson, spearman) of named pairs of columns."""
    out = None
    for a, b in pairs:
        one = correlations(df, [a], b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "pearson", "spearman")
        out = one if out is None else out.unionByName(one)
    return out


def numeric_profile(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Missing share, mean, median, std, min, max, skewness and both correlations to the target of each column."""
    rate = long(df, columns).groupBy("column_name").agg(F.avg(F.col("x").isNull().cast("int")).alias("missing_rate"))
    kept = described(df, columns).select("column_name", "mean", "median", "std", "min", "max")
    skew = skewness_table(df, columns).select("column_name", "skew")
    return rate.join(kept, "column_name", "left").join(skew, "column_name", "left").join(correlations(df, columns, target).drop("max_abs"), "column_name", "left")


def feature_quality(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """One row for each feature: missing share, distinct values, whether it is constant or nearly so, skewness, strongest correlation."""
    rate = aggregates.null_rates(df, columns).withColumnRenamed("rate", "missing_rate")
    tops = top_values(df, columns).select("column_name", "n_distinct", "constant", "near_constant")
    numeric = [c for c in columns if c in roles(df)["numeric"]]
    out = rate.join(tops, "column_name")
    if numeric:
        out = out.join(skewness_table(df, numeric).select("column_name", "skew"), "column_name", "left").join(correlations(df, numeric, target).select("column_name", "max_abs"), "column_name", "left")
    return out


def selection(quality: DataFrame, *, missing: float = 0.8, investigate: float = 0.5, useful: float = 0.05, most: int = 15) -> DataFrame:
    """(list, column_name): features to exclude (constant or mostly missing), to investigate (nearly constant or often missing), and the
    `most` useful ones by correlation; a feature that is excluded is in no other list."""
    gone = (F.col("constant") == 1) | (F.col("missing_rate") > missing)
    exclude = quality.filter(gone).select(F.lit("exclude").alias("list"), "column_name")
    look = quality.filter(~gone & ((F.col("near_constant") == 1) | (F.col("missing_rate") > investigate))).select(F.lit("investigate").alias("list"), "column_name")
    best = quality.filter(~gone & (F.col("max_abs") > useful)).orderBy(F.desc("max_abs"), "column_name").limit(most).select(F.lit("useful").alias("list"), "column_name")
    return exclude.unionByName(look).unionByName(best)


def summary_text(title: str, n_rows: int, shares: list[tuple], lists: list[tuple[str, str]]) -> str:
    """A short report: rows, class shares and the selection lists."""
    lines = [f"# {title}", "", f"Rows: {n_rows:,}", "", "Classes: " + ", ".join(f"{v}: {share:.1%}" for v, share in shares), ""]
    for name in ("exclude", "investigate", "useful"):
        names = sorted(c for kind, c in lists if kind == name)
        lines.append(f"{name.capitalize()}: {', '.join(names) if names else 'none'}")
    return "\n".join([*lines, ""])


def pair_correlations(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """(a, b, r) of all pairs of columns with |r| >= least, pairwise complete, in one pass."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[pearson(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    names = df.sparkSession.createDataFrame([(f"p{i}", a, b) for i, (a, b) in enumerate(pairs)], "p string, a string, b string")
    return one.unpivot([], one.columns, "p", "r").join(F.broadcast(names), "p").filter(F.abs("r") >= least).select("a", "b", "r")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Both triangles and the diagonal over rows without any null."""
    half = pair_correlations(df.select(*columns).dropna(), columns)
    ones = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, r double")
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")).unionByName(ones)


def box_stats(df: DataFrame, group: str, c: str) -> DataFrame:
    """Quartiles, whiskers (the last values within 1.5 * IQR) and number of outliers of each group."""
    q = quantiles(df, [group], c, QUARTILES)
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(c) >= low) & (F.col(c) <= high)
    rows = joins.null_safe(df.filter(F.col(c).isNotNull()).select(group, c), q, [group], "inner")
    return rows.groupBy(group, *QUARTILES).agg(F.min(F.when(inside, F.col(c))).alias("low"), F.max(F.when(inside, F.col(c))).alias("high"), F.count_if(~inside).alias("n_outliers"))


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 (Yates' correction at one degree of freedom), dof, n and bias-corrected Cramer's V of two categories."""
    cells = contingency(df, a, b)
    rows, columns = cells.groupBy(a).agg(F.sum("n").alias("_r")), cells.groupBy(b).agg(F.sum("n").alias("_c"))
    rows, columns = rows.select(F.col(a).alias("_a"), "_r"), columns.select(F.col(b).alias("_b"), "_c")
    all_ = cells.join(rows, F.col(a).eqNullSafe(F.col("_a"))).join(columns, F.col(b).eqNullSafe(F.col("_b")))
    size = cells.agg(F.sum("n").alias("_t"), F.countDistinct(F.coalesce(F.col(a).cast("string"), F.lit("\0"))).alias("_nr"), F.countDistinct(F.coalesce(F.col(b).cast("string"), F.lit("\0"))).alias("_nc"))
    all_ = all_.crossJoin(F.broadcast(size))
    expected = F.col("_r") * F.col("_c") / F.col("_t")
    dof = (F.col("_nr") - 1) * (F.col("_nc") - 1)
    gap = F.abs(F.col("n") - expected)
    gap = F.when(dof == 1, gap - F.least(gap, F.lit(0.5))).otherwise(gap)
    out = all_.groupBy("_t", "_nr", "_nc").agg(F.sum(gap * gap / F.nullif(expected, F.lit(0.0))).alias("chi2")).withColumn("dof", dof)
    n, k, r = F.col("_t"), F.col("_nc"), F.col("_nr")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    kk, rr = k - (k - 1) ** 2 / (n - 1), r - (r - 1) ** 2 / (n - 1)
    return out.withColumn("v", F.sqrt(phi / F.nullif(F.least(kk - 1, rr - 1), F.lit(0.0)))).select("chi2", "dof", n.alias("n"), "v")


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    """P(chi-square > x), by the regularised incomplete gamma function's series or continued fraction."""
    return pd.Series([_upper_gamma(d / 2, v / 2) if d and d > 0 and v == v else np.nan for v, d in zip(x, dof)])


def _upper_gamma(s: float, x: float) -> float:
    from math import exp, lgamma, log

    if x <= 0:
        return 1.0
    front = exp(-x + s * log(x) - lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b, d, c = x + 1 - s, 1 / (x + 1 - s), 1e300
    h = d
    for i in range(1, 10_000):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, vif) without intercept (uncentred), nulls at the median, constant and repeated columns left out.

    One pass gives the Gram matrix of a few columns, which the driver inverts.
    """
    x = [F.col(c).cast("double").alias(c) for c in columns]
    spread = df.select(*x).agg(*[F.stddev_pop(c).alias(c) for c in columns]).collect()[0]
    middle = {r.column_name: r["median"] for r in quantiles(long(df, columns), ["column_name"], "x", {"median": 0.5}).collect()}
    medians = {c: middle.get(c) for c in columns} | {f"_s_{c}": spread[c] for c in columns}
    kept = [c for c in columns if medians[c] is not None and medians[f"_s_{c}"]]
    full = df.select(*x).fillna({c: medians[c] for c in kept})
    sums = full.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(kept) for j, b in enumerate(kept) if i <= j], *[F.sum(F.abs(F.col(a) - F.col(b))).alias(f"d{i}_{j}") for i, a in enumerate(kept) for j, b in enumerate(kept) if i < j]).collect()[0] if kept else None
    unique = [i for i in range(len(kept)) if not any(sums[f"d{j}_{i}"] == 0 for j in range(i))]
    gram = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] for j in unique] for i in unique]).reshape(len(unique), len(unique))
    vif = np.diag(gram) * np.diag(np.linalg.pinv(gram)) if len(unique) else []
    return df.sparkSession.createDataFrame([(kept[i], float(v)) for i, v in zip(unique, vif)], "column_name string, vif double")


def roles(df: DataFrame, manifest: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Columns by kind (numeric, categorical) and, with a manifest, by role."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")]
    out = {"numeric": numeric, "categorical": [c for c in df.columns if c not in numeric]}
    for c, role in (manifest or {}).items():
        out.setdefault(role, []).append(c)
    return out


def leakage_review(spark: SparkSession, columns: list[str], predictors: list[str], targets: list[str], group_key: str, review: list[str]) -> DataFrame:
    """(check, result): targets among the predictors, predictors named like targets, whether rows can be split by group, and columns to look at."""
    named = sorted({c for t in targets for c in suspicious(predictors, t)})
    found = [c for c in targets if c in predictors]
    rows = [("targets among predictors", ", ".join(found) or "none"), ("predictors named like targets", ", ".join(named) or "none"), ("group key for splits", "yes" if group_key in columns else "no"), ("columns to review", ", ".join(c for c in review if c in columns) or "none")]
    return spark.createDataFrame(rows, "check string, result string")


def suspicious(columns: list[str], target: str) -> dict[str, str]:
    """Columns whose names tell of the target or the future: a leakage review."""
    stem = target.removeprefix("next_")
    return {c: "target" if c == target else "future" for c in columns if c == target or c.startswith(("next_", "change_", "increase_")) or (stem in c and "next" in c)}
