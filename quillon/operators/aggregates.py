"""Aggregates with explicit order, distinctness and null rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sorted_distinct(c: str, sep: str = " | ") -> Column:
    """Distinct values in order of value; no value gives null."""
    return F.nullif(F.array_join(F.sort_array(F.collect_set(c)), sep), F.lit(""))


def ordered_distinct(order: Column, c: str, sep: str = " | ") -> Column:
    """Distinct values in order of first appearance by `order`."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(c).alias("v"))))
    return F.nullif(F.array_join(F.array_distinct(F.transform(rows, lambda x: x["v"])), sep), F.lit(""))


def top_distinct(df: DataFrame, keys: list[str], item: str, order: str, k: int | None = None, last: int = 9999) -> DataFrame:
    """(keys, items): the first k different items of each key by their least order (null order is last), ties by item; without k, all.

    Both steps shrink before the shuffle: partial minima, then a group limit of k.
    """
    least = df.filter(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.min(F.coalesce(order, F.lit(last))).alias("_o"))
    if k is None:
        return least.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", item))), lambda x: x[item]).alias("items"))
    w = Window.partitionBy(*keys).orderBy("_o", item)
    top = least.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", item))), lambda x: x[item]).alias("items"))


def shares(df: DataFrame, c: str) -> DataFrame:
    """value, n, share over all rows; null is a value. The one-row total meets the few counts in a broadcast."""
    counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.nullif(F.col("_t"), F.lit(0))).alias("share"))


def balance_label(shares_of_two: DataFrame, gap: float = 0.15) -> DataFrame:
    """(gap, label) of the two shares of a binary class: `balanced` if they differ by less than gap."""
    one = shares_of_two.filter("value is not null").agg((F.max("share") - F.min("share")).alias("gap"))
    return one.withColumn("label", F.when(F.col("gap") < gap, "balanced").otherwise("imbalanced"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rate) in one pass over the table."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "rate")


def grouped_null_rates(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(group, n_columns, mean_rate): the mean of the null rates of each group's columns; columns that the table lacks don't count."""
    present = {g: [c for c in columns if c in df.columns] for g, columns in groups.items()}
    rates = null_rates(df, sorted({c for columns in present.values() for c in columns}))
    names = df.sparkSession.createDataFrame([(g, c) for g, columns in present.items() for c in columns], "group string, column_name string")
    return names.join(F.broadcast(rates), "column_name").groupBy("group").agg(F.count("*").alias("n_columns"), F.avg("rate").alias("mean_rate"))


def missing_levels(rates: DataFrame, limits: tuple[float, ...] = (0.3, 0.5, 0.8)) -> DataFrame:
    """(limit, n_columns): how many columns miss more than each limit."""
    one = rates.agg(*[F.count_if(F.col("rate") > x).alias(str(x)) for x in limits])
    return one.unpivot([], [F.col(f"`{c}`") for c in one.columns], "limit", "n_columns")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """all_copies: rows whose key repeats; extra_copies: those beyond the first of each key."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    return n.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("all_copies"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra_copies"))


def flag_rates(df: DataFrame, flags: list[str], target: str) -> DataFrame:
    """(flag, value, n, rate) for values 0 and 1 of each flag; a value that doesn't occur stays with n = 0 and a null rate."""
    long = df.unpivot([target], flags, "flag", "value")
    found = long.groupBy("flag", "value").agg(F.count("*").alias("n"), F.avg(target).alias("rate"))
    grid = df.sparkSession.createDataFrame([(f, v) for f in flags for v in (0, 1)], "flag string, value int")
    return grid.join(found, ["flag", "value"], "left").fillna(0, ["n"])


def rates_at_least(rates: DataFrame, value: int = 1, least: int = 20) -> DataFrame:
    """(flag, n, rate) of flag_rates for one value of the flags, where it occurs at least `least` times."""
    return rates.filter((F.col("value") == value) & (F.col("n") >= least)).select("flag", "n", "rate")


def rate_by(df: DataFrame, key: str, target: str, small: int = 10) -> DataFrame:
    """(key, n, positives, rate, small): counts and rate of a 0/1 target; small marks keys with fewer than `small` known targets."""
    n = F.count(target)
    return df.groupBy(key).agg(n.alias("n"), F.sum(target).alias("positives"), F.avg(target).alias("rate"), (n < small).cast("int").alias("small"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of all pairs of values that occur in either column; null is a value and a pair that is absent counts 0."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    grid = n.select(a).distinct().crossJoin(F.broadcast(n.select(b).distinct()))
    n = n.select(F.col(a).alias("_a"), F.col(b).alias("_b"), "n")
    return grid.join(n, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b")), "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))
