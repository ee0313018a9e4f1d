"""Joins whose null, order and update rules Spark doesn't give by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(right, condition, how).drop(*[f"_r_{k}" for k in keys])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first by an order that should be total. Spark prunes before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_match(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Inner join on a derived key, then the first pair of each key by (left order, right order)."""
    a = first_per_key(left.filter(F.col(key).isNotNull()), [key], [F.col(left_order)])
    b = first_per_key(right.filter(F.col(key).isNotNull()), [key], [F.col(right_order)])
    return a.join(b, key)


def updated(base: DataFrame, updates: DataFrame, key: str, ordinal: str, values: list[str]) -> DataFrame:
    """base with values replaced by the update of the highest ordinal for each key; flag `updated` tells which rows changed."""
    last = first_per_key(updates.filter(F.col(key).isNotNull()), [key], [F.col(ordinal).desc()])
    last = last.select(key, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(1).alias("updated"))
    out = base.join(last, key, "left")
    kept = [c for c in base.columns if c not in values]
    return out.select(*kept, *[F.when(F.col("updated") == 1, F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values], F.coalesce("updated", F.lit(0)).alias("updated"))


def looked_up(df: DataFrame, key: str, items: str, lookup: DataFrame, item_key: str, value: str) -> DataFrame:
    """(key, found): for each key the values of its list's items in list order; items without a value are left out."""
    long = df.select(key, F.posexplode(items).alias("_pos", item_key))
    rows = long.join(lookup.select(item_key, value), item_key, "left")
    pairs = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("_pos", F.col(value).alias("v")))))
    return rows.groupBy(key).agg(F.transform(pairs, lambda x: x["v"]).alias("found"))


def two_grain(base: DataFrame, coarse: DataFrame, coarse_key: list[str], fine: DataFrame, fine_key: list[str]) -> DataFrame:
    """Left joins of a coarse and a fine table, each with one row for a key."""
    return base.join(coarse, coarse_key, "left").join(fine, fine_key, "left")


def dense(keys: DataFrame, found: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """All keys, with counts that are 0 where nothing was found."""
    return keys.join(found, key, "left").fillna(0, counts)
