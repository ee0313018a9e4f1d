"""Panel targets: period-over-period leads and lags of groups, without leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import first_rule, flag, numbered, safe_ratio
from quillon.operators.aggregates import null_rates

DROP = "drop"


def drop_repeated_periods(df: DataFrame, group: str, period: str) -> DataFrame:
    """Rows of (group, period) pairs that occur once; all copies of repeated pairs go.

    Counts are joined back, so both joins of a hot pair can be split, and only counts are aggregated.
    """
    once = df.groupBy(group, period).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return df.join(once, [group, period], "left_semi")


def row_order(period: str, year: str | None = None, row_id: str | None = None) -> list[Column]:
    """The order of a group's rows: period, then the year with unknown ones last (as 9999), then the row id."""
    return [F.col(period), *([F.coalesce(F.col(year), F.lit(9999))] if year else []), *([F.col(row_id)] if row_id else [])]


def targets(df: DataFrame, group: str, period: str, measures: list[str], lags: int = 2, order: list[Column] | None = None) -> DataFrame:
    """next_period, next_*, lag1_* ... and changes of each measure, from observed neighbours in the order given, else by period.

    Targets (next, change, change_pct, increase) are known only where the next period is the current one plus 1; lags may reach over
    gaps. One exchange by group serves all windows.
    """
    w = Window.partitionBy(group).orderBy(*(order or row_order(period)))
    out = df.withColumn("next_period", F.lead(period).over(w))
    for m in measures:
        out = out.withColumn(f"_next_{m}", F.lead(m).over(w))
        for k in range(1, lags + 1):
            out = out.withColumn(f"lag{k}_{m}", F.lag(m, k).over(w))
    follows = F.col("next_period") == F.col(period) + 1
    for m in measures:
        out = out.withColumn(f"next_{m}", F.when(follows, F.col(f"_next_{m}"))).drop(f"_next_{m}")
        change = F.col(f"next_{m}") - F.col(m)
        out = out.withColumns({f"change_{m}": change, f"change_pct_{m}": safe_ratio(change, F.col(m)), f"increase_{m}": F.when(change.isNotNull(), flag(change > 0)), f"lag_change_{m}": F.col(m) - F.col(f"lag1_{m}"), f"lag_change_pct_{m}": safe_ratio(F.col(m) - F.col(f"lag1_{m}"), F.col(f"lag1_{m}"))})
    return out


def with_next_only(df: DataFrame, period: str) -> DataFrame:
    """Rows whose next period follows directly."""
    return df.filter(F.col("next_period") - F.col(period) == 1)


def in_scope(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy all conditions, (metric, value) of rows dropped by the first condition that fails). Unknown fails."""
    first = None
    for name, rule in rules.items():
        failed = ~F.coalesce(F.expr(rule), F.lit(False))
        first = F.when(failed, name) if first is None else first.when(failed, name)
    marked = df.withColumn(DROP, first)
    counts = marked.agg(F.count("*").alias("rows_in"), *[F.count_if(F.col(DROP) == n).alias(f"dropped_{n}") for n in rules], F.count_if(F.col(DROP).isNull()).alias("rows_out"))
    return marked.filter(F.col(DROP).isNull()).drop(DROP), counts.unpivot([], counts.columns, "metric", "value")


def modelling_rows(df: DataFrame, *, group: str, period: str, row_id: str, measures: list[str], eligible: str, lagged: list[str] | None = None, year: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that a model may learn from, (metric, value) of what went on the way).

    Rows must satisfy `eligible`, with a known group and a period of 1 or more that is the only one of its group; then all measures and
    those of the directly following period must be known. Lags of `lagged` columns come along. Unknown conditions fail.
    """
    ok = F.coalesce(F.expr(eligible) & F.col(group).isNotNull() & (F.col(period) >= 1), F.lit(False))
    marked = df.withColumn("_ok", ok)
    strict = drop_repeated_periods(marked.filter("_ok").drop("_ok"), group, period)
    w = Window.partitionBy(group).orderBy(*row_order(period, year, row_id))
    strict = strict.withColumns({f"lag1_{c}": F.lag(c, 1).over(w) for c in lagged or []})
    rows = targets(strict, group, period, measures, order=row_order(period, year, row_id))
    rows = rows.withColumn("has_lag", flag(F.col(f"lag1_{measures[0]}").isNotNull()))
    known = F.lit(True)
    following = F.col("next_period").isNotNull()
    for m in measures:
        known, following = known & F.col(m).isNotNull(), following & F.col(f"next_{m}").isNotNull()
    rows = rows.withColumns({"_known": known, "_follows": F.coalesce(following, F.lit(False))})
    first = marked.agg(F.count("*").alias("rows_in"), F.count_if("_ok").alias("eligible_rows"))
    last = rows.agg(F.count("*").alias("_strict"), F.count_if(~F.col("_known")).alias("dropped_missing_measures"), F.count_if(F.col("_known") & ~F.col("_follows")).alias("dropped_missing_target"), F.count_if(F.col("_known") & F.col("_follows")).alias("final_rows"), F.countDistinct(F.when(F.col("_known") & F.col("_follows"), F.col(group))).alias("final_groups"))
    one = first.crossJoin(F.broadcast(last)).withColumn("dropped_repeated_periods", F.col("eligible_rows") - F.col("_strict")).drop("_strict")
    return rows.filter("_known and _follows").drop("_known", "_follows", "next_period"), one.unpivot([], one.columns, "metric", "value")


def select_safe(df: DataFrame, identifiers: list[str], predictors: list[str], targets_: list[str], leakage: list[str]) -> DataFrame:
    """Identifiers, predictors and targets that df has, in this order, each once; ValueError if a predictor or identifier leaks the future."""
    leaks = sorted({*identifiers, *predictors} & {*leakage, *targets_})
    if leaks:
        raise ValueError("these tell of the future: " + ", ".join(leaks))
    return df.select(*dict.fromkeys(c for c in [*identifiers, *predictors, *targets_] if c in df.columns))


def quality_report(metrics: DataFrame, table: DataFrame, manifest_: DataFrame, null_columns: list[str], flags: list[str]) -> DataFrame:
    """(metric, value): the metrics of modelling_rows, columns of each role, null rates and shares of flags in the final table; columns it lacks don't count."""
    roles = manifest_.groupBy(F.concat(F.lit("columns::"), "role").alias("metric")).agg(F.count("*").cast("double").alias("value"))
    have = [c for c in null_columns if c in table.columns], [c for c in flags if c in table.columns]
    one = table.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"null_rate::{c}") for c in have[0]], *[F.avg(F.col(c).cast("double")).alias(f"class_balance::{c}") for c in have[1]])
    rates = one.unpivot([], one.columns, "metric", "value") if one.columns else None
    out = metrics.select("metric", F.col("value").cast("double").alias("value")).unionByName(roles)
    return out.unionByName(rates) if rates is not None else out


def check_panel(df: DataFrame, keys: list[str], target_columns: list[str], leakage: list[str], grain: tuple[str, str] | None = None) -> None:
    """ValueError naming every rule that the table breaks: empty, repeated keys, null targets, rows of another grain, leakage columns."""
    broken = [f"leakage column {c}" for c in leakage if c in df.columns]
    other = ~F.coalesce(F.col(grain[0]) == grain[1], F.lit(False)) if grain else F.lit(False)
    row = df.agg(F.count("*").alias("n"), F.count_distinct(*keys).alias("k"), F.count_if(other).alias("other"), *[F.count_if(F.col(t).isNull()).alias(f"null_{t}") for t in target_columns]).collect()[0]
    broken += ["no rows"] * (row["n"] == 0) + ["repeated keys"] * (row["n"] != row["k"]) + [f"null {t}" for t in target_columns if row[f"null_{t}"]]
    broken += [f"{row['other']} rows whose {grain[0]} isn't {grain[1]}"] if grain and row["other"] else []
    if broken:
        raise ValueError("; ".join(broken))


def check_copy(source: DataFrame, copy: DataFrame, row_id: str) -> None:
    """ValueError unless copy has source's rows in source's order, told by their ids."""
    a, b = (numbered(df.select(F.col(row_id).alias("_id")), "_at") for df in (source, copy))
    n, m = source.count(), copy.count()
    if n != m:
        raise ValueError(f"the copy has {m} rows of {n}")
    moved = a.join(b.withColumnRenamed("_id", "_other"), "_at").filter(~F.col("_id").eqNullSafe(F.col("_other")))
    if not moved.isEmpty():
        raise ValueError("the copy's rows are in another order")


def manifest(df: DataFrame, roles: list[tuple[str, str]], groups: list[tuple[str, str]], leakage: list[str], reasons: list[tuple[str, str]] | None = None, notes: list[tuple[str, str]] | None = None) -> DataFrame:
    """(column_name, role, feature_group, included, leakage, drop_reason, note, missing_rate); the first rule that matches a name decides.

    A predictor that leaks, or has a drop reason, is not included; why a column is left out is its reason, or that it leaks.
    """
    rows = []
    for c in df.columns:
        role, leak, reason = first_rule(c, roles, "predictor"), int(c in leakage), first_rule(c, reasons or [], "")
        included = int(role != "dropped" and not leak and not reason) if role != "predictor" else int(not leak and not reason)
        why = "" if included else reason or ("tells of the future" if leak else "not in the feature set")
        rows.append((c, role, first_rule(c, groups, "other"), included, leak, why, first_rule(c, notes or [], "kept" if included else "left out")))
    table = df.sparkSession.createDataFrame(rows, "column_name string, role string, feature_group string, included int, leakage int, drop_reason string, note string")
    return table.join(F.broadcast(null_rates(df, df.columns)), "column_name", "left").withColumnRenamed("rate", "missing_rate")
