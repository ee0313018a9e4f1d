"""Scalar expressions with explicit null and rounding rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def snake(name: str) -> str:
    """`Total Hours Viewed` -> total_hours_viewed."""
    return re.sub(r"[^0-9a-z]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip()).lower()).strip("_")


def standardised(df: DataFrame) -> DataFrame:
    return df.toDF(*map(snake, df.columns))


def first_existing(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


_IN_PARTITION = (1 << 33) - 1


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Row ids 1..n in file order: the place within a row's partition plus the rows of all partitions before.

    Two passes, a count of each partition and the numbering; no row leaves its partition. The reader must give the same partitions
    twice, as file sources do.
    """
    marked = df.withColumn("__at", F.monotonically_increasing_id())
    return _counted_up(marked, name)


def placed(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """df with its place 1..n in a total order: ranges of the order are sorted by themselves, then counted up."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).persist()
    return _counted_up(ranged, name)


def _counted_up(marked: DataFrame, name: str) -> DataFrame:
    at = F.col("__at")
    counts = sorted(tuple(r) for r in marked.groupBy(F.shiftright(at, 33).alias("p")).count().collect())
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    table = marked.sparkSession.createDataFrame(starts, "__p long, __start long")
    rows = marked.join(F.broadcast(table), F.shiftright(at, 33) == F.col("__p"))
    return rows.withColumn(name, F.col("__start") + at.bitwiseAND(F.lit(_IN_PARTITION)) + 1).drop("__at", "__p", "__start")


def not_blank(c: Column) -> Column:
    return F.trim(c) != ""


def number(c: Column) -> Column:
    """Invalid text becomes null."""
    return F.expr("try_cast(_x as double)") if c is None else c.cast("string").try_cast("double")


def number_or_null(df: DataFrame, name: str) -> Column:
    return number(F.col(name)) if name in df.columns else F.lit(None).cast("double")


def formatted_number(c: Column) -> Column:
    """`1,234,500` -> 1234500.0; text without a number becomes null."""
    return F.regexp_replace(c, "[,\\s]", "").try_cast("double")


def half_even(c: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.bround(c, 0).cast("long")


def nullable_int(c: Column) -> Column:
    """Whole numbers only; fractions and other text become null."""
    value = c.cast("string").try_cast("double")
    return F.when(value == F.floor(value), value.cast("long"))


def parsed_date(c: Column, form: str = "yyyy-MM-dd") -> Column:
    return F.to_date(F.try_to_timestamp(c, F.lit(form)))


def minutes(c: Column) -> Column:
    """`1:45`, `1h 30m`, `45` -> minutes; anything else is null."""
    text = F.lower(F.trim(c))
    part = lambda pattern, k: F.regexp_extract(text, pattern, k).try_cast("int")
    clock, words = r"^(\d+):(\d{1,2})(?::\d{1,2})?$", r"^(?:(\d+)\s*h(?:ours?|rs?)?)?\s*(?:(\d+)\s*m(?:in(?:utes?|s)?)?)?$"
    return (
        F.when(text.rlike(clock), part(clock, 1) * 60 + part(clock, 2))
        .when(text.rlike(r"^\d+$"), text.try_cast("int"))
        .when(text.rlike(words) & (text != ""), F.coalesce(part(words, 1), F.lit(0)) * 60 + F.coalesce(part(words, 2), F.lit(0)))
    )


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0))


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def missing(c: Column) -> Column:
    return c.isNull().cast("int")


def safe_split(c: Column, sep: str = ",") -> Column:
    """Trimmed parts without empty ones and \\N; null gives an empty list."""
    parts = F.transform(F.split(c, re.escape(sep)), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: (x != "") & (x != "\\N")), F.array().cast("array<string>"))


def safe_join(c: Column, sep: str = " | ") -> Column:
    """Distinct parts in order of appearance; an empty list gives null."""
    return F.nullif(F.array_join(F.array_distinct(c), sep), F.lit(""))


def one_hot(tokens: Column, names: list[str], prefix: str) -> list[Column]:
    return [flag(F.array_contains(tokens, n)).alias(f"{prefix}{snake(n)}") for n in names]


def filled(base: DataFrame, name: str, feature: str) -> DataFrame:
    """Base values win and the feature fills; the feature column goes. Without a base column the feature becomes it."""
    value = F.coalesce(name, feature) if name in base.columns else F.col(feature)
    return base.withColumn(name, value).drop(feature)


def binned(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins (-inf, e0], (e0, e1], ..., (last, inf)."""
    out = F.when(c <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        out = out.when(c <= edge, label)
    return out.when(c > edges[-1], labels[-1])


def wide_periods(columns: list[str], pattern: str = r"^(\d{4})\s+(H[12])\s+(Views|Hours)$") -> dict[tuple[int, str], dict[str, str]]:
    """Columns of repeated half-years: (year, half) -> measure -> column, in order of time."""
    found: dict[tuple[int, str], dict[str, str]] = {}
    for c in columns:
        if m := re.match(pattern, c):
            found.setdefault((int(m[1]), m[2]), {})[m[3].lower()] = c
    return dict(sorted(found.items()))


def first_valid(periods: list[tuple[str, Column, Column]]) -> Column:
    """Struct (label, a, b) of the earliest period in which both measures are known."""
    out = None
    for label, a, b in periods:
        both, value = a.isNotNull() & b.isNotNull(), F.struct(F.lit(label).alias("label"), a.alias("a"), b.alias("b"))
        out = F.when(both, value) if out is None else out.when(both, value)
    return out


def first_rule(name: str, rules: list[tuple[str, str]], default: str) -> str:
    """The result of the first pattern that the column name matches."""
    return next((result for pattern, result in rules if re.search(pattern, name)), default)
