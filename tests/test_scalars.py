"""Scalar and title rules on small fixtures with expected rows."""

from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.functions import titles


def values(spark, expression, cells, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_numbers(spark):
    assert values(spark, S.formatted_number, ["1,234,500", "", "\\N", "abc", "2.5", None]) == [1234500.0, None, None, None, 2.5, None]
    assert values(spark, S.nullable_int, ["3", "3.0", "3.5", "x", None]) == [3, 3, None, None, None]
    assert values(spark, S.half_even, [2.5, 3.5, -0.5, None], "double") == [2, 4, 0, None]


def test_minutes(spark):
    assert values(spark, S.minutes, ["1:45", "1h 30m", "45", "", "90 min", "2h", "soon", None]) == [105, 90, 45, None, 90, 120, None, None]


def test_dates(spark):
    assert [str(v) for v in values(spark, S.parsed_date, ["2023-05-01", "soon", None])] == ["2023-05-01", "None", "None"]


def test_lists(spark):
    assert values(spark, lambda c: S.safe_split(c), ["a, b,,\\N, a", "", None]) == [["a", "b", "a"], [], []]
    assert values(spark, lambda c: S.safe_join(S.safe_split(c)), ["a, b,,\\N, a", "", None]) == ["a | b", None, None]


def test_flags_and_ratio(spark):
    assert values(spark, lambda c: S.flag(c > 1), [2, 0, None], "int") == [1, 0, 0]
    assert values(spark, lambda c: S.safe_ratio(F.lit(1.0), c), [2, 0, None], "int") == [0.5, None, None]


def test_binning(spark):
    assert values(spark, lambda c: S.binned(F.abs(c), [0.5, 1], ["a", "b", "c"]), [-0.5, 0.7, 1.0, 1.1, None], "double") == ["a", "b", "b", "c", None]


def test_names():
    assert S.snake("Total Hours Viewed") == "total_hours_viewed"
    assert list(S.wide_periods(["2024 H1 Views", "2023 H2 Views", "2023 H2 Hours", "Title"])) == [(2023, "H2"), (2024, "H1")]
    assert S.first_rule("runtime_gap", [("^a", "x"), ("gap", "y")], "z") == "y"


def test_row_numbers(spark):
    df = S.numbered(spark.range(10).repartition(3).sortWithinPartitions("id"))
    assert sorted(r.row_id for r in df.collect()) == list(range(1, 11))


def test_titles(spark):
    rows = [
        ("Dark: Season 3", "TV", "Dark", 3, "season", "season_word"), ("Dark S2", "TV", "Dark", 2, "season", "s_shorthand"), ("Maid: Limited Series (2011)", "TV", "Maid", 1, "limited_series", "limited_series"),
        ("Rocky II", "TV show", "Rocky", 2, "season", "trailing_roman_tv_heuristic"), ("Rocky II", "Movie", "Rocky II", None, None, "unparsed"), ("Fauda 4", "TV", "Fauda", 4, "season", "trailing_number_tv_heuristic"),
        ("Fauda 4", "Movie", "Fauda 4", None, None, "unparsed"), ("Luther: Series 5", None, "Luther", 5, "series", "series_word"), ("  ", "TV", None, None, None, "none"), (None, None, None, None, None, "none"),
    ]
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, t string, k string").select("i", titles.parsed(F.col("t"), F.col("k")).alias("p"), F.col("p.year"))
    got = [(r.p.series, r.p.season, r.p.label, r.p.method) for r in df.orderBy("i").collect()]
    assert got == [r[2:] for r in rows]
    assert df.filter("i = 2").collect()[0].year == 2011


def test_keys(spark):
    assert values(spark, titles.normalised, ["Élite & Co.", "  ", None]) == ["elite and co", None, None]
    assert values(spark, titles.canonical, ["The Élite: Extended Edition", "A"]) == ["elite", "a"]
    assert values(spark, titles.compact, ["The Long Way"]) == ["longway"]
