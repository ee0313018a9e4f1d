"""Title keys and title parsing. The rules are this engine's own; callers may replace any of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
NOTES = {"none": "no title", "unparsed": "no season in the title", "trailing_roman_tv_heuristic": "season read from the end of the title", "trailing_number_tv_heuristic": "season read from the end of the title"}
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}


def normalised(c: Column) -> Column:
    """Lower case, accents folded, & as and, other signs as spaces; blank gives null."""
    text = F.translate(F.lower(c), ACCENTED, PLAIN)
    text = F.regexp_replace(F.regexp_replace(text, "&", " and "), "[^a-z0-9]+", " ")
    return F.nullif(F.trim(text), F.lit(""))


def canonical(c: Column) -> Column:
    """Normalised, without a leading article and edition words."""
    text = F.regexp_replace(normalised(c), r"^(the|a|an) ", "")
    return F.nullif(F.trim(F.regexp_replace(text, r" (extended|uncut|special|complete) (edition|cut|version)$", "")), F.lit(""))


def compact(c: Column) -> Column:
    return F.regexp_replace(canonical(c), " ", "")


def parsed(title: Column, kind: Column) -> Column:
    """Struct (series, season, label, year, method, confidence, note) of a title; the first rule that fits decides.

    Trailing numbers and roman numerals count as seasons only where kind is a TV kind. Null or blank titles give nulls and 'none'.
    """
    year_at = r"\s*\((\d{4})\)\s*$"
    year = F.regexp_extract(title, year_at, 1).try_cast("int")
    text = F.nullif(F.trim(F.regexp_replace(title, year_at, "")), F.lit(""))
    tv = F.coalesce(F.lower(kind).rlike("tv|series|show"), F.lit(False))
    get = lambda pattern: F.regexp_extract(text, pattern, 2).try_cast("int")
    season, series, limited = r"(?i)^(.*?)[:\s,-]*\bseason\s+(\d+)\b.*$", r"(?i)^(.*?)[:\s,-]*\bseries\s+(\d+)\b.*$", r"(?i)^(.*?)[:\s,-]*\blimited\s+series\b.*$"
    short, roman, number = r"(?i)^(.*?)[:\s,-]*\bs(\d{1,2})$", r"(?i)^(.+?)\s+(i{1,3}|iv|v|vi{1,3}|ix|x)$", r"^(.+?)\s+(\d{1,2})$"
    value = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    row = lambda base, n, label, method, sure: F.struct(base.alias("series"), n.cast("int").alias("season"), F.lit(label).alias("label"), year.alias("year"), F.lit(method).alias("method"), F.lit(sure).alias("confidence"), F.lit(NOTES.get(method)).alias("note"))
    base = lambda pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    return (
        F.when(text.isNull(), row(F.lit(None).cast("string"), F.lit(None), None, "none", 0.0))
        .when(text.rlike(limited), row(base(limited), F.lit(1), "limited_series", "limited_series", 0.95))
        .when(text.rlike(season), row(base(season), get(season), "season", "season_word", 0.99))
        .when(text.rlike(series), row(base(series), get(series), "series", "series_word", 0.97))
        .when(text.rlike(short), row(base(short), get(short), "season", "s_shorthand", 0.9))
        .when(tv & text.rlike(roman), row(base(roman), F.try_element_at(value, F.lower(F.regexp_extract(text, roman, 2))), "season", "trailing_roman_tv_heuristic", 0.7))
        .when(tv & text.rlike(number), row(base(number), get(number), "season", "trailing_number_tv_heuristic", 0.6))
        .otherwise(row(text, F.lit(None), None, "unparsed", 0.5))
    )


def format_of(kind: Column, season: Column) -> Column:
    """series, movie or unknown: the kind's words first, then whether a season is known."""
    text = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(text.rlike("tv|series|show"), "series").when(text.rlike("movie|film"), "movie").when(season.isNotNull(), "series").otherwise("unknown")


def year_consistent(ref: Column, start: Column, end: Column) -> Column:
    """True or False; null if the reference or the start is unknown."""
    return F.when(ref.isNotNull() & start.isNotNull(), (start <= ref) & (ref <= F.coalesce(end, F.lit(9999))))
