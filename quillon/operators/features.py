"""Reference features of entities: keys, one-hot genres, episode, alias and credit aggregates, half-year measures, merged features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.functions.titles import normalised
from quillon.operators import aggregates, joins

#: The genres that have a flag, the kinds of series and of films, the year that ages are counted to.
GENRES = ["Drama", "Comedy", "Action", "Thriller", "Crime", "Romance", "Animation", "Documentary", "Fantasy", "Horror", "Sci-Fi", "Family"]
SERIES, FILMS = ("tvSeries", "tvMiniSeries"), ("movie", "tvMovie")
THIS_YEAR = 2026
#: The public tables that an entity's features come from; series also have the episode table, third.
SOURCES, EPISODES = ["title.basics", "title.ratings", "title.akas", "title.crew", "title.principals", "name.basics"], "title.episode"
CATEGORIES = {"actor": "n_actor", "actress": "n_actress", "self": "n_self", "producer": "n_producer", "writer": "n_writer_credits", "director": "n_director_credits"}


def entity_id(kind: str, resolved: str, parent: str) -> Column:
    """A movie's resolved id; of other and unknown kinds the parent, else the resolved one."""
    return F.when(F.coalesce(F.col(kind) == "movie", F.lit(False)), F.col(resolved)).otherwise(F.coalesce(parent, resolved))


def keys(matched: DataFrame) -> DataFrame:
    """(row_id, entity_id, entity_type, parent_id, season) of matched rows (row_id, entity_type, resolved, parent, season); only series have a parent."""
    series = F.coalesce(F.col("entity_type").isin("series_parent", "series_season"), F.lit(False))
    return matched.select("row_id", entity_id("entity_type", "resolved", "parent").alias("entity_id"), "entity_type", F.when(series, F.col("parent")).alias("parent_id"), S.nullable_int(F.col("season")).alias("season"))


def id_sets(entity_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity ids, ids of series parents), distinct, trimmed and known."""
    one = lambda c: entity_keys.select(F.trim(F.col(c).cast("string")).alias("entity_id")).filter("entity_id is not null").distinct()
    return one("entity_id"), one("parent_id")


def semi(df: DataFrame, ids: DataFrame, key: str, id_: str = "entity_id") -> DataFrame:
    """Rows of a large scan whose key is among ids. The join's kind is left to the planner, which knows the size of ids."""
    return df.join(ids.select(F.col(id_).alias(key)).distinct(), key, "left_semi")


def genre_flags(genres: Column) -> dict[str, Column]:
    """One flag for each of GENRES by exact name, how many genres there are, and three flags of convenience; no genres give 0."""
    has = {f"genre_{S.snake(g)}": S.flag(F.array_contains(genres, g)) for g in GENRES}
    family = S.flag(F.array_contains(genres, "Animation") | F.array_contains(genres, "Family"))
    return {"genre_count": F.size(genres)} | has | {"is_animation": has["genre_animation"], "is_documentary": has["genre_documentary"], "is_kids_family_like": family}


def entities(basics: DataFrame, ratings: DataFrame, ids: DataFrame) -> DataFrame:
    """Basics of the wanted entities with ratings, genre flags and whole numbers for years, runtime and votes."""
    flags = genre_flags(S.safe_split(F.col("genres")))
    rows = semi(basics, ids, "tconst").join(ratings.select("tconst", "averageRating", "numVotes"), "tconst", "left")
    whole = {c: S.nullable_int(F.col(c)) for c in ("startYear", "endYear", "numVotes")} | {"runtimeMinutes": S.half_even(S.number(F.col("runtimeMinutes")))}
    return rows.select(F.col("tconst").alias("entity_id"), "titleType", "primaryTitle", "originalTitle", *[whole[c].alias(c) for c in ("startYear", "endYear", "runtimeMinutes")], "genres", "averageRating", whole["numVotes"].alias("numVotes"), *[c.alias(n) for n, c in flags.items()])


def episodes(episode: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by parent, by (parent, season)); seasons are rounded to even after the test of at least 1."""
    rows = semi(episode, ids, "parentTconst").withColumn("_s", S.number(F.col("seasonNumber"))).filter("_s >= 1").withColumn("season", S.half_even(F.col("_s")))
    fine = rows.groupBy(F.col("parentTconst").alias("parent"), "season").agg(F.count("*").alias("episodes"))
    coarse = fine.groupBy("parent").agg(
        F.sum("episodes").alias("total_episodes"), F.count("season").alias("n_seasons"), F.max("season").alias("last_season"), F.avg("episodes").alias("mean_episodes"),
        F.min("episodes").alias("min_episodes"), F.max("episodes").alias("max_episodes"), S.flag(F.count("season") == 1).alias("single_season"), S.flag(F.count("season") > 1).alias("multi_season"),
    )
    return coarse, fine


def aliases(akas: DataFrame, ids: DataFrame) -> DataFrame:
    rows = semi(akas, ids, "titleId").groupBy(F.col("titleId").alias("entity_id"))
    out = rows.agg(F.countDistinct("title").alias("n_titles"), F.countDistinct("region").alias("n_regions"), F.countDistinct("language").alias("n_languages"), F.coalesce(F.bool_or(F.col("region") == "US"), F.lit(False)).cast("int").alias("has_us"))
    return out.withColumn("international", (F.col("n_regions") > 1).cast("int"))


def people(lists: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """(entity_id, and of each list of person ids `items`: names in list order, mean birth year, mean known-for count, sorted professions).

    Persons that the table of names lacks, and values that they lack, are left out of what they would be part of; a person named twice
    in a list counts twice. One join on persons serves all of them.
    """
    known = names.select(
        F.col("nconst").alias("_p"), F.nullif("primaryName", F.lit("")).alias("_name"), S.number(F.col("birthYear")).alias("_born"), S.safe_split(F.col("primaryProfession")).alias("_jobs"), F.size(S.safe_split(F.col("knownForTitles"))).alias("_known"),
    )
    rows = lists.select("entity_id", F.posexplode("items").alias("_at", "_p")).join(known, "_p", "left")
    shown = F.transform(F.array_sort(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_at", "_name")))), lambda x: x["_name"])
    jobs = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_jobs"))))
    return rows.groupBy("entity_id").agg(
        S.safe_join(shown).alias(f"{name}_names"), F.avg("_born").alias(f"{name}_mean_birth_year"), F.avg("_known").alias(f"{name}_known_for_count"), S.safe_join(jobs).alias(f"{name}_profession_mix"),
    )


def crew_features(crew: DataFrame, names: DataFrame, ids: DataFrame) -> DataFrame:
    """For every entity the number, ids, names and mean birth year of directors and of writers; 0 and null where there are none."""
    rows = semi(crew, ids, "tconst").select(F.col("tconst").alias("entity_id"), *[S.safe_split(F.col(f"{c}s")).alias(c) for c in ("director", "writer")])
    out = ids.select("entity_id").distinct().join(rows, "entity_id", "left")
    wide = out.select("entity_id", *[x for c in ("director", "writer") for x in (F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}s"), S.safe_join(F.col(c)).alias(f"{c}_ids"))])
    for c in ("director", "writer"):
        found = people(rows.select("entity_id", F.col(c).alias("items")), names, c)
        wide = wide.join(found.select("entity_id", f"{c}_names", f"{c}_mean_birth_year"), "entity_id", "left")
    return wide.withColumns({f"n_{c}s": F.when(F.col(f"n_{c}s") > 0, F.col(f"n_{c}s")).otherwise(0) for c in ("director", "writer")})


def cast_features(principals: DataFrame, names: DataFrame, ids: DataFrame, k: int = 5) -> DataFrame:
    """For every entity its credits by category and the first k cast members by billing: ids, names, number, mean birth year,
    mean known-for count and professions; 0 and null where there are none."""
    rows = semi(principals, ids, "tconst")
    counts = rows.groupBy(F.col("tconst").alias("entity_id")).agg(F.count("*").alias("n_principals"), *[F.count_if(F.col("category") == c).alias(n) for c, n in CATEGORIES.items()])
    billed = rows.filter(F.col("category").isin("actor", "actress", "self")).withColumn("_o", S.number(F.col("ordering")).cast("int"))
    cast = aggregates.top_distinct(billed, ["tconst"], "nconst", "_o", k).withColumnRenamed("tconst", "entity_id")
    found = people(cast, names, "top_cast")
    cast = cast.select("entity_id", S.safe_join(F.col("items")).alias("top_cast_ids"), F.size("items").alias("top_cast_count_used"))
    wide = ids.select("entity_id").distinct()
    for part in (counts, cast, found):
        wide = wide.join(part, "entity_id", "left")
    return wide.fillna(0, ["n_principals", "top_cast_count_used", *CATEGORIES.values()])


def half_years(views: DataFrame, hours: DataFrame, title: str, order: str | None = None) -> DataFrame:
    """(title_key, period, views, hours, hours_per_view) of the first half-year with both measures, for each normalised title.

    Of rows with one title the first counts: by the column `order`, or without one in file order. ValueError if the files share no
    period or lack the title.
    """
    if title not in views.columns or title not in hours.columns:
        raise ValueError(f"both files need the column {title}")
    a, b = S.wide_periods(views.columns), S.wide_periods(hours.columns)
    both = [p for p in a if p in b and "views" in a[p] and "hours" in b[p]]
    if not both:
        raise ValueError("no half-year has both views and hours")
    numbered = lambda df, name: df.withColumn(name, F.col(order)) if order else S.numbered(df, name)
    side = lambda df, name, found, kind, mark: numbered(df, name).select(normalised(F.col(title)).alias("title_key"), name, *[S.formatted_number(F.col(f"`{found[p][kind]}`").cast("string")).alias(f"{mark}{i}") for i, p in enumerate(both)])
    left, right = side(views, "_vo", a, "views", "v"), side(hours, "_ho", b, "hours", "h")
    first = S.first_valid([(f"{y} {h}", F.col(f"v{i}"), F.col(f"h{i}")) for i, (y, h) in enumerate(both)])
    rows = joins.first_match(left, right, "title_key", "_vo", "_ho").withColumn("f", first)
    return rows.select("title_key", F.col("f.label").alias("period"), F.col("f.a").alias("views"), F.col("f.b").alias("hours"), S.safe_ratio(F.col("f.b"), F.col("f.a")).alias("hours_per_view"))


def sources_used(entity_type: Column) -> Column:
    """The tables that a row's features come from, as text."""
    with_episodes = [*SOURCES[:2], EPISODES, *SOURCES[2:]]
    return F.when(F.coalesce(entity_type.isin("series_parent", "series_season"), F.lit(False)), "|".join(with_episodes)).otherwise("|".join(SOURCES))


def enrichment_note(entity_type: Column) -> Column:
    return F.when(entity_type == "movie", "features of the matched film").when(entity_type == "series_parent", "features of the series, without a season").when(entity_type == "series_season", "features of the series and episodes of the season").otherwise("features of the entity")


def merged(matched: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """matched with all feature tables: entity, aliases, crew and cast by entity id, half-years by title key, episodes by parent and by (parent, season).

    matched: row_id, entity_type, resolved, parent, season, title and whatever it knows already; what it knows wins over a feature of the
    same name. Keys meet the rows by row_id, every feature table has one row for a key, so rows neither multiply nor go.
    """
    out = matched.join(keys(matched).select("row_id", "entity_id"), "row_id", "left")
    for name in ("entities", "aliases", "crew", "cast"):
        out = _filled(out, parts[name], "entity_id")
    out = _filled(out.withColumn("title_key", normalised(F.trim("title"))), parts["half_years"].withColumnsRenamed({c: f"first_halfyear_{c}" for c in ("period", "views", "hours", "hours_per_view")}), "title_key").drop("title_key")
    out = _filled(out, parts["episodes"].withColumnRenamed("parent", "entity_id"), "entity_id")
    seasons = parts["season_episodes"].select(F.col("parent").alias("_e"), F.col("season").alias("_s"), F.col("episodes").alias("season_episodes"))
    return out.join(seasons, (F.col("entity_id") == F.col("_e")) & (F.col("season") == F.col("_s")), "left").drop("_e", "_s")


def _filled(base: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """base with part's columns by key; columns that both have keep base's value and are filled by part's."""
    twice = [c for c in part.columns if c in base.columns and c != key]
    out = base.join(part.withColumnsRenamed({c: f"_f_{c}" for c in twice}), key, "left")
    for c in twice:
        out = S.filled(out, c, f"_f_{c}")
    return out


def derived(df: DataFrame, year: int = THIS_YEAR) -> DataFrame:
    """log votes, their product with the rating, age, years active, gaps of year and runtime, life-cycle flags, sources and note; unknown conditions are 0.

    df: the merged table with reference_year and runtime of the row itself, if it has them.
    """
    votes, series = F.log1p(S.number(F.col("numVotes"))), F.col("titleType").isin(*SERIES)
    own = lambda c: S.number_or_null(df, c)
    return df.withColumns({
        "log_votes": votes, "rating_votes": S.number(F.col("averageRating")) * votes, "is_movie": S.flag(F.col("titleType").isin(*FILMS)), "is_series": S.flag(series), "is_miniseries": S.flag(F.col("titleType") == "tvMiniSeries"),
        "is_ended": S.flag(series & (F.col("endYear") < year)), "is_ongoing": S.flag(series & (F.col("endYear").isNull() | (F.col("endYear") >= year))),
        "age": F.lit(year) - F.col("startYear"), "years_active": F.coalesce(F.col("endYear"), F.lit(year)) - F.col("startYear") + 1,
        "year_gap": own("reference_year") - F.col("startYear"), "runtime_gap": own("runtime") - F.col("runtimeMinutes"), "enriched": F.lit(1), "sources_used": sources_used(F.col("entity_type")), "enrichment_note": enrichment_note(F.col("entity_type")),
    })


def check_enriched(before: DataFrame, matched: DataFrame, after: DataFrame, key: str, added: list[str]) -> dict[str, float]:
    """Counts of rows, matched rows and their share; ValueError naming what a merge broke.

    before: all rows; matched: those that were to be enriched, with before's columns and all of them matched; after: the result, with
    matched's rows, each key once, and the added columns.
    """
    lost = [c for c in [*matched.columns, *added] if c not in after.columns]
    broken = [f"no column {c}" for c in lost] + ["columns that differ from the input's"] * (set(before.columns) != set(matched.columns))
    total, n = before.count(), matched.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("matched") == 1, F.lit(False))).alias("open")).collect()[0]
    m = after.agg(F.count("*").alias("n"), F.countDistinct(key).alias("k"), F.count_if(F.col(key).isNull()).alias("null")).collect()[0]
    broken += [f"{m.n} rows of {n.n}"] * (n.n != m.n) + ["repeated keys"] * (m.n != m.k + m.null) + [f"{n.open} rows that aren't matched"] * (n.open > 0)
    if broken:
        raise ValueError("; ".join(broken))
    return {"total_rows": total, "matched_rows": n.n, "unmatched_rows": total - n.n, "matched_percent": 100.0 * n.n / total if total else 0.0}
