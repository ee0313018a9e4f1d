"""Feature tables over stand-ins: parts as titles, line items as episodes, aliases and credits, suppliers as persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import aggregates, features
from quillon.plans.registry import Tables, query

_GENRES = ["Drama", "Comedy", "Action", "Thriller", "Crime", "Romance", "Animation", "Documentary", "Fantasy", "Horror", "Sci-Fi", "Family", "Adventure", "Western"]
_LIST = "['" + "', '".join(_GENRES) + "']"
_MATCHED = """matched AS (SELECT p_partkey AS row_id, CASE p_partkey % 5 WHEN 0 THEN 'movie' WHEN 1 THEN 'series_parent' WHEN 4 THEN NULL ELSE 'series_season' END AS entity_type, CASE WHEN p_partkey % 7 <> 0 THEN 't' || (p_partkey + 1) END AS resolved, CASE WHEN p_partkey % 11 <> 0 THEN 't' || (p_partkey + 2) END AS parent,
CASE WHEN p_partkey % 3 <> 0 THEN p_size % 7 + 1 END AS season, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 2000 + p_size END AS reference_year, CASE WHEN p_partkey % 4 <> 0 THEN 40 + p_size END AS runtime, CASE WHEN p_partkey % 6 = 0 THEN 1970 + p_size END AS "startYear", 1 AS matched FROM part),
keys AS (SELECT row_id, CASE WHEN entity_type = 'movie' THEN resolved ELSE coalesce(parent, resolved) END AS entity_id, entity_type, CASE WHEN entity_type IN ('series_parent', 'series_season') THEN parent END AS parent_id, season FROM matched), ids AS (SELECT DISTINCT entity_id FROM keys WHERE entity_id IS NOT NULL),
pids AS (SELECT DISTINCT parent_id AS entity_id FROM keys WHERE parent_id IS NOT NULL)"""
_BASICS = f"""basics AS (SELECT 't' || p_partkey AS tconst, CASE p_partkey % 4 WHEN 0 THEN 'movie' WHEN 1 THEN 'tvSeries' WHEN 2 THEN 'tvMiniSeries' ELSE 'short' END AS titleType, p_name AS primaryTitle, p_type AS originalTitle, 1980 + p_size AS startYear, CASE WHEN p_partkey % 3 = 0 THEN 2000 + p_size END AS endYear, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size + 0.5 END AS runtime,
CASE WHEN p_partkey % 9 <> 0 THEN {_LIST}[p_size % 14 + 1] || ',' || {_LIST}[p_partkey % 14 + 1] END AS genres FROM part),
ratings AS (SELECT 't' || l_partkey AS tconst, avg(l_quantity) AS averageRating, count(*) AS numVotes FROM lineitem WHERE l_partkey % 4 <> 1 GROUP BY 1),
entities AS (SELECT tconst AS entity_id, titleType, primaryTitle, originalTitle, startYear, endYear, CAST(round_even(runtime, 0) AS BIGINT) AS runtimeMinutes, genres, averageRating, numVotes, g, len(g) AS genre_count FROM (SELECT *, CASE WHEN genres IS NULL THEN [] ELSE string_split(genres, ',') END AS g FROM basics) LEFT JOIN ratings USING (tconst) WHERE tconst IN (SELECT entity_id FROM ids))"""
_FLAGS = ", ".join(f"CAST(list_contains(g, '{g}') AS BIGINT) AS genre_{g.lower().replace('-', '_')}" for g in features.GENRES) + ", CAST(list_contains(g, 'Animation') AS BIGINT) AS is_animation, CAST(list_contains(g, 'Documentary') AS BIGINT) AS is_documentary, CAST(list_contains(g, 'Animation') OR list_contains(g, 'Family') AS BIGINT) AS is_kids_family_like"
_EPISODES = """fine AS (SELECT 't' || l_partkey AS parent, CAST(s AS BIGINT) AS season, count(*) AS episodes FROM (SELECT l_partkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber - 1 END AS s FROM lineitem) WHERE s >= 1 AND 't' || l_partkey IN (SELECT entity_id FROM pids) GROUP BY 1, 2),
coarse AS (SELECT parent, CAST(sum(episodes) AS BIGINT) AS total_episodes, count(*) AS n_seasons, max(season) AS last_season, avg(episodes) AS mean_episodes, min(episodes) AS min_episodes, max(episodes) AS max_episodes, CAST(count(*) = 1 AS BIGINT) AS single_season, CAST(count(*) > 1 AS BIGINT) AS multi_season FROM fine GROUP BY 1)"""
_AKAS = """akas AS (SELECT 't' || l_partkey AS titleId, CASE WHEN l_linenumber <> 4 THEN 'title ' || (l_suppkey % 5) END AS title, CASE l_returnflag WHEN 'A' THEN 'US' WHEN 'N' THEN 'DE' END AS region, nullif(l_linestatus, 'O') AS language FROM lineitem),
aliases AS (SELECT titleId AS entity_id, count(DISTINCT title) AS n_titles, count(DISTINCT region) AS n_regions, count(DISTINCT language) AS n_languages, CAST(coalesce(bool_or(region = 'US'), false) AS BIGINT) AS has_us, CAST(count(DISTINCT region) > 1 AS BIGINT) AS international FROM akas WHERE titleId IN (SELECT entity_id FROM ids) GROUP BY 1)"""
_PEOPLE = """names AS (SELECT 'n' || s_suppkey AS nconst, CASE WHEN s_suppkey % 8 <> 0 THEN s_name END AS primaryName, CASE WHEN s_suppkey % 3 <> 0 THEN 1930 + s_suppkey % 70 END AS birthYear, ['actor,producer', 'writer', 'director,writer', NULL][s_suppkey % 4 + 1] AS jobs, s_suppkey % 5 AS known FROM supplier WHERE s_suppkey % 9 <> 0),
crewlists AS (SELECT 't' || p_partkey AS entity_id, CASE p_partkey % 6 WHEN 0 THEN [] WHEN 1 THEN ['n' || (p_partkey % 97)] ELSE ['n' || (p_partkey % 97), 'n' || (p_size % 97), 'n' || (p_partkey % 53)] END AS director, CASE p_partkey % 4 WHEN 0 THEN [] ELSE ['n' || (p_size % 89), 'n' || (p_partkey % 31)] END AS writer FROM part)"""
_CREW = f"""{_PEOPLE}, cl AS (SELECT ids.entity_id, coalesce(director, []) AS director, coalesce(writer, []) AS writer FROM ids LEFT JOIN crewlists USING (entity_id)),
dd AS (SELECT entity_id, i, nconst, primaryName, birthYear FROM (SELECT entity_id, unnest(director) AS nconst, generate_subscripts(director, 1) AS i FROM cl) LEFT JOIN names USING (nconst)), ww AS (SELECT entity_id, i, nconst, primaryName, birthYear FROM (SELECT entity_id, unnest(writer) AS nconst, generate_subscripts(writer, 1) AS i FROM cl) LEFT JOIN names USING (nconst)),
d1 AS (SELECT entity_id, string_agg(v, ' | ' ORDER BY k) AS x FROM (SELECT entity_id, nconst AS v, min(i) AS k FROM dd GROUP BY 1, 2) GROUP BY 1), d2 AS (SELECT entity_id, string_agg(v, ' | ' ORDER BY k) AS x FROM (SELECT entity_id, primaryName AS v, min(i) AS k FROM dd WHERE primaryName IS NOT NULL GROUP BY 1, 2) GROUP BY 1), d3 AS (SELECT entity_id, avg(birthYear) AS x FROM dd GROUP BY 1),
w1 AS (SELECT entity_id, string_agg(v, ' | ' ORDER BY k) AS x FROM (SELECT entity_id, nconst AS v, min(i) AS k FROM ww GROUP BY 1, 2) GROUP BY 1), w2 AS (SELECT entity_id, string_agg(v, ' | ' ORDER BY k) AS x FROM (SELECT entity_id, primaryName AS v, min(i) AS k FROM ww WHERE primaryName IS NOT NULL GROUP BY 1, 2) GROUP BY 1), w3 AS (SELECT entity_id, avg(birthYear) AS x FROM ww GROUP BY 1),
crew AS (SELECT cl.entity_id, CAST(len(director) AS BIGINT) AS n_directors, d1.x AS director_ids, CAST(len(writer) AS BIGINT) AS n_writers, w1.x AS writer_ids, d2.x AS director_names, d3.x AS director_mean_birth_year, w2.x AS writer_names, w3.x AS writer_mean_birth_year FROM cl LEFT JOIN d1 USING (entity_id) LEFT JOIN d2 USING (entity_id) LEFT JOIN d3 USING (entity_id) LEFT JOIN w1 USING (entity_id) LEFT JOIN w2 USING (entity_id) LEFT JOIN w3 USING (entity_id))"""
_CAST = """principals AS (SELECT 't' || l_partkey AS tconst, nullif(l_linenumber, 3) AS ordering, CASE WHEN l_suppkey % 13 <> 0 THEN 'n' || l_suppkey END AS nconst, ['actor', 'actress', 'self', 'producer', 'writer', 'director', 'editor', NULL][l_orderkey % 8 + 1] AS category FROM lineitem WHERE 't' || l_partkey IN (SELECT entity_id FROM ids)),
pc AS (SELECT tconst AS entity_id, count(*) AS n_principals, count(*) FILTER (category = 'actor') AS n_actor, count(*) FILTER (category = 'actress') AS n_actress, count(*) FILTER (category = 'self') AS n_self, count(*) FILTER (category = 'producer') AS n_producer, count(*) FILTER (category = 'writer') AS n_writer_credits, count(*) FILTER (category = 'director') AS n_director_credits FROM principals GROUP BY 1),
top AS (SELECT tconst AS entity_id, nconst, row_number() OVER (PARTITION BY tconst ORDER BY k, nconst) AS i FROM (SELECT tconst, nconst, min(coalesce(ordering, 9999)) AS k FROM principals WHERE category IN ('actor', 'actress', 'self') AND nconst IS NOT NULL GROUP BY 1, 2) QUALIFY i <= 5), tp AS (SELECT * FROM top LEFT JOIN names USING (nconst)),
t1 AS (SELECT entity_id, string_agg(nconst, ' | ' ORDER BY i) AS ids, count(*) AS n, avg(birthYear) AS born, avg(known) AS known FROM tp GROUP BY 1), t2 AS (SELECT entity_id, string_agg(v, ' | ' ORDER BY k) AS x FROM (SELECT entity_id, primaryName AS v, min(i) AS k FROM tp WHERE primaryName IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
t3 AS (SELECT entity_id, string_agg(DISTINCT j, ' | ' ORDER BY j) AS x FROM (SELECT entity_id, unnest(string_split(jobs, ',')) AS j FROM tp) GROUP BY 1),
casts AS (SELECT ids.entity_id, coalesce(n_principals, 0) AS n_principals, coalesce(n_actor, 0) AS n_actor, coalesce(n_actress, 0) AS n_actress, coalesce(n_self, 0) AS n_self, coalesce(n_producer, 0) AS n_producer, coalesce(n_writer_credits, 0) AS n_writer_credits, coalesce(n_director_credits, 0) AS n_director_credits,
t1.ids AS top_cast_ids, coalesce(t1.n, 0) AS top_cast_count_used, t2.x AS top_cast_names, born AS top_cast_mean_birth_year, known AS top_cast_known_for_count, t3.x AS top_cast_profession_mix FROM ids LEFT JOIN pc USING (entity_id) LEFT JOIN t1 USING (entity_id) LEFT JOIN t2 USING (entity_id) LEFT JOIN t3 USING (entity_id))"""
_HALF = """hv AS (SELECT p_partkey, lower(trim(p_name)) AS title_key, CASE WHEN p_size % 3 <> 0 THEN p_size * 1000 END AS v1, p_size * 10 AS v2, CASE WHEN p_size % 4 <> 0 THEN p_size * 7 END AS h1, CASE WHEN p_size % 5 <> 0 THEN p_size * 3 END AS h2 FROM part),
halfyears AS (SELECT title_key, CASE WHEN v1 IS NOT NULL AND h1 IS NOT NULL THEN '2023 H1' WHEN h2 IS NOT NULL THEN '2023 H2' END AS period, CASE WHEN v1 IS NOT NULL AND h1 IS NOT NULL THEN v1::DOUBLE WHEN h2 IS NOT NULL THEN v2::DOUBLE END AS views, CASE WHEN v1 IS NOT NULL AND h1 IS NOT NULL THEN h1::DOUBLE WHEN h2 IS NOT NULL THEN h2::DOUBLE END AS hours
FROM (SELECT a.title_key, a.v1, a.v2, b.h1, b.h2 FROM hv a JOIN hv b ON a.title_key = b.title_key QUALIFY row_number() OVER (PARTITION BY a.title_key ORDER BY a.p_partkey, b.p_partkey) = 1))"""


def _matched(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 5 == 0, "movie").when(k % 5 == 1, "series_parent").when(k % 5 != 4, "series_season")
    tag = lambda plus: F.concat(F.lit("t"), (k + plus).cast("string"))
    return t.part.select(
        k.alias("row_id"), kind.alias("entity_type"), F.when(k % 7 != 0, tag(1)).alias("resolved"), F.when(k % 11 != 0, tag(2)).alias("parent"), F.when(k % 3 != 0, n % 7 + 1).cast("long").alias("season"), F.col("p_name").alias("title"),
        F.when(k % 2 == 0, 2000 + n).alias("reference_year"), F.when(k % 4 != 0, 40 + n).alias("runtime"), F.when(k % 6 == 0, 1970 + n).cast("long").alias("startYear"), F.lit(1).alias("matched"),
    )


def _ids(t: Tables) -> tuple[DataFrame, DataFrame]:
    return features.id_sets(features.keys(_matched(t)))


def _basics(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    genre = lambda c: F.element_at(F.array(*[F.lit(g) for g in _GENRES]), (c % 14 + 1).cast("int"))
    return t.part.select(
        F.concat(F.lit("t"), k.cast("string")).alias("tconst"), F.when(k % 4 == 0, "movie").when(k % 4 == 1, "tvSeries").when(k % 4 == 2, "tvMiniSeries").otherwise("short").alias("titleType"), F.col("p_name").alias("primaryTitle"), F.col("p_type").alias("originalTitle"), (1980 + n).cast("string").alias("startYear"),
        F.when(k % 3 == 0, (2000 + n).cast("string")).alias("endYear"), F.when(k % 8 == 0, "n/a").otherwise(F.concat(n.cast("string"), F.lit(".5"))).alias("runtimeMinutes"), F.when(k % 9 != 0, F.concat(genre(n), F.lit(", "), genre(k))).alias("genres"),
    )


def _part_id():
    return F.concat(F.lit("t"), F.col("l_partkey").cast("string"))


def _entities(t: Tables) -> DataFrame:
    ratings = t.lineitem.filter("l_partkey % 4 <> 1").groupBy(_part_id().alias("tconst")).agg(F.avg("l_quantity").alias("averageRating"), F.count("*").alias("numVotes"))
    return features.entities(_basics(t), ratings, _ids(t)[0])


def _episodes(t: Tables) -> tuple[DataFrame, DataFrame]:
    episode = t.lineitem.select(_part_id().alias("parentTconst"), F.when(F.col("l_linenumber") != 7, (F.col("l_linenumber") - 1).cast("string")).alias("seasonNumber"))
    return features.episodes(episode, _ids(t)[1])


def _aliases(t: Tables) -> DataFrame:
    akas = t.lineitem.select(
        _part_id().alias("titleId"), F.when(F.col("l_linenumber") != 4, F.concat(F.lit("title "), (F.col("l_suppkey") % 5).cast("string"))).alias("title"), F.when(F.col("l_returnflag") == "A", "US").when(F.col("l_returnflag") == "N", "DE").alias("region"), F.nullif("l_linestatus", F.lit("O")).alias("language"),
    )
    return features.aliases(akas, _ids(t)[0])


def _names(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    known = F.when(k % 5 > 0, F.array_join(F.transform(F.sequence(F.lit(1), (k % 5).cast("int")), lambda i: F.concat(F.lit("t"), i.cast("string"))), ","))
    return t.supplier.filter("s_suppkey % 9 <> 0").select(
        F.concat(F.lit("n"), k.cast("string")).alias("nconst"), F.when(k % 8 != 0, F.col("s_name")).alias("primaryName"), F.when(k % 3 != 0, (1930 + k % 70).cast("string")).alias("birthYear"),
        F.element_at(F.array(F.lit("actor,producer"), F.lit("writer"), F.lit("director,writer"), F.lit(None)), (k % 4 + 1).cast("int")).alias("primaryProfession"), known.alias("knownForTitles"),
    )


def _crew(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    person = lambda c, m: F.concat(F.lit("n"), (c % m).cast("string"))
    directors = F.when(k % 6 == 1, person(k, 97)).when(k % 6 != 0, F.concat_ws(",", person(k, 97), person(n, 97), person(k, 53)))
    writers = F.when(k % 4 != 0, F.concat_ws(",", person(n, 89), person(k, 31)))
    crew = t.part.select(F.concat(F.lit("t"), k.cast("string")).alias("tconst"), directors.alias("directors"), writers.alias("writers"))
    return features.crew_features(crew, _names(t), _ids(t)[0])


def _cast(t: Tables) -> DataFrame:
    kinds = F.array(*[F.lit(c) for c in ("actor", "actress", "self", "producer", "writer", "director", "editor", None)])
    principals = t.lineitem.select(
        _part_id().alias("tconst"), F.nullif("l_linenumber", F.lit(3)).alias("ordering"), F.when(F.col("l_suppkey") % 13 != 0, F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))).alias("nconst"), F.element_at(kinds, (F.col("l_orderkey") % 8 + 1).cast("int")).alias("category"),
    )
    return features.cast_features(principals, _names(t), _ids(t)[0])


def _half_years(t: Tables) -> DataFrame:
    n = F.col("p_size")
    views = t.part.select(F.col("p_name").alias("Title"), "p_partkey", F.when(n % 3 != 0, F.format_number(n * 1000, 0)).alias("2023 H1 Views"), (n * 10).cast("string").alias("2023 H2 Views"))
    hours = t.part.select(F.col("p_name").alias("Title"), "p_partkey", F.when(n % 4 != 0, (n * 7).cast("string")).alias("2023 H1 Hours"), F.when(n % 5 != 0, (n * 3).cast("string")).alias("2023 H2 Hours"))
    return features.half_years(views, hours, "Title", "p_partkey")


@query(f"WITH {_MATCHED} SELECT row_id, entity_id, entity_type, parent_id, CAST(season AS BIGINT) AS season FROM keys")
def entity_keys(t: Tables) -> DataFrame:
    return features.keys(_matched(t))


@query(f"WITH {_MATCHED}, {_BASICS} SELECT entity_id, titleType AS \"titleType\", primaryTitle AS \"primaryTitle\", originalTitle AS \"originalTitle\", CAST(startYear AS BIGINT) AS \"startYear\", CAST(endYear AS BIGINT) AS \"endYear\", runtimeMinutes AS \"runtimeMinutes\", replace(genres, ',', ', ') AS genres, round(averageRating, 6) AS \"averageRating\", numVotes AS \"numVotes\", CAST(genre_count AS BIGINT) AS genre_count, {_FLAGS} FROM entities")
def entity_features(t: Tables) -> DataFrame:
    return _entities(t)


@query(f"WITH {_MATCHED}, {_EPISODES} SELECT parent, total_episodes, n_seasons, last_season, round(mean_episodes, 6) AS mean_episodes, min_episodes, max_episodes, single_season, multi_season FROM coarse")
def episode_features(t: Tables) -> DataFrame:
    return _episodes(t)[0]


@query(f"WITH {_MATCHED}, {_EPISODES} SELECT * FROM fine")
def season_episodes(t: Tables) -> DataFrame:
    return _episodes(t)[1]


@query(f"WITH {_MATCHED}, {_AKAS} SELECT * FROM aliases")
def alias_features(t: Tables) -> DataFrame:
    return _aliases(t)


@query(f"WITH {_MATCHED}, {_CREW} SELECT * REPLACE (round(director_mean_birth_year, 6) AS director_mean_birth_year, round(writer_mean_birth_year, 6) AS writer_mean_birth_year) FROM crew")
def crew_features(t: Tables) -> DataFrame:
    return _crew(t)


@query(f"WITH {_MATCHED}, {_PEOPLE}, {_CAST} SELECT * REPLACE (round(top_cast_mean_birth_year, 6) AS top_cast_mean_birth_year, round(top_cast_known_for_count, 6) AS top_cast_known_for_count) FROM casts")
def cast_features(t: Tables) -> DataFrame:
    return _cast(t)


@query(f"WITH {_HALF} SELECT title_key, period, views, hours, round(hours / nullif(views, 0), 6) AS hours_per_view FROM halfyears")
def half_year_features(t: Tables) -> DataFrame:
    return _half_years(t)


def _merged(t: Tables) -> DataFrame:
    coarse, fine = _episodes(t)
    parts = {"entities": _entities(t), "aliases": _aliases(t), "crew": _crew(t), "cast": _cast(t), "half_years": _half_years(t), "episodes": coarse, "season_episodes": fine}
    return features.derived(features.merged(_matched(t), parts))


_MERGED = f"""{_MATCHED}, {_BASICS}, {_EPISODES}, {_AKAS}, {_CREW}, {_CAST}, {_HALF}, m AS (SELECT m.*, k.entity_id, e.titleType, e.endYear, coalesce(m."startYear", e.startYear) AS sy, e.runtimeMinutes, e.averageRating, e.numVotes, e.genre_count, a.n_titles, c.n_directors, c.director_names, x.n_principals, x.top_cast_names, h.period, h.views, p.total_episodes, f.episodes AS season_episodes
FROM matched m LEFT JOIN keys k ON m.row_id = k.row_id LEFT JOIN entities e ON k.entity_id = e.entity_id LEFT JOIN aliases a ON k.entity_id = a.entity_id LEFT JOIN crew c ON k.entity_id = c.entity_id LEFT JOIN casts x ON k.entity_id = x.entity_id LEFT JOIN halfyears h ON lower(trim(m.title)) = h.title_key LEFT JOIN coarse p ON k.entity_id = p.parent LEFT JOIN fine f ON k.entity_id = f.parent AND m.season = f.season)"""


@query(f"""WITH {_MERGED} SELECT row_id, entity_id, entity_type, CAST(season AS BIGINT) AS season, CAST(sy AS BIGINT) AS "startYear", titleType AS "titleType", runtimeMinutes AS "runtimeMinutes", round(averageRating, 6) AS "averageRating", numVotes AS "numVotes", CAST(genre_count AS BIGINT) AS genre_count, n_titles, n_directors, director_names, n_principals, top_cast_names,
period AS first_halfyear_period, views AS first_halfyear_views, total_episodes, season_episodes, round(ln(1 + numVotes), 6) AS log_votes, round(averageRating * ln(1 + numVotes), 6) AS rating_votes, CAST(coalesce(titleType IN ('movie', 'tvMovie'), false) AS BIGINT) AS is_movie, CAST(coalesce(titleType IN ('tvSeries', 'tvMiniSeries'), false) AS BIGINT) AS is_series, CAST(coalesce(titleType = 'tvMiniSeries', false) AS BIGINT) AS is_miniseries,
CAST(coalesce(titleType IN ('tvSeries', 'tvMiniSeries') AND endYear < 2026, false) AS BIGINT) AS is_ended, CAST(coalesce(titleType IN ('tvSeries', 'tvMiniSeries') AND (endYear IS NULL OR endYear >= 2026), false) AS BIGINT) AS is_ongoing, CAST(2026 - sy AS BIGINT) AS age, CAST(coalesce(endYear, 2026) - sy + 1 AS BIGINT) AS years_active, (reference_year - sy)::DOUBLE AS year_gap, (runtime - runtimeMinutes)::DOUBLE AS runtime_gap,
CASE WHEN entity_type IN ('series_parent', 'series_season') THEN 'title.basics|title.ratings|title.episode|title.akas|title.crew|title.principals|name.basics' ELSE 'title.basics|title.ratings|title.akas|title.crew|title.principals|name.basics' END AS sources_used,
CASE entity_type WHEN 'movie' THEN 'features of the matched film' WHEN 'series_parent' THEN 'features of the series, without a season' WHEN 'series_season' THEN 'features of the series and episodes of the season' ELSE 'features of the entity' END AS enrichment_note FROM m""")
def enriched_table(t: Tables) -> DataFrame:
    """All feature tables merged into the matched rows, with derived fields."""
    shown = ["row_id", "entity_id", "entity_type", "season", "startYear", "titleType", "runtimeMinutes", "averageRating", "numVotes", "genre_count", "n_titles", "n_directors", "director_names", "n_principals", "top_cast_names", "first_halfyear_period", "first_halfyear_views", "total_episodes", "season_episodes",
             "log_votes", "rating_votes", "is_movie", "is_series", "is_miniseries", "is_ended", "is_ongoing", "age", "years_active", "year_gap", "runtime_gap", "sources_used", "enrichment_note"]
    return _merged(t).select(*shown)


@query(f"""WITH {_MERGED} SELECT 'entity' AS "group", 3 AS n_columns, round((avg((titleType IS NULL)::INT) + avg((sy IS NULL)::INT) + avg((runtimeMinutes IS NULL)::INT)) / 3, 6) AS mean_rate FROM m UNION ALL SELECT 'episodes', 2, round((avg((total_episodes IS NULL)::INT) + avg((season_episodes IS NULL)::INT)) / 2, 6) FROM m UNION ALL SELECT 'halfyear', 1, round(avg((views IS NULL)::INT), 6) FROM m""")
def enrichment_null_rates(t: Tables) -> DataFrame:
    groups = {"entity": ["titleType", "startYear", "runtimeMinutes"], "episodes": ["total_episodes", "season_episodes", "absent"], "halfyear": ["first_halfyear_views"]}
    return aggregates.grouped_null_rates(_merged(t), groups)


@query("WITH " + _MATCHED + " SELECT 'total_rows' AS metric, count(*)::DOUBLE AS value FROM matched UNION ALL SELECT 'matched_rows', count(*)::DOUBLE FROM matched UNION ALL SELECT 'unmatched_rows', 0 UNION ALL SELECT 'matched_percent', 100")
def enrichment_check(t: Tables) -> DataFrame:
    """The checks that the merged table must pass, and its counts."""
    matched = _matched(t)
    facts = features.check_enriched(matched, matched, _merged(t), "row_id", ["log_votes", "sources_used"])
    return t.spark.createDataFrame([(k, float(v)) for k, v in facts.items()], "metric string, value double")
