"""Aggregate, scalar and join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.functions import titles
from quillon.operators import aggregates, joins, profile, resolve
from quillon.plans.registry import Tables, query


@query("SELECT l_orderkey, count(*) AS seasons, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 1 GROUP BY 1, 2) GROUP BY 1")
def season_counts(t: Tables) -> DataFrame:
    fine = t.lineitem.filter("l_quantity >= 1").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return fine.groupBy("l_orderkey").agg(F.count("*").alias("seasons"), F.sum("n").alias("rows"))


@query("""SELECT o_custkey, round(sum(o_totalprice), 6) AS total, count(DISTINCT o_orderpriority) AS kinds, round(max(o_totalprice), 6) AS greatest, round(min(o_totalprice), 6) AS least, round(avg(o_totalprice), 6) AS mean,
CAST(count(DISTINCT o_orderpriority) = 1 AS BIGINT) AS single, CAST(count(DISTINCT o_orderpriority) > 1 AS BIGINT) AS multi FROM orders GROUP BY 1""")
def group_profile(t: Tables) -> DataFrame:
    kinds = F.countDistinct("o_orderpriority")
    return t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), kinds.alias("kinds"), F.max("o_totalprice").alias("greatest"), F.min("o_totalprice").alias("least"), F.avg("o_totalprice").alias("mean"), S.flag(kinds == 1).alias("single"), S.flag(kinds > 1).alias("multi"))


@query("""SELECT c_nationkey, count(DISTINCT c_name) AS names, count(DISTINCT c_mktsegment) AS segments, CAST(coalesce(bool_or(c_mktsegment = 'BUILDING'), false) AS BIGINT) AS has_building FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) GROUP BY 1""")
def variant_counts(t: Tables) -> DataFrame:
    ids = t.orders.filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    rows = t.customer.join(ids, "c_custkey", "left_semi")
    return rows.groupBy("c_nationkey").agg(F.countDistinct("c_name").alias("names"), F.countDistinct("c_mktsegment").alias("segments"), S.flag(F.bool_or(F.col("c_mktsegment") == "BUILDING")).alias("has_building"))


@query("SELECT p_brand, nullif(string_agg(DISTINCT p_type, ' | ' ORDER BY p_type), '') AS types FROM part GROUP BY 1")
def distinct_concat(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(aggregates.sorted_distinct("p_type").alias("types"))


@query("SELECT l_orderkey, string_agg(s, ' | ' ORDER BY k, s) AS suppliers FROM (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS s, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct_concat(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("s", F.col("l_suppkey").cast("string"))
    return rows.groupBy("l_orderkey").agg(aggregates.ordered_distinct(F.col("l_linenumber"), "s").alias("suppliers"))


@query("""SELECT u.user_id, CAST(coalesce(a, 0) AS BIGINT) AS clicks, CAST(coalesce(b, 0) AS BIGINT) AS purchases, CAST(coalesce(n, 0) AS BIGINT) AS events FROM (SELECT c_custkey AS user_id FROM customer UNION SELECT user_id FROM events WHERE user_id IS NOT NULL) u
LEFT JOIN (SELECT user_id, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'purchase') AS b, count(*) AS n FROM events GROUP BY 1) e USING (user_id)""")
def conditional_counts(t: Tables) -> DataFrame:
    """Events by kind of every customer and every other user, zero where there are none."""
    found = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count("*").alias("events"))
    users = t.customer.select(F.col("c_custkey").alias("user_id")).union(t.events.select("user_id")).filter("user_id is not null").distinct()
    return joins.dense(users, found, "user_id", ["clicks", "purchases", "events"])


@query("""SELECT l_orderkey, string_agg(s, ' | ' ORDER BY rn) AS top FROM (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, l_suppkey) AS rn
FROM (SELECT l_orderkey, l_suppkey, min(coalesce(nullif(l_linenumber, 2), 9999)) AS k FROM lineitem GROUP BY 1, 2)) WHERE rn <= 5 GROUP BY 1""")
def top5_per_group(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("o", F.nullif("l_linenumber", F.lit(2)))
    top = aggregates.top_distinct(rows, ["l_orderkey"], "l_suppkey", "o", 5)
    return top.select("l_orderkey", F.array_join(F.col("items").cast("array<string>"), " | ").alias("top"))


@query("""SELECT l_orderkey, round(avg(b), 6) AS mean_balance FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) LEFT JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS b FROM supplier) ON l_suppkey = s_suppkey GROUP BY 1""")
def ordered_lookup_mean(t: Tables) -> DataFrame:
    """Mean balance of an order's suppliers, of whom a third have none on record."""
    lists = aggregates.top_distinct(t.lineitem, ["l_orderkey"], "l_suppkey", "l_linenumber")
    balance = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("b"))
    found = joins.looked_up(lists, "l_orderkey", "items", balance, "l_suppkey", "b")
    return found.select("l_orderkey", F.aggregate("found", F.lit(0.0), lambda a, x: a + x, lambda a: S.safe_ratio(a, F.size("found"))).alias("mean_balance"))


@query("""SELECT p_partkey, CAST(list_contains(w, 'blue') AS BIGINT) AS has_blue, CAST(list_contains(w, 'green') AS BIGINT) AS has_green, CAST(len(w) AS BIGINT) AS n_tokens, nullif(array_to_string(w, ' | '), '') AS joined
FROM (SELECT p_partkey, list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '') AS w FROM part)""")
def one_hot_tokens(t: Tables) -> DataFrame:
    tokens = S.safe_split(F.col("p_name"), " ")
    return t.part.select("p_partkey", *S.one_hot(tokens, ["blue", "green"], "has_"), F.size(tokens).alias("n_tokens"), F.nullif(F.array_join(tokens, " | "), F.lit("")).alias("joined"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half FROM lineitem")
def rounding_half_even(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", S.half_even(F.col("l_quantity") / 2).alias("half"))


_NORM = "nullif(trim(regexp_replace(regexp_replace(translate(lower({c}), 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), '')"


@query(f"SELECT p_partkey, {_NORM.format(c='n')} AS normalised, nullif(trim(regexp_replace({_NORM.format(c='n')}, '^(the|a|an) ', '')), '') AS canonical, replace(nullif(trim(regexp_replace({_NORM.format(c='n')}, '^(the|a|an) ', '')), ''), ' ', '') AS compact FROM (SELECT p_partkey, concat('The ', p_name, ' & ', p_brand) AS n FROM part)")
def normalised_keys(t: Tables) -> DataFrame:
    c = F.concat(F.lit("The "), F.col("p_name"), F.lit(" & "), F.col("p_brand"))
    return t.part.select("p_partkey", titles.normalised(c).alias("normalised"), titles.canonical(c).alias("canonical"), titles.compact(c).alias("compact"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 9 <> 8 THEN p_name END AS series, CAST(CASE p_partkey % 9 WHEN 0 THEN p_size WHEN 1 THEN p_size % 10 WHEN 2 THEN 1 WHEN 4 THEN p_size WHEN 5 THEN p_size % 10 + 1 WHEN 6 THEN p_size % 50 WHEN 7 THEN NULL END AS BIGINT) AS season,
CASE p_partkey % 9 WHEN 0 THEN 'season' WHEN 1 THEN 'season' WHEN 2 THEN 'limited_series' WHEN 4 THEN 'series' WHEN 5 THEN 'season' WHEN 6 THEN 'season' END AS label, CASE WHEN p_partkey % 9 <> 8 THEN CAST(1990 + p_size % 30 AS BIGINT) END AS year,
CASE p_partkey % 9 WHEN 0 THEN 'season_word' WHEN 1 THEN 's_shorthand' WHEN 2 THEN 'limited_series' WHEN 3 THEN 'unparsed' WHEN 4 THEN 'series_word' WHEN 5 THEN 'trailing_roman_tv_heuristic' WHEN 6 THEN 'trailing_number_tv_heuristic' WHEN 7 THEN 'unparsed' ELSE 'none' END AS method,
CASE p_partkey % 9 WHEN 0 THEN 0.99 WHEN 1 THEN 0.9 WHEN 2 THEN 0.95 WHEN 3 THEN 0.5 WHEN 4 THEN 0.97 WHEN 5 THEN 0.7 WHEN 6 THEN 0.6 WHEN 7 THEN 0.5 ELSE 0 END AS confidence, CASE WHEN p_partkey % 9 IN (5, 6) THEN 'season read from the end of the title' WHEN p_partkey % 9 IN (3, 7) THEN 'no season in the title' WHEN p_partkey % 9 = 8 THEN 'no title' END AS note FROM (SELECT * FROM part)""")
def season_parse(t: Tables) -> DataFrame:
    """Titles in all the ways that the parser knows, for TV kinds and others."""
    k, n, year = F.col("p_partkey") % 9, F.col("p_size"), F.concat(F.lit(" ("), (1990 + F.col("p_size") % 30).cast("string"), F.lit(")"))
    text = lambda *parts: F.concat("p_name", *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    roman = F.element_at(F.array(*[F.lit(r) for r in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")]), (n % 10 + 1).cast("int"))
    title = (
        F.when(k == 0, text(": Season ", n.cast("string"))).when(k == 1, text(" S", (n % 10).cast("string"))).when(k == 2, text(": Limited Series")).when(k == 4, text(" - Series ", n.cast("string")))
        .when(k.isin(5, 7), text(" ", roman)).when(k == 6, text(" ", (n % 50).cast("string"))).otherwise(F.col("p_name"))
    )
    title = F.when(k == 8, F.lit("  ")).when(k == 7, F.col("p_name")).otherwise(title)
    kind = F.when(k.isin(5, 6), "TV Show").otherwise("Movie")
    return t.part.select("p_partkey", titles.parsed(F.when(k == 8, title).otherwise(F.concat(title, year)), kind).alias("x")).select("p_partkey", "x.series", "x.season", "x.label", "x.year", "x.method", "x.confidence", "x.note")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'series' WHEN 1 THEN 'movie' WHEN 2 THEN (CASE WHEN p_size > 10 THEN 'series' ELSE 'unknown' END) ELSE 'unknown' END AS format FROM part")
def format_inference(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, "TV Show").when(k == 1, "Film").when(k == 2, F.lit(None)).otherwise("other")
    return t.part.select("p_partkey", titles.format_of(kind, F.when((k == 2) & (F.col("p_size") > 10), F.lit(1))).alias("format"))


@query("SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN 60 + p_size WHEN 1 THEN 60 + p_size WHEN 2 THEN p_size WHEN 3 THEN p_size END AS BIGINT) AS minutes FROM part")
def runtime_parse(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit("1:"), F.lpad(n, 2, "0"))).when(k == 1, F.concat(F.lit("1h "), n, F.lit("m"))).when(k == 2, n).when(k == 3, F.concat(n, F.lit(" min"))).otherwise(F.lit(""))
    return t.part.select("p_partkey", S.minutes(text).alias("minutes"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE round(l_extendedprice, 2) END AS parsed FROM lineitem")
def number_parse(t: Tables) -> DataFrame:
    text = F.when(F.col("l_linenumber") == 3, F.lit("n/a")).otherwise(F.format_number("l_extendedprice", 2))
    return t.lineitem.select("l_orderkey", "l_linenumber", S.formatted_number(text).alias("parsed"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(year(o_orderdate) AS BIGINT) END AS year FROM orders")
def date_parts(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 9 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    day = S.parsed_date(text)
    return t.orders.select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"), F.year(day).alias("year"))


@query("SELECT c_custkey, n_name, r_name, CAST(n AS BIGINT) AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2 LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_join_chain(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    nation = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    out = t.customer.join(nation, "c_nationkey", "left").join(t.region.filter("r_regionkey <> 2"), "r_regionkey", "left").join(n, "c_custkey", "left")
    return out.select("c_custkey", "n_name", "r_name", "orders")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def outer_to_inner(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.filter(F.col("c_custkey").isNotNull()).select("o_orderkey", "c_name")


@query("""SELECT a.o_orderkey, CAST(b.n AS BIGINT) AS n FROM (SELECT o_orderkey, nullif(o_custkey % 7, 0) AS k, o_orderstatus FROM orders) a
LEFT JOIN (SELECT nullif(o_custkey % 7, 0) AS k, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) b ON a.k IS NOT DISTINCT FROM b.k AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus""")
def null_safe_join(t: Tables) -> DataFrame:
    a = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 7, F.lit(0)).alias("k"), "o_orderstatus")
    b = a.groupBy("k", "o_orderstatus").agg(F.count("*").alias("n"))
    return joins.null_safe(a, b, ["k", "o_orderstatus"]).select("o_orderkey", "n")


@query("""SELECT o_orderkey, l_linenumber, round(total, 6) AS total, round(line, 6) AS line FROM (SELECT o_orderkey, coalesce(nullif(o_orderkey % 4, 0), 1)::INT AS l_linenumber FROM orders) o
LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1) a ON o_orderkey = a.l_orderkey LEFT JOIN (SELECT l_orderkey, l_linenumber AS ln, sum(l_quantity) AS line FROM lineitem GROUP BY 1, 2) b ON o_orderkey = b.l_orderkey AND l_linenumber = ln""")
def two_grain_join(t: Tables) -> DataFrame:
    base = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.coalesce(F.nullif(F.col("o_orderkey") % 4, F.lit(0)), F.lit(1)).cast("int").alias("l_linenumber"))
    coarse, fine = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total")), t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("line"))
    return joins.two_grain(base, coarse, ["l_orderkey"], fine, ["l_orderkey", "l_linenumber"]).withColumnRenamed("l_orderkey", "o_orderkey")


@query("SELECT a.p_name AS name, min(a.p_partkey) AS left_id, arg_min(b.p_partkey, (100 - b.p_size)::BIGINT * 1000000000 + b.p_partkey) AS right_id FROM part a JOIN part b ON a.p_name = b.p_name GROUP BY 1")
def first_row_join(t: Tables) -> DataFrame:
    """Parts with themselves by name: the first in order of keys with the first in order of falling sizes."""
    a = t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("left_id"))
    b = t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("right_id"), ((100 - F.col("p_size")).cast("long") * 1_000_000_000 + F.col("p_partkey")).alias("at"))
    return joins.first_match(a, b, "name", "left_id", "at").drop("at")


@query("""SELECT c_custkey, coalesce(new, c_mktsegment) AS segment, CAST(new IS NOT NULL AS BIGINT) AS updated FROM customer
LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS new FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey""")
def override_update(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    new = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("segment"), "o_orderkey")
    return joins.updated(base, new, "c_custkey", "o_orderkey", ["segment"])


@query("""SELECT DISTINCT p_partkey AS parent, source, kind, key FROM (SELECT p_partkey, source, unnest(['normalised', 'compact']) AS kind, unnest([n, replace(n, ' ', '')]) AS key FROM (SELECT p_partkey, s.source, nullif(trim(regexp_replace(lower(s.c), '[^a-z0-9]+', ' ', 'g')), '') AS n
FROM part, (VALUES ('primary'), ('original'), ('aka')) v(source), LATERAL (SELECT v.source, CASE v.source WHEN 'primary' THEN p_name WHEN 'original' THEN p_type ELSE p_brand END AS c) s)) WHERE trim(key) <> ''""")
def title_keys(t: Tables) -> DataFrame:
    return resolve.title_keys(t.part, "p_partkey", {"primary": "p_name", "original": "p_type", "aka": "p_brand"}, {"normalised": titles.normalised, "compact": lambda c: F.regexp_replace(titles.normalised(c), " ", "")})


@query("SELECT event_type AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def class_balance(t: Tables) -> DataFrame:
    return aggregates.shares(t.events, "event_type")


@query("SELECT round(abs(2 * avg(toxic) - 1), 6) AS gap, CASE WHEN abs(2 * avg(toxic) - 1) < 0.15 THEN 'balanced' ELSE 'imbalanced' END AS label FROM labels")
def balance_label(t: Tables) -> DataFrame:
    return aggregates.balance_label(aggregates.shares(t.labels, "toxic"))


_HOLES = "(SELECT c_custkey, o_orderkey, nullif(c_custkey % 7, 0) AS k, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS a, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS b FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000)"


def _holes(t: Tables) -> DataFrame:
    rows = t.customer.join(t.orders.filter("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", "o_orderkey", F.nullif(F.col("c_custkey") % 7, F.lit(0)).alias("k"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("b"))


_RATES = f"(SELECT unnest(['c_custkey', 'o_orderkey', 'k', 'a', 'b']) AS column_name, unnest([avg((c_custkey IS NULL)::INT), avg((o_orderkey IS NULL)::INT), avg((k IS NULL)::INT), avg((a IS NULL)::INT), avg((b IS NULL)::INT)]) AS rate FROM {_HOLES})"


@query(f"SELECT column_name, round(rate, 6) AS rate FROM {_RATES}")
def missingness(t: Tables) -> DataFrame:
    return aggregates.null_rates(_holes(t), ["c_custkey", "o_orderkey", "k", "a", "b"])


@query(f"SELECT v AS limit, count(*) FILTER (rate > v::DOUBLE) AS n_columns FROM {_RATES}, (VALUES ('0.3'), ('0.5'), ('0.8')) x(v) GROUP BY 1")
def missing_levels(t: Tables) -> DataFrame:
    return aggregates.missing_levels(missingness(t))


@query(f"SELECT g AS \"group\", count(*) AS n_columns, round(avg(rate), 6) AS mean_rate FROM {_RATES} JOIN (VALUES ('ids', 'c_custkey'), ('ids', 'o_orderkey'), ('facts', 'k'), ('facts', 'a'), ('facts', 'b')) x(g, c) ON c = column_name GROUP BY 1")
def grouped_null_rates(t: Tables) -> DataFrame:
    return aggregates.grouped_null_rates(_holes(t), {"ids": ["c_custkey", "o_orderkey"], "facts": ["k", "a", "b", "absent"]})


@query("""WITH f AS (SELECT CAST(p_size > 25 AS INT) AS big, CAST(p_name LIKE '%blue%' AS INT) AS blue, 0 AS never, CASE WHEN p_retailprice > 1000 THEN 1.0 ELSE 0.0 END AS y FROM part), g AS (SELECT * FROM (VALUES ('big'), ('blue'), ('never')) a(flag), (VALUES (0::BIGINT), (1::BIGINT)) b(value))
SELECT g.flag, g.value, CAST(coalesce(n, 0) AS BIGINT) AS n, round(rate, 6) AS rate FROM g LEFT JOIN (SELECT flag, value, count(*) AS n, avg(y) AS rate FROM (SELECT y, unnest(['big', 'blue', 'never']) AS flag, unnest([big, blue, never]) AS value FROM f) GROUP BY 1, 2) r ON g.flag = r.flag AND g.value = r.value""")
def unpivot_flag_rates(t: Tables) -> DataFrame:
    rows = t.part.select(S.flag(F.col("p_size") > 25).alias("big"), S.flag(F.col("p_name").contains("blue")).alias("blue"), F.lit(0).alias("never"), S.flag(F.col("p_retailprice") > 1000).alias("y"))
    return aggregates.flag_rates(rows, ["big", "blue", "never"], "y")


@query("""WITH f AS (SELECT p_size, CASE WHEN p_retailprice > 1000 THEN 1.0 ELSE 0.0 END AS y, p_name FROM part), u AS (SELECT 'blue' AS flag, y FROM f WHERE p_name LIKE '%blue%' UNION ALL SELECT 'size_1', y FROM f WHERE p_size = 1 UNION ALL SELECT 'big', y FROM f WHERE p_size > 25)
SELECT flag, count(*) AS n, round(avg(y), 6) AS rate FROM u GROUP BY 1 HAVING count(*) >= 20""")
def flag_rates_at_least_20(t: Tables) -> DataFrame:
    rows = t.part.select(S.flag(F.col("p_size") > 25).alias("big"), S.flag(F.col("p_name").contains("blue")).alias("blue"), S.flag(F.col("p_size") == 1).alias("size_1"), S.flag(F.col("p_retailprice") > 1000).alias("y"))
    return aggregates.rates_at_least(aggregates.flag_rates(rows, ["big", "blue", "size_1"], "y"))


@query("""SELECT p_size, count(*) AS n, CAST(sum((p_retailprice > 1000)::INT) AS BIGINT) AS positives, round(avg((p_retailprice > 1000)::INT), 6) AS rate, CAST(count(*) < 10 AS BIGINT) AS small FROM part GROUP BY 1""")
def rate_with_small_mark(t: Tables) -> DataFrame:
    return aggregates.rate_by(t.part.withColumn("y", S.flag(F.col("p_retailprice") > 1000)), "p_size", "y")


@query("""WITH a AS (SELECT nullif(o_orderstatus, 'P') AS s, o_orderpriority AS p FROM orders) SELECT x.s AS o_status, y.p AS o_priority, count(a.p) AS n FROM (SELECT DISTINCT s FROM a) x CROSS JOIN (SELECT DISTINCT p FROM a) y
LEFT JOIN a ON a.s IS NOT DISTINCT FROM x.s AND a.p IS NOT DISTINCT FROM y.p GROUP BY 1, 2""")
def contingency(t: Tables) -> DataFrame:
    return aggregates.contingency(t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("o_status"), F.col("o_orderpriority").alias("o_priority")), "o_status", "o_priority")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS median, count(c_acctbal) AS n FROM customer GROUP BY 1")
def group_center(t: Tables) -> DataFrame:
    return profile.centers(t.customer, "c_mktsegment", "c_acctbal")


@query("SELECT p_partkey, CASE WHEN p_retailprice <= 950 THEN 'low' WHEN p_retailprice <= 1100 THEN 'mid' WHEN p_retailprice > 1100 THEN 'high' END AS bin, round(ln(1 + p_retailprice), 6) AS log_price, round(p_retailprice / nullif(p_size % 5, 0), 6) AS ratio FROM part")
def binning_and_ratio(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", S.binned(F.col("p_retailprice"), [950, 1100], ["low", "mid", "high"]).alias("bin"), F.log1p("p_retailprice").alias("log_price"), S.safe_ratio(F.col("p_retailprice"), F.col("p_size") % 5).alias("ratio"))


@query("""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY k ASC NULLS LAST, o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM (SELECT *, nullif(o_custkey % 7, 0) AS k FROM orders)""")
def sorted_nulls_last(t: Tables) -> DataFrame:
    """Places in a global order with nulls last, without one task for all rows."""
    rows = t.orders.withColumn("k", F.nullif(F.col("o_custkey") % 7, F.lit(0)))
    return S.placed(rows, [F.col("k").asc_nulls_last(), F.col("o_totalprice").desc(), F.col("o_orderkey")], "place").select("o_orderkey", "place")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
