"""Panel, flag and window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import aggregates, panel
from quillon.plans.registry import Tables, query

YEARS = "SELECT o_custkey AS customer, CAST(year(o_orderdate) AS BIGINT) AS period, sum(o_totalprice) AS views, count(*) AS orders FROM orders GROUP BY 1, 2"
TARGETS = f"""y AS ({YEARS}), w AS (SELECT *, lead(period) OVER g AS next_period, lead(views) OVER g AS nv, lag(views) OVER g AS lag1_views, lag(views, 2) OVER g AS lag2_views
FROM y WINDOW g AS (PARTITION BY customer ORDER BY period)), t AS (SELECT *, CASE WHEN next_period = period + 1 THEN nv END AS next_views FROM w)"""


def years(t: Tables) -> DataFrame:
    """Customer-years with their summed price: one partial and one final aggregate."""
    return t.orders.groupBy(F.col("o_custkey").alias("customer"), F.year("o_orderdate").cast("long").alias("period")).agg(F.sum("o_totalprice").alias("views"), F.count("*").alias("orders"))


@query(f"""WITH {TARGETS} SELECT customer, period, round(views, 6) AS views, next_period, round(next_views, 6) AS next_views, round(lag1_views, 6) AS lag1_views, round(lag2_views, 6) AS lag2_views,
round(next_views - views, 6) AS change_views, round((next_views - views) / nullif(views, 0), 6) AS change_pct_views, CAST(CASE WHEN next_views IS NOT NULL THEN (CASE WHEN next_views > views THEN 1 ELSE 0 END) END AS BIGINT) AS increase_views,
round(views - lag1_views, 6) AS lag_change_views, round((views - lag1_views) / nullif(lag1_views, 0), 6) AS lag_change_pct_views FROM t""")
def panel_targets(t: Tables) -> DataFrame:
    return panel.targets(years(t).drop("orders"), "customer", "period", ["views"])


@query(f"WITH {TARGETS} SELECT customer, period, round(views, 6) AS views, round(next_views, 6) AS next_views FROM t WHERE next_period - period = 1")
def gap_gate(t: Tables) -> DataFrame:
    return panel.with_next_only(panel.targets(years(t).drop("orders"), "customer", "period", ["views"]), "period").select("customer", "period", "views", "next_views")


@query("SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) = 1")
def drop_duplicate_periods(t: Tables) -> DataFrame:
    return panel.drop_repeated_periods(t.orders, "o_custkey", "o_orderdate").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS all_copies, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_copies FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)")
def duplicate_counts(t: Tables) -> DataFrame:
    return aggregates.duplicates(t.orders, ["o_custkey", "o_orderdate"])


@query("SELECT o_orderkey, CAST(coalesce(nullif(o_custkey % 7, 0), nullif(o_orderkey % 5, 0), c_nationkey) AS BIGINT) AS group_key FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def group_key_fallback(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.withColumn("a", F.nullif(F.col("o_custkey") % 7, F.lit(0))).withColumn("b", F.nullif(F.col("o_orderkey") % 5, F.lit(0)))
    return S.filled(S.filled(rows, "a", "b"), "a", "c_nationkey").select("o_orderkey", F.col("a").alias("group_key"))


@query(f"""WITH {TARGETS} SELECT customer, period, CAST(period = 1995 AS BIGINT) AS is_first, CAST(period > 1995 AS BIGINT) AS is_later, CAST(lag1_views IS NULL AS BIGINT) AS missing_lag, CAST(next_views IS NULL AS BIGINT) AS missing_next,
CAST(coalesce(lag1_views < views, false) AS BIGINT) AS grew FROM t""")
def period_flags(t: Tables) -> DataFrame:
    rows = panel.targets(years(t), "customer", "period", ["views"])
    return rows.select("customer", "period", S.flag(F.col("period") == 1995).alias("is_first"), S.flag(F.col("period") > 1995).alias("is_later"), S.missing(F.col("lag1_views")).alias("missing_lag"), S.missing(F.col("next_views")).alias("missing_next"), S.flag(F.col("lag1_views") < F.col("views")).alias("grew"))


@query("""WITH m AS (SELECT CASE WHEN NOT coalesce(o_orderstatus <> 'F', false) THEN 'status' WHEN NOT coalesce(o_totalprice > 100000, false) THEN 'price' WHEN NOT coalesce(nullif(o_custkey % 7, 0) > 2, false) THEN 'key' END AS d FROM orders)
SELECT 'rows_in' AS metric, count(*) AS value FROM m UNION ALL SELECT 'dropped_status', count(*) FILTER (d = 'status') FROM m UNION ALL SELECT 'dropped_price', count(*) FILTER (d = 'price') FROM m
UNION ALL SELECT 'dropped_key', count(*) FILTER (d = 'key') FROM m UNION ALL SELECT 'rows_out', count(*) FILTER (d IS NULL) FROM m""")
def scope_drop_metrics(t: Tables) -> DataFrame:
    return panel.in_scope(t.orders, {"status": "o_orderstatus <> 'F'", "price": "o_totalprice > 100000", "key": "nullif(o_custkey % 7, 0) > 2"})[1]


@query("""SELECT customer, arg_min(y || CASE WHEN h = 1 THEN ' H1' ELSE ' H2' END, y * 2 + h) FILTER (n IS NOT NULL) AS period, round(arg_min(v, y * 2 + h) FILTER (n IS NOT NULL), 6) AS views, CAST(arg_min(n, y * 2 + h) FILTER (n IS NOT NULL) AS BIGINT) AS hours
FROM (SELECT o_custkey AS customer, year(o_orderdate) AS y, CASE WHEN month(o_orderdate) > 6 THEN 2 ELSE 1 END AS h, sum(o_totalprice) AS v, nullif(count(*), 1) AS n FROM orders GROUP BY 1, 2, 3) GROUP BY 1""")
def wide_first_valid(t: Tables) -> DataFrame:
    """The first half-year of all in which a customer has both measures, from a table with two columns for each half-year."""
    half = F.when(F.month("o_orderdate") > 6, "H2").otherwise("H1")
    period = F.concat(F.year("o_orderdate").cast("string"), F.lit(" "), half)
    one = t.orders.groupBy("o_custkey", period.alias("p")).agg(F.sum("o_totalprice").alias("v"), F.nullif(F.count("*"), F.lit(1)).alias("n"))
    ends = t.orders.agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b")).collect()[0]
    names = [f"{y} H{h}" for y in range(ends.a, ends.b + 1) for h in (1, 2)] if ends.a is not None else []
    wide = one.groupBy(F.col("o_custkey").alias("customer")).agg(*[F.max(F.when(F.col("p") == p, F.col(c))).alias(f"{p} {m}") for p in names for c, m in (("v", "Views"), ("n", "Hours"))])
    found = S.wide_periods(wide.columns)
    first = S.first_valid([(f"{y} {h}", F.col(f"`{c['views']}`"), F.col(f"`{c['hours']}`")) for (y, h), c in found.items()])
    return wide.select("customer", first.alias("f")).select("customer", F.col("f.label").alias("period"), F.col("f.a").alias("views"), F.col("f.b").alias("hours"))


@query(f"WITH {TARGETS} SELECT period, count(*) AS n, round(avg(increase), 6) AS rate, round(sum(views), 2) AS total FROM (SELECT *, CASE WHEN next_views IS NOT NULL THEN (CASE WHEN next_views > views THEN 1.0 ELSE 0.0 END) END AS increase FROM t) GROUP BY 1")
def period_rate(t: Tables) -> DataFrame:
    rows = panel.targets(years(t), "customer", "period", ["views"])
    return rows.groupBy("period").agg(F.count("*").alias("n"), F.avg("increase_views").alias("rate"), F.round(F.sum("views"), 2).alias("total"))


@query(f"""WITH {TARGETS} SELECT customer, period, CAST(coalesce(period < lag1p, false) AS BIGINT) AS started_before, CAST(coalesce(period = lag1p + 1, false) AS BIGINT) AS follows, round(ln(1 + views), 6) AS log_views, CAST(2026 - period AS BIGINT) AS age, CAST((lag1_views IS NULL)::INT + (lag2_views IS NULL)::INT AS BIGINT) AS n_missing, CAST(lag2_views IS NULL AS BIGINT) AS missing_lag2
FROM (SELECT *, lag(period) OVER (PARTITION BY customer ORDER BY period) AS lag1p FROM t)""")
def timing_flags(t: Tables) -> DataFrame:
    rows = panel.targets(years(t).withColumn("at", F.col("period")), "customer", "period", ["views", "at"])
    before = F.col("lag1_at")
    return rows.select("customer", "period", S.flag(F.col("period") < before).alias("started_before"), S.flag(F.col("period") == before + 1).alias("follows"), F.log1p("views").alias("log_views"), (2026 - F.col("period")).alias("age"), (S.missing(F.col("lag1_views")) + S.missing(F.col("lag2_views"))).alias("n_missing"), S.missing(F.col("lag2_views")).alias("missing_lag2"))


#: customer-years as series rows: some unmatched, some films, some groups unknown, pairs of customers that share a group
_BASE = """base AS (SELECT o_custkey * 10000 + year(o_orderdate) AS row_id, CASE WHEN o_custkey % 17 <> 0 THEN CASE WHEN o_custkey % 12 = 1 THEN o_custkey - 1 ELSE o_custkey END END AS grp, CAST(year(o_orderdate) - 1990 AS BIGINT) AS period, sum(o_totalprice) AS views, CASE WHEN o_custkey % 10 <> 0 THEN count(*) * 1.5 END AS hours, max(o_totalprice) AS rating,
CASE WHEN o_custkey % 9 <> 0 THEN 1 ELSE 0 END AS matched, CASE WHEN o_custkey % 5 <> 0 THEN 'series_season' ELSE 'movie' END AS kind, CASE WHEN o_custkey % 3 <> 0 THEN year(o_orderdate) END AS ref_year FROM orders GROUP BY o_custkey, year(o_orderdate)),
ok AS (SELECT * FROM base WHERE matched = 1 AND kind = 'series_season' AND grp IS NOT NULL AND period >= 1), strict AS (SELECT * FROM ok QUALIFY count(*) OVER (PARTITION BY grp, period) = 1),
w AS (SELECT *, lag(rating) OVER g AS lag1_rating, lead(period) OVER g AS np, lead(views) OVER g AS nv, lead(hours) OVER g AS nh, lag(views) OVER g AS lag1_views, lag(views, 2) OVER g AS lag2_views, lag(hours) OVER g AS lag1_hours FROM strict WINDOW g AS (PARTITION BY grp ORDER BY period, coalesce(ref_year, 9999), row_id)),
f AS (SELECT *, views IS NOT NULL AND hours IS NOT NULL AS known, coalesce(np = period + 1 AND nv IS NOT NULL AND nh IS NOT NULL, false) AS follows FROM w), final AS (SELECT * FROM f WHERE known AND follows)"""
_METRICS = """SELECT 'rows_in' AS metric, (SELECT count(*) FROM base)::DOUBLE AS value UNION ALL SELECT 'eligible_rows', (SELECT count(*) FROM ok) UNION ALL SELECT 'dropped_repeated_periods', (SELECT count(*) FROM ok) - (SELECT count(*) FROM strict) UNION ALL SELECT 'dropped_missing_measures', (SELECT count(*) FROM f WHERE NOT known)
UNION ALL SELECT 'dropped_missing_target', (SELECT count(*) FROM f WHERE known AND NOT follows) UNION ALL SELECT 'final_rows', (SELECT count(*) FROM final) UNION ALL SELECT 'final_groups', (SELECT count(DISTINCT grp) FROM final)"""
IDENTIFIERS, PREDICTORS = ["row_id", "grp", "period"], ["views", "hours", "rating", "lag1_rating", "lag1_views", "lag2_views", "lag1_hours", "has_lag"]
TARGET_COLUMNS = ["next_views", "next_hours", "change_views", "change_pct_views", "increase_views"]


def _base(t: Tables) -> DataFrame:
    k, year = F.col("o_custkey"), F.year("o_orderdate")
    one = t.orders.groupBy(k, year.alias("y")).agg(F.sum("o_totalprice").alias("views"), F.count("*").alias("n"), F.max("o_totalprice").alias("rating"))
    return one.select(
        (k * 10000 + F.col("y")).alias("row_id"), F.when(k % 17 != 0, F.when(k % 12 == 1, k - 1).otherwise(k)).alias("grp"), (F.col("y") - 1990).cast("long").alias("period"), "views", F.when(k % 10 != 0, F.col("n") * 1.5).alias("hours"), "rating",
        F.when(k % 9 != 0, 1).otherwise(0).alias("matched"), F.when(k % 5 != 0, "series_season").otherwise("movie").alias("kind"), F.when(k % 3 != 0, F.col("y")).alias("ref_year"),
    )


def _modelling(t: Tables) -> tuple[DataFrame, DataFrame]:
    return panel.modelling_rows(_base(t), group="grp", period="period", row_id="row_id", measures=["views", "hours"], lagged=["rating"], eligible="matched = 1 and kind = 'series_season'", year="ref_year")


@query(f"""WITH {_BASE} SELECT row_id, grp, period, round(views, 6) AS views, hours, round(rating, 6) AS rating, round(lag1_rating, 6) AS lag1_rating, round(lag1_views, 6) AS lag1_views, round(lag2_views, 6) AS lag2_views, lag1_hours, CAST(lag1_views IS NOT NULL AS BIGINT) AS has_lag, round(nv, 6) AS next_views, nh AS next_hours, round(nv - views, 6) AS change_views, round((nv - views) / nullif(views, 0), 6) AS change_pct_views, CAST(nv > views AS BIGINT) AS increase_views FROM final""")
def modelling_table(t: Tables) -> DataFrame:
    """Scope, repeated periods, targets, lags and the leakage-safe choice of columns."""
    final = _modelling(t)[0]
    return panel.select_safe(final, IDENTIFIERS, PREDICTORS, TARGET_COLUMNS, ["next_period", "change_hours", "increase_hours"])


@query(f"WITH {_BASE} {_METRICS}")
def modelling_metrics(t: Tables) -> DataFrame:
    return _modelling(t)[1].withColumn("value", F.col("value").cast("double"))


def _manifest(t: Tables) -> DataFrame:
    rows = panel.targets(years(t), "customer", "period", ["views"]).select("customer", "period", "views", "orders", "next_period", "next_views", "lag1_views")
    return panel.manifest(
        rows, [("^(customer|period)$", "identifier"), ("^next_", "target")], [("^lag", "lag"), ("views", "current"), ("period", "timing")], ["next_period", "next_views"],
        [("^orders$", "not used")], [("^next_", "what follows"), ("^(customer|period)$", "kept for grouping and order"), ("^lag", "from earlier rows only")],
    )


@query("""SELECT column_name, role, feature_group, included, leakage, drop_reason, note, round(rate, 6) AS missing_rate FROM (VALUES ('customer', 'identifier', 'other', 1::BIGINT, 0::BIGINT, '', 'kept for grouping and order'), ('period', 'identifier', 'timing', 1, 0, '', 'kept for grouping and order'), ('views', 'predictor', 'current', 1, 0, '', 'kept'), ('orders', 'predictor', 'other', 0, 0, 'not used', 'left out'),
('next_period', 'target', 'timing', 0, 1, 'tells of the future', 'what follows'), ('next_views', 'target', 'current', 0, 1, 'tells of the future', 'what follows'), ('lag1_views', 'predictor', 'lag', 1, 0, '', 'from earlier rows only')) v(column_name, role, feature_group, included, leakage, drop_reason, note) JOIN (WITH """ + TARGETS + """ SELECT * FROM (SELECT avg((customer IS NULL)::INT) AS customer, avg((period IS NULL)::INT) AS period, avg((views IS NULL)::INT) AS views, avg((orders IS NULL)::INT) AS orders,
avg((next_period IS NULL)::INT) AS next_period, avg((next_views IS NULL)::INT) AS next_views, avg((lag1_views IS NULL)::INT) AS lag1_views FROM t) UNPIVOT (rate FOR c IN (customer, period, views, orders, next_period, next_views, lag1_views))) r ON r.c = v.column_name""")
def feature_manifest(t: Tables) -> DataFrame:
    return _manifest(t)


@query(f"""WITH {_BASE} SELECT * FROM ({_METRICS}) UNION ALL SELECT 'columns::identifier', 2 UNION ALL SELECT 'columns::target', 2 UNION ALL SELECT 'columns::predictor', 3 UNION ALL SELECT 'null_rate::lag1_views', round(avg((lag1_views IS NULL)::INT), 6) FROM final UNION ALL SELECT 'null_rate::hours', round(avg((hours IS NULL)::INT), 6) FROM final UNION ALL SELECT 'class_balance::increase_views', round(avg((nv > views)::INT), 6) FROM final""")
def quality_report(t: Tables) -> DataFrame:
    final, metrics = _modelling(t)
    return panel.quality_report(metrics, final, _manifest(t), ["lag1_views", "hours", "absent"], ["increase_views", "absent"])
