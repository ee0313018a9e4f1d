"""Profile and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import models, panel, profile
from quillon.plans import panel_queries
from quillon.plans.registry import Tables, query

LINE = ["l_quantity", "l_extendedprice", "l_discount"]
_UNPIVOT = "(SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS column_name, unnest([l_quantity, l_extendedprice, l_discount]) AS x, l_tax AS y FROM lineitem)"


@query(f"""SELECT column_name, count(x) AS n, count(DISTINCT x) AS n_distinct, round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 3) AS q1,
round(quantile_cont(x, 0.5), 3) AS median, round(quantile_cont(x, 0.75), 3) AS q3, round(max(x), 6) AS max FROM {_UNPIVOT} GROUP BY 1""")
def describe_numeric(t: Tables) -> DataFrame:
    return profile.described(t.lineitem, LINE).withColumns({c: F.round(c, 3) for c in ("mean", "std", "q1", "median", "q3")})


@query(f"SELECT column_name, round(s, 6) AS skew, CASE WHEN abs(s) <= 0.5 THEN 'symmetric' WHEN abs(s) <= 1 THEN 'moderate' ELSE 'high' END AS label FROM (SELECT column_name, skewness(x) AS s FROM {_UNPIVOT} GROUP BY 1)")
def skewness_table(t: Tables) -> DataFrame:
    return profile.skewness_table(t.lineitem, LINE)


@query("""WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT least(floor((l_extendedprice - lo) * 30 / (hi - lo)) + 1, 30)::BIGINT AS bin FROM lineitem, e)
SELECT g.bin, count(b.bin) AS n FROM (SELECT unnest(range(1, 31)) AS bin) g LEFT JOIN b ON g.bin = b.bin GROUP BY 1""")
def histogram30(t: Tables) -> DataFrame:
    return profile.histogram(t.lineitem, "l_extendedprice", 30)


@query(f"""SELECT column_name, round(p, 6) AS pearson, round(s, 6) AS spearman, round(greatest(abs(p), abs(s)), 6) AS max_abs FROM (SELECT column_name, corr(x, y) AS p, corr(rx, ry) AS s FROM (SELECT column_name, x, y,
rank() OVER (PARTITION BY column_name ORDER BY x) + (count(*) OVER (PARTITION BY column_name, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY column_name ORDER BY y) + (count(*) OVER (PARTITION BY column_name, y) - 1) / 2.0 AS ry FROM {_UNPIVOT}) GROUP BY 1)""")
def corr_to_target(t: Tables) -> DataFrame:
    return profile.correlations(t.lineitem, LINE, "l_tax")


_MONEY = "(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS revenue, CASE WHEN l_linenumber <> 3 THEN l_extendedprice * (1 - l_discount) * (1 + l_tax) END AS charge FROM lineitem)"


def _money(t: Tables) -> DataFrame:
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select("l_quantity", "l_extendedprice", revenue.alias("revenue"), F.when(F.col("l_linenumber") != 3, revenue * (1 + F.col("l_tax"))).alias("charge"))


@query(f"""WITH m AS {_MONEY} SELECT * FROM (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM m UNION ALL SELECT 'l_quantity', 'revenue', round(corr(l_quantity, revenue), 6) FROM m UNION ALL SELECT 'l_quantity', 'charge', round(corr(l_quantity, charge), 6) FROM m
UNION ALL SELECT 'l_extendedprice', 'revenue', round(corr(l_extendedprice, revenue), 6) FROM m UNION ALL SELECT 'l_extendedprice', 'charge', round(corr(l_extendedprice, charge), 6) FROM m UNION ALL SELECT 'revenue', 'charge', round(corr(revenue, charge), 6) FROM m) WHERE abs(r) >= 0.9""")
def high_corr_pairs(t: Tables) -> DataFrame:
    return profile.pair_correlations(_money(t), ["l_quantity", "l_extendedprice", "revenue", "charge"], 0.9)


@query(f"""WITH m AS {_MONEY}, x AS (SELECT l_extendedprice AS x, charge AS y FROM m WHERE charge IS NOT NULL), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM x),
x2 AS (SELECT l_quantity AS x, revenue AS y FROM m), k2 AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM x2)
SELECT 'l_extendedprice' AS a, 'charge' AS b, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k UNION ALL SELECT 'l_quantity', 'revenue', round(corr(x, y), 6), round(corr(rx, ry), 6) FROM k2""")
def two_column_correlations(t: Tables) -> DataFrame:
    return profile.two_column(_money(t), [("l_extendedprice", "charge"), ("l_quantity", "revenue")])


_KINDS = "(SELECT o_orderstatus, CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END AS priority FROM orders)"


@query(f"""WITH v AS (SELECT column_name, v, count(*) AS f FROM (SELECT unnest(['o_orderstatus', 'priority']) AS column_name, unnest([o_orderstatus, priority]) AS v FROM {_KINDS}) WHERE v IS NOT NULL GROUP BY 1, 2), p AS (SELECT o_totalprice AS x FROM orders)
SELECT 'o_totalprice' AS column_name, count(x) AS n, count(DISTINCT x) AS n_distinct, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS max, NULL AS top, NULL::BIGINT AS freq FROM p
UNION ALL SELECT column_name, CAST(sum(f) AS BIGINT), count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, arg_min(v, struct_pack(a := -f, b := v)), max(f) FROM v GROUP BY 1""")
def describe_all(t: Tables) -> DataFrame:
    rows = t.orders.select("o_totalprice", "o_orderstatus", F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"))
    return profile.described_all(rows, ["o_totalprice"], ["o_orderstatus", "priority"]).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query("""SELECT 'rows' AS metric, 'all' AS name, count(*) AS value FROM customer UNION ALL SELECT 'columns', 'all', 5 UNION ALL SELECT 'type', 'bigint', 1 UNION ALL SELECT 'type', 'int', 1 UNION ALL SELECT 'type', 'string', 2 UNION ALL SELECT 'type', 'double', 1 UNION ALL SELECT 'role', 'identifier', 2 UNION ALL SELECT 'role', 'predictor', 3""")
def shape_table(t: Tables) -> DataFrame:
    return profile.shape(t.customer, {"c_custkey": "identifier", "c_name": "identifier", "c_nationkey": "predictor", "c_acctbal": "predictor", "c_mktsegment": "predictor"})


@query("""SELECT unnest(['c_custkey', 'c_nationkey']) AS column_name, unnest([count(c_custkey), count(c_nationkey)]) AS n, unnest([count(DISTINCT c_custkey), count(DISTINCT c_nationkey)]) AS n_distinct, unnest([CAST(count(c_custkey) = count(DISTINCT c_custkey) AS BIGINT), CAST(count(c_nationkey) = count(DISTINCT c_nationkey) AS BIGINT)]) AS "unique" FROM customer""")
def identifier_table(t: Tables) -> DataFrame:
    return profile.identifiers(t.customer, ["c_custkey", "c_nationkey"])


@query("SELECT l_quantity AS x, round(nullif(l_discount, 0), 6) AS y, l_returnflag AS by FROM lineitem WHERE l_quantity IS NOT NULL AND nullif(l_discount, 0) IS NOT NULL")
def scatter_points(t: Tables) -> DataFrame:
    return profile.scatter(t.lineitem.withColumn("d", F.nullif("l_discount", F.lit(0.0))), "l_quantity", "d", "l_returnflag")


_WIDE = "(SELECT l_quantity, l_extendedprice, CASE WHEN l_linenumber <> 2 THEN l_discount END AS discount, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)"
_LONG = f"(SELECT unnest(['l_quantity', 'l_extendedprice', 'discount']) AS column_name, unnest([l_quantity, l_extendedprice, discount]) AS x, revenue AS y FROM {_WIDE})"


def _wide(t: Tables) -> DataFrame:
    return t.lineitem.select("l_quantity", "l_extendedprice", F.when(F.col("l_linenumber") != 2, F.col("l_discount")).alias("discount"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query(f"""WITH c AS (SELECT column_name, corr(x, y) AS p, corr(rx, ry) AS s FROM (SELECT column_name, x, y, rank() OVER (PARTITION BY column_name ORDER BY x) + (count(*) OVER (PARTITION BY column_name, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY column_name ORDER BY y) + (count(*) OVER (PARTITION BY column_name, y) - 1) / 2.0 AS ry FROM {_LONG} WHERE x IS NOT NULL) GROUP BY 1)
SELECT l.column_name, round(avg((x IS NULL)::INT), 6) AS missing_rate, round(avg(x), 3) AS mean, round(quantile_cont(x, 0.5), 3) AS median, round(stddev_samp(x), 3) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(skewness(x), 6) AS skew, round(any_value(p), 6) AS pearson, round(any_value(s), 6) AS spearman FROM {_LONG} l JOIN c ON l.column_name = c.column_name GROUP BY 1""")
def numeric_profile(t: Tables) -> DataFrame:
    return profile.numeric_profile(_wide(t), ["l_quantity", "l_extendedprice", "discount"], "revenue").withColumns({c: F.round(c, 3) for c in ("mean", "median", "std")})


_FEATURES = "(SELECT l_extendedprice, CASE WHEN l_linenumber = 1 THEN l_quantity END AS sparse, 1 AS one, CASE WHEN l_orderkey % 100 = 0 THEN 1 ELSE 0 END AS rare, l_returnflag, CASE WHEN l_linenumber <= 3 THEN l_discount END AS half, CASE WHEN l_orderkey % 10 = 0 THEN l_tax END AS mostly, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem)"
_QUALITY = f"""q AS (SELECT unnest(['l_extendedprice', 'sparse', 'one', 'rare', 'l_returnflag', 'half', 'mostly']) AS column_name, unnest([l_extendedprice::VARCHAR, sparse::VARCHAR, one::VARCHAR, rare::VARCHAR, l_returnflag, half::VARCHAR, mostly::VARCHAR]) AS v FROM {_FEATURES}),
c AS (SELECT column_name, v, count(*) AS n FROM q GROUP BY 1, 2), a AS (SELECT column_name, coalesce(sum(n) FILTER (v IS NULL), 0) / sum(n) AS missing_rate, count(v) AS n_distinct, max(n) / sum(n) AS top FROM c GROUP BY 1),
l AS (SELECT unnest(['l_extendedprice', 'sparse', 'one', 'rare', 'half', 'mostly']) AS column_name, unnest([l_extendedprice, sparse, one, rare, half, mostly]) AS x, revenue AS y FROM {_FEATURES}), k AS (SELECT column_name, x, y, rank() OVER (PARTITION BY column_name ORDER BY x) + (count(*) OVER (PARTITION BY column_name, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY column_name ORDER BY y) + (count(*) OVER (PARTITION BY column_name, y) - 1) / 2.0 AS ry FROM l WHERE x IS NOT NULL),
m AS (SELECT column_name, CASE WHEN count(DISTINCT x) > 1 THEN greatest(abs(corr(x, y)), abs(corr(rx, ry))) END AS max_abs, CASE WHEN count(DISTINCT x) > 1 THEN skewness(x) ELSE 0 END AS skew FROM k GROUP BY 1),
f AS (SELECT a.column_name, missing_rate, n_distinct, (n_distinct <= 1)::BIGINT AS constant, (n_distinct <= 5 AND top >= 0.95)::BIGINT AS near_constant, skew, max_abs FROM a LEFT JOIN m USING (column_name))"""


def _quality(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_extendedprice", F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).alias("sparse"), F.lit(1).alias("one"), F.when(F.col("l_orderkey") % 100 == 0, 1).otherwise(0).alias("rare"), "l_returnflag", F.when(F.col("l_linenumber") <= 3, F.col("l_discount")).alias("half"),
        F.when(F.col("l_orderkey") % 10 == 0, F.col("l_tax")).alias("mostly"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )
    return profile.feature_quality(rows, ["l_extendedprice", "sparse", "one", "rare", "l_returnflag", "half", "mostly"], "revenue")


@query(f"WITH {_QUALITY} SELECT column_name, round(missing_rate, 6) AS missing_rate, n_distinct, constant, near_constant, round(skew, 6) AS skew, round(max_abs, 6) AS max_abs FROM f")
def feature_quality(t: Tables) -> DataFrame:
    return _quality(t)


@query(f"""WITH {_QUALITY}, g AS (SELECT *, constant = 1 OR missing_rate > 0.8 AS gone FROM f) SELECT 'exclude' AS list, column_name FROM g WHERE gone UNION ALL SELECT 'investigate', column_name FROM g WHERE NOT gone AND (near_constant = 1 OR missing_rate > 0.5)
UNION ALL SELECT * FROM (SELECT 'useful', column_name FROM g WHERE NOT gone AND max_abs > 0.05 ORDER BY max_abs DESC, column_name LIMIT 15)""")
def selection_lists(t: Tables) -> DataFrame:
    return profile.selection(_quality(t))


@query("""WITH y AS (SELECT o_custkey, year(o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), n AS (SELECT a.o_custkey AS customer, CAST(a.p AS BIGINT) AS period, b.v / a.v AS r FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND b.p = a.p + 1 WHERE a.v > 0)
SELECT customer, period, round(r, 6) AS retention, CAST(r < 0.7 AS BIGINT) AS low_retention FROM n""")
def retention_label(t: Tables) -> DataFrame:
    return _retention(t).select("customer", "period", "retention", "low_retention")


def _retention(t: Tables) -> DataFrame:
    rows = panel.targets(panel_queries.years(t), "customer", "period", ["views"])
    return models.with_retention(models.cohort(rows, "next_views is not null and views > 0", ["views", "orders"]), "views", "next_views")


_RETENTION = "y AS (SELECT o_custkey, year(o_orderdate) AS p, sum(o_totalprice) AS v, count(*) AS o FROM orders GROUP BY 1, 2), n AS (SELECT a.o_custkey AS customer, a.p, a.v, a.o, b.v / a.v AS r, CAST(b.v / a.v < 0.7 AS BIGINT) AS low FROM y a JOIN y b ON a.o_custkey = b.o_custkey AND b.p = a.p + 1 WHERE a.v > 0)"


@query(f"WITH {_RETENTION} SELECT unnest(['1.0', '2.0']) AS limit, unnest([count(*) FILTER (r > 1), count(*) FILTER (r > 2)]) AS n FROM n")
def retention_above(t: Tables) -> DataFrame:
    return models.above(_retention(t), "retention")


@query(f"""WITH {_RETENTION}, h AS (SELECT *, (customer * 7919) % 100003 AS place FROM n), k AS (SELECT *, rank() OVER (PARTITION BY low ORDER BY place) - 1 AS before, count(*) OVER (PARTITION BY low) AS size FROM h)
SELECT low AS label, CAST(before < 0.3 * size AS BIGINT) AS test, count(*) AS n, CAST(sum(customer) AS BIGINT) AS keys FROM k GROUP BY 1, 2""")
def stratified_split(t: Tables) -> DataFrame:
    train, test = models.split_stratified(_retention(t), "customer", "low_retention")
    count = lambda df, k: df.groupBy(F.col("low_retention").alias("label")).agg(F.lit(k).alias("test"), F.count("*").alias("n"), F.sum("customer").alias("keys")).select("label", "test", "n", "keys")
    return count(train, 0).unionByName(count(test, 1))


_SUMS = "s AS (SELECT var_pop(l_quantity) v1, var_pop(l_discount) v2, covar_pop(l_quantity, l_discount) c, covar_pop(l_quantity, l_extendedprice) a, covar_pop(l_discount, l_extendedprice) b, avg(l_quantity) m1, avg(l_discount) m2, avg(l_extendedprice) my FROM lineitem{0}), k AS (SELECT *, (a * v2 - b * c) / (v1 * v2 - c * c) AS b1, (b * v1 - a * c) / (v1 * v2 - c * c) AS b2 FROM s)"


@query(f"WITH {_SUMS.format('')} SELECT unnest(['intercept', 'l_quantity', 'l_discount']) AS feature, round(unnest([my - b1 * m1 - b2 * m2, b1, b2]), 4) AS coefficient FROM k")
def ols_coefficients(t: Tables) -> DataFrame:
    fit = models.ols2(t.lineitem, "l_quantity", "l_discount", "l_extendedprice")
    return models.coefficients(fit, ["l_quantity", "l_discount"]).withColumn("coefficient", F.round("coefficient", 4))


@query(f"""WITH {_SUMS.format(' WHERE l_orderkey % 100 >= 30')}, m AS (SELECT median(l_extendedprice) AS m FROM lineitem WHERE l_orderkey % 100 >= 30), e AS (SELECT avg(abs(l_extendedprice - (my - b1 * m1 - b2 * m2 + b1 * l_quantity + b2 * l_discount))) AS model, avg(abs(l_extendedprice - m)) AS base FROM lineitem, k, m WHERE l_orderkey % 100 < 30)
SELECT round((base - model) / base * 100, 4) AS improvement FROM e""")
def baseline_improvement(t: Tables) -> DataFrame:
    train, test = models.split(t.lineitem, "l_orderkey")
    fit = models.ols2(train, "l_quantity", "l_discount", "l_extendedprice")
    middle = profile.quantiles(train.withColumn("all", F.lit(1)), ["all"], "l_extendedprice", {"m": 0.5}).select("m")
    rows = test.crossJoin(F.broadcast(fit)).crossJoin(F.broadcast(middle))  # one row each
    guess = F.col("intercept") + F.col("b1") * F.col("l_quantity") + F.col("b2") * F.col("l_discount")
    one = rows.agg(F.avg(F.abs(F.col("l_extendedprice") - guess)).alias("model"), F.avg(F.abs(F.col("l_extendedprice") - F.col("m"))).alias("base"))
    return one.select(F.round(models.improvement(F.col("model"), F.col("base")), 4).alias("improvement"))


@query("""WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem) SELECT a, b, round(r, 6) AS r FROM (
SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, ab AS r FROM r UNION ALL SELECT 'l_extendedprice', 'l_quantity', ab FROM r UNION ALL SELECT 'l_quantity', 'l_discount', ac FROM r UNION ALL SELECT 'l_discount', 'l_quantity', ac FROM r
UNION ALL SELECT 'l_extendedprice', 'l_discount', bc FROM r UNION ALL SELECT 'l_discount', 'l_extendedprice', bc FROM r UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']), unnest(['l_quantity', 'l_extendedprice', 'l_discount']), 1.0)""")
def correlation_matrix(t: Tables) -> DataFrame:
    return profile.correlation_matrix(t.lineitem, LINE)


@query("""WITH q AS (SELECT o_orderstatus AS s, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
SELECT o_orderstatus, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(o_totalprice) FILTER (i), 6) AS low, round(max(o_totalprice) FILTER (i), 6) AS high, count(*) FILTER (NOT i) AS n_outliers
FROM (SELECT *, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS i FROM orders JOIN q ON o_orderstatus = s) GROUP BY 1, 2, 3, 4""")
def box_stats(t: Tables) -> DataFrame:
    return profile.box_stats(t.orders, "o_orderstatus", "o_totalprice")


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n, r, k, t FROM (SELECT a, sum(n) AS r FROM c GROUP BY 1) x CROSS JOIN (SELECT b, sum(n) AS k FROM c GROUP BY 1) y CROSS JOIN (SELECT sum(n) AS t FROM c) z LEFT JOIN c ON c.a = x.a AND c.b = y.b),
s AS (SELECT sum((n - r * k / t) ** 2 / (r * k / t)) AS chi2, any_value(t) AS n, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc FROM g)
SELECT round(chi2, 6) AS chi2, CAST((nr - 1) * (nc - 1) AS BIGINT) AS dof, CAST(n AS BIGINT) AS n, round(sqrt(greatest(0, chi2 / n - (nc - 1) * (nr - 1) / (n - 1)) / least(nc - (nc - 1) ** 2 / (n - 1) - 1, nr - (nr - 1) ** 2 / (n - 1) - 1)), 6) AS v FROM s""")
def chi_square_v(t: Tables) -> DataFrame:
    return profile.association(t.orders, "o_orderstatus", "o_orderpriority")


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n, r, k, t FROM (SELECT a, sum(n) AS r FROM c GROUP BY 1) x CROSS JOIN (SELECT b, sum(n) AS k FROM c GROUP BY 1) y CROSS JOIN (SELECT sum(n) AS t FROM c) z LEFT JOIN c ON c.a = x.a AND c.b = y.b),
s AS (SELECT sum((n - r * k / t) ** 2 / (r * k / t)) AS x, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof FROM g) SELECT round(x, 6) AS chi2, CAST(dof AS BIGINT) AS dof, round(exp(-x / 2) * list_sum(list_transform(range(0, dof // 2), lambda i: (x / 2) ** i / gamma(i + 1))), 6) AS p FROM s""")
def chi_square_p(t: Tables) -> DataFrame:
    """The tail of an even number of degrees of freedom is a finite sum, which the SQL states."""
    found = profile.association(t.orders, "o_orderstatus", "o_orderpriority")
    return found.select("chi2", "dof", profile.chi2_tail(F.col("chi2"), F.col("dof").cast("double")).alias("p"))


@query("""SELECT unnest(['l_quantity', 'l_discount']) AS column_name, round(1 / (1 - (sum(l_quantity * l_discount)) ** 2 / (sum(l_quantity ** 2) * sum(l_discount ** 2))), 6) AS vif FROM lineitem""")
def vif_two(t: Tables) -> DataFrame:
    return profile.inflation(t.lineitem, ["l_quantity", "l_discount"])


@query("""SELECT column_name, CAST(count(DISTINCT v) AS BIGINT) AS n_distinct, any_value(top) AS top, round(any_value(share), 6) AS top_share, CAST(count(DISTINCT v) <= 1 AS BIGINT) AS constant, CAST(count(DISTINCT v) <= 5 AND any_value(share) >= 0.95 AS BIGINT) AS near_constant FROM (
SELECT *, first(v) OVER (PARTITION BY column_name ORDER BY n DESC, coalesce(v, '') ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top, max(n) OVER (PARTITION BY column_name) / sum(n) OVER (PARTITION BY column_name) AS share FROM (
SELECT column_name, v, count(*) AS n FROM (SELECT unnest(['status', 'one', 'rare']) AS column_name, unnest([o_orderstatus, 'x', CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE 'y' END]) AS v FROM orders) GROUP BY 1, 2)) GROUP BY 1""")
def constant_columns(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderstatus").alias("status"), F.lit("x").alias("one"), F.when(F.col("o_orderkey") % 50 != 0, "y").alias("rare"))
    return profile.top_values(rows, ["status", "one", "rare"])


@query("""WITH s AS (SELECT var_pop(l_quantity) v1, var_pop(l_discount) v2, covar_pop(l_quantity, l_discount) c, covar_pop(l_quantity, l_extendedprice) a, covar_pop(l_discount, l_extendedprice) b, avg(l_quantity) m1, avg(l_discount) m2, avg(l_extendedprice) my, count(*) AS n FROM lineitem),
k AS (SELECT *, (a * v2 - b * c) / (v1 * v2 - c * c) AS b1, (b * v1 - a * c) / (v1 * v2 - c * c) AS b2 FROM s) SELECT round(my - b1 * m1 - b2 * m2, 4) AS intercept, round(b1, 6) AS b1, round(b2, 4) AS b2, n FROM k""")
def ols_two_features(t: Tables) -> DataFrame:
    out = models.ols2(t.lineitem, "l_quantity", "l_discount", "l_extendedprice")
    return out.select(F.round("intercept", 4).alias("intercept"), "b1", F.round("b2", 4).alias("b2"), "n")


@query("""WITH m AS (SELECT median(l_extendedprice) AS m FROM lineitem WHERE l_orderkey % 100 >= 30) SELECT round(avg(abs(l_extendedprice - m)), 4) AS mae, round(sqrt(avg((l_extendedprice - m) ** 2)), 4) AS rmse FROM lineitem, m WHERE l_orderkey % 100 < 30""")
def median_baseline(t: Tables) -> DataFrame:
    train, test = models.split(t.lineitem, "l_orderkey")
    middle = profile.quantiles(train.withColumn("all", F.lit(1)), ["all"], "l_extendedprice", {"m": 0.5}).select("m")
    rows = test.crossJoin(F.broadcast(middle))
    return rows.agg(*models.errors(F.col("l_extendedprice"), F.col("m"))).select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("""WITH s AS (SELECT var_pop(l_quantity) v1, var_pop(l_discount) v2, covar_pop(l_quantity, l_discount) c, covar_pop(l_quantity, l_extendedprice) a, covar_pop(l_discount, l_extendedprice) b, avg(l_quantity) m1, avg(l_discount) m2, avg(l_extendedprice) my FROM lineitem WHERE l_orderkey % 100 >= 30),
k AS (SELECT *, (a * v2 - b * c) / (v1 * v2 - c * c) AS b1, (b * v1 - a * c) / (v1 * v2 - c * c) AS b2 FROM s), p AS (SELECT l_extendedprice - (my - b1 * m1 - b2 * m2 + b1 * l_quantity + b2 * l_discount) AS e FROM lineitem, k WHERE l_orderkey % 100 < 30) SELECT round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse FROM p""")
def ols_metrics(t: Tables) -> DataFrame:
    train, test = models.split(t.lineitem, "l_orderkey")
    rows = test.crossJoin(F.broadcast(models.ols2(train, "l_quantity", "l_discount", "l_extendedprice")))
    fit = F.col("intercept") + F.col("b1") * F.col("l_quantity") + F.col("b2") * F.col("l_discount")
    return rows.agg(*models.errors(F.col("l_extendedprice"), fit)).select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("""SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, round((coalesce(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (y = 1), 0), 0) + coalesce(count(*) FILTER (y = 0 AND p = 0) / nullif(count(*) FILTER (y = 0), 0), 0)) / 2, 6) AS balanced_accuracy, round(coalesce(2 * count(*) FILTER (y = 1 AND p = 1) / nullif(2 * count(*) FILTER (y = 1 AND p = 1) + count(*) FILTER (y = 0 AND p = 1) + count(*) FILTER (y = 1 AND p = 0), 0), 0), 6) AS f1
FROM (SELECT CAST(l_extendedprice > 40000 AS INT) AS y FROM lineitem WHERE l_orderkey % 100 < 30), (SELECT CASE WHEN avg(CAST(l_extendedprice > 40000 AS INT)) > 0.5 THEN 1 ELSE 0 END AS p FROM lineitem WHERE l_orderkey % 100 >= 30)""")
def majority_baseline(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("y", (F.col("l_extendedprice") > 40000).cast("int"))
    train, test = models.split(rows, "l_orderkey")
    rows = test.crossJoin(F.broadcast(train.agg(F.mode("y", True).alias("p"))))
    return rows.agg(*models.classification(F.col("y"), F.col("p")))


def _tree_sql(depth: int, least: int) -> str:
    """Gini splits level by level over counts of each feature's values; n<depth> holds every row's node."""
    out = "n0 AS (SELECT l_quantity AS q, l_discount AS d, l_tax AS t, CAST(l_extendedprice > 40000 AS INT) AS y, l_orderkey % 100 < 30 AS test, 1 AS node FROM lineitem)"
    for k in range(depth):
        out += f""", v{k} AS (SELECT node, f, v, count(*) AS n, sum(y) AS p FROM (SELECT node, unnest(['a', 'b', 'c']) AS f, unnest([q, d, t]) AS v, y FROM n{k} WHERE NOT test) GROUP BY 1, 2, 3),
c{k} AS (SELECT node, f, v, sum(n) OVER w AS nl, sum(p) OVER w AS pl, sum(n) OVER (PARTITION BY node, f) AS na, sum(p) OVER (PARTITION BY node, f) AS pa FROM v{k} WINDOW w AS (PARTITION BY node, f ORDER BY v)),
g{k} AS (SELECT *, 2 * pa / na * (1 - pa / na) - (nl * 2 * pl / nl * (1 - pl / nl) + (na - nl) * 2 * (pa - pl) / (na - nl) * (1 - (pa - pl) / (na - nl))) / na AS gain FROM c{k} WHERE nl >= {least} AND na - nl >= {least}),
b{k} AS (SELECT * FROM g{k} WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v) = 1),
n{k + 1} AS (SELECT q, d, t, y, test, CASE WHEN b.f IS NULL THEN n.node WHEN (CASE b.f WHEN 'a' THEN q WHEN 'b' THEN d ELSE t END) <= b.v THEN 2 * n.node ELSE 2 * n.node + 1 END AS node FROM n{k} n LEFT JOIN b{k} b ON n.node = b.node)"""
    return out


@query(f"""WITH {_tree_sql(3, 20)}, l AS (SELECT node, CAST(2 * sum(y) > count(*) AS INT) AS p FROM n3 WHERE NOT test GROUP BY 1), r AS (SELECT n3.y, l.p FROM n3 JOIN l ON n3.node = l.node WHERE test)
SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn,
round((coalesce(count(*) FILTER (y = 1 AND p = 1) / nullif(count(*) FILTER (y = 1), 0), 0) + coalesce(count(*) FILTER (y = 0 AND p = 0) / nullif(count(*) FILTER (y = 0), 0), 0)) / 2, 6) AS balanced_accuracy,
round(coalesce(2 * count(*) FILTER (y = 1 AND p = 1) / nullif(2 * count(*) FILTER (y = 1 AND p = 1) + count(*) FILTER (y = 0 AND p = 1) + count(*) FILTER (y = 1 AND p = 0), 0), 0), 6) AS f1 FROM r""")
def tree_metrics(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("y", (F.col("l_extendedprice") > 40000).cast("int"))
    train, test = models.split(rows, "l_orderkey")
    features = ["l_quantity", "l_discount", "l_tax"]
    return models.predicted(models.tree(train, features, "y"), test, features).agg(*models.classification(F.col("y"), F.col("prediction")))


@query("SELECT unnest(['targets among predictors', 'predictors named like targets', 'group key for splits', 'columns to review']) AS \"check\", unnest(['next_views', 'change_views, next_views', 'yes', 'lag1_views']) AS result")
def leakage_review(t: Tables) -> DataFrame:
    rows = panel.targets(panel_queries.years(t), "customer", "period", ["views"])
    return profile.leakage_review(t.spark, rows.columns, ["views", "lag1_views", "change_views", "next_views"], ["next_views"], "customer", ["lag1_views", "absent"])
