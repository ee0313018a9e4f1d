"""Readers and sinks: tables that are written in some form and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.plans.registry import Tables, query
from quillon.sources import files


@query("SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal, c_mktsegment AS segment FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    """CSV out and in again, with headers in another style and quotes, commas and line breaks within values."""
    path = f"{files.work_dir(t.spark)}/table.csv"
    odd = F.concat("c_name", F.lit(', "x"\ny'))
    files.write_csv(t.customer.select(F.col("c_custkey").alias("Cust Key"), odd.alias("Cust Name"), F.col("c_acctbal").alias("AcctBal"), F.col("c_mktsegment").alias("Segment")), path)
    rows = S.standardised(files.read_table(t.spark, path, line_breaks=True))
    number = S.number(F.col(S.first_existing(rows, "balance", "acct_bal")))
    return rows.select(S.nullable_int(F.col("cust_key")).alias("c_custkey"), F.regexp_replace("cust_name", ', "x"\ny$', "").alias("c_name"), number.alias("c_acctbal"), "segment")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey::BIGINT END AS nation FROM supplier WHERE s_nationkey IN (1, 2, 3, 5, 8, 13)")
def tsv_scan(t: Tables) -> DataFrame:
    """A gzipped tab-separated table with \\N for missing values and lone quotes; one kind of rows is kept."""
    path = f"{files.work_dir(t.spark)}/table.tsv.gz"
    rows = t.supplier.select(F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit('"'), "s_name")).otherwise("\\N"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey").cast("string")).otherwise("\\N"), F.col("s_nationkey").cast("string"))
    rows.write.csv(path, sep="\t", quote="", escapeQuotes=False, compression="gzip", header=True)
    back = files.read_tsv(t.spark, path, "s_suppkey long, name string, nation int, kind int", partitions=4)
    return back.filter(F.col("kind").isin(1, 2, 3, 5, 8, 13)).select("s_suppkey", F.substring("name", 2, 100).alias("name"), "nation")


@query("SELECT n_nationkey, n_name, 'parquet' AS form FROM nation UNION ALL SELECT r_regionkey, r_name, 'csv' FROM region")
def parquet_else_csv(t: Tables) -> DataFrame:
    """The Parquet table where there is one, else the CSV; an optional table that doesn't exist is empty."""
    root = files.work_dir(t.spark)
    files.write_parquet(t.nation, f"{root}/nation.parquet")
    files.write_csv(t.nation.limit(0), f"{root}/nation.csv")
    files.write_csv(t.region, f"{root}/region.csv")
    files.require(t.spark, f"{root}/nation.parquet", f"{root}/region.csv")
    a, b = files.load(t.spark, f"{root}/nation"), files.load(t.spark, f"{root}/region")
    none = files.optional(t.spark, f"{root}/more.csv", "n_nationkey int, n_name string, form string", lambda p: files.read_table(t.spark, p))
    out = a.select("n_nationkey", "n_name", F.lit("parquet").alias("form"))
    return out.unionByName(b.select(F.col("r_regionkey").try_cast("int").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit("csv").alias("form"))).unionByName(none)


@query("SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 250")
def sample_sink(t: Tables) -> DataFrame:
    path = f"{files.work_dir(t.spark)}/sample.csv"
    files.write_sample(t.orders.select("o_orderkey", "o_totalprice"), path, "o_orderkey", 250)
    return files.read_table(t.spark, path, "o_orderkey long, o_totalprice double")


@query("SELECT o_orderkey, 'open' AS review FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice > 300000")
def review_sinks(t: Tables) -> DataFrame:
    root = files.work_dir(t.spark)
    files.write_reviews(t.orders, root, {"open": "o_orderstatus = 'O'", "large": "o_totalprice > 300000"}, "o_orderkey")
    out = None
    for name in ("open", "large"):
        part = t.spark.read.csv(f"{root}/{name}", header=True).select(S.nullable_int(F.col("o_orderkey")).alias("o_orderkey"), F.lit(name).alias("review"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity FROM lineitem WHERE l_returnflag = 'A'")
def cached_snapshot(t: Tables) -> DataFrame:
    """A table that is made once, guarded against changes while it is read, and copied before it is used."""
    root = files.work_dir(t.spark)
    make = lambda: t.lineitem.filter("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_quantity")
    files.cached(t.spark, f"{root}/made", [f"{t.folder}/lineitem.parquet"], make)
    table = files.cached(t.spark, f"{root}/made", [f"{t.folder}/lineitem.parquet"], lambda: make().limit(0))
    with files.unchanged(t.spark, f"{t.folder}/lineitem.parquet"):
        return files.nan_to_null(files.snapshot(table, f"{root}/copy"))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS row_id FROM customer")
def row_ids(t: Tables) -> DataFrame:
    """Rows numbered in file order."""
    path = f"{files.work_dir(t.spark)}/ordered"
    t.customer.select("c_custkey").orderBy("c_custkey").coalesce(1).write.parquet(path)
    return S.numbered(t.spark.read.parquet(path))

