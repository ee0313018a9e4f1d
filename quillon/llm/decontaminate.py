"""Benchmark decontamination with DataFrame functions only: size-partitioned MinHash containment search, exact confirmation.

An item and a long document have a tiny Jaccard similarity, so only the item is sketched: its least k shingle hashes, which are a
random sample of its set, and a document is probed for them with all its shingles. Items are partitioned by the power of two of their
set size, and a partition of sizes up to u takes k = floor(u / 4) + 1. An item with |I| shingles of which a document holds at least
3/4 misses at most floor(|I| / 4) < k of them, so at least k - floor(|I| / 4) sketch values are found: no leak is lost. Candidates
are confirmed by the exact share of the item's shingles, as strings, in the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, written

SHINGLE = 5
#: Sketch values (three numbers each) up to this many are broadcast, and items' shingle strings up to this many characters; more meet
#: the documents in a shuffled join.
MOST_SKETCHES, MOST_CHARS = 1_000_000, 32 << 20


def words_of(text: Column) -> Column:
    """Lower-case words; null and blank texts have none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def _shingled(df: DataFrame, hashed: bool) -> DataFrame:
    """df with _words turned into _shingles: every SHINGLE words; with fewer words the whole sequence, if there is one."""
    words = F.col("_words")
    if hashed:
        at = lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SHINGLE)])
    else:
        at = lambda w, i: F.concat_ws(" ", F.slice(words, i + 1, SHINGLE))
    n = F.greatest(F.least(F.size(words), F.lit(1)), F.size(words) - (SHINGLE - 1))
    return df.withColumn("_shingles", F.transform(F.slice(words, F.lit(1), n), at)).drop("_words")


def _few_sketches(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its count is within the bound."""
    return F.broadcast(df) if df.limit(MOST_SKETCHES + 1).count() <= MOST_SKETCHES else df


def _short_items(df: DataFrame) -> DataFrame:
    """df with _set marked for broadcast if its strings are within the bound."""
    chars = df.agg(F.sum(F.aggregate("_set", F.lit(0).cast("long"), lambda n, x: n + F.length(x)))).collect()[0][0] or 0
    return F.broadcast(df) if chars <= MOST_CHARS else df


def leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = 0.75) -> DataFrame:
    """_id, _hash, item_id, n_item, n_shared, containment: items with at least `least` (3/4 or more) of their shingles in a document.

    _id is the document's id and _hash its text's hash; rows of equal id and text are one document. Null or blank texts and items
    match nothing. An item of fewer than five words is one shingle and matches documents that are the same short sequence. Null ids
    are kept as ids; items that repeat an id count by id and text. Empty tables give an empty result; other columns are not read.
    Texts of any length are shingled whole; one document's shingles are an array of one row.
    Documents' shingles meet the sketches in a broadcast or shuffled join, and only candidates are joined to their texts again.
    """
    if least < 0.75:
        raise ValueError("the sketches find containments of at least 0.75")
    with Scratch(docs.sparkSession) as scratch:
        return written(_leaks(docs, items, doc_id, text, item_id, item_text, least, scratch), "leaks")


def _leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, least: float, scratch: Scratch) -> DataFrame:
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    bench = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("_text")).withColumn("_item", F.xxhash64("item_id", "_text"))
    bench = bench.withColumn("_words", words_of(F.col("_text"))).drop("_text").filter(F.size("_words") > 0).dropDuplicates(["_item"])
    bench = scratch.written(bench, "items")
    sets = _shingled(bench, True).withColumn("_set", F.array_sort(F.array_distinct("_shingles"))).withColumn("_m", F.size("_set"))
    upper = F.pow(F.lit(2), F.floor(F.log2("_m")) + 1).cast("int") - 1
    k = F.least(F.col("_m"), F.floor(upper / 4).cast("int") + 1)
    sketches = sets.withColumn("_k", k).withColumn("_need", F.col("_k") - F.floor(F.col("_m") / 4).cast("int"))
    sketches = sketches.select("_item", "_need", F.explode(F.slice("_set", F.lit(1), F.col("_k"))).alias("_s"))
    # explode_outer: the filter that Spark infers from explode would be pushed below the split, which then ran for every shingle
    probes = _shingled(slim.withColumn("_words", words_of(F.col("_text"))).drop("_text"), True).select("_id", "_hash", F.explode_outer("_shingles").alias("_s"))
    hits = probes.join(_few_sketches(sketches), "_s").groupBy("_id", "_hash", "_item", "_need", "_s").agg(F.lit(1).alias("_one"))
    found = hits.groupBy("_id", "_hash", "_item", "_need").agg(F.count("*").alias("_hits")).filter("_hits >= _need").select("_id", "_hash", "_item")
    found = scratch.written(found, "candidates")
    wanted = found.select(F.col("_id").alias("_w"), F.col("_hash").alias("_wh")).distinct()
    texts = slim.join(wanted, (F.col("_hash") == F.col("_wh")) & F.col("_id").eqNullSafe(F.col("_w")), "left_semi").dropDuplicates(["_id", "_hash"])
    texts = _shingled(texts.withColumn("_words", words_of(F.col("_text"))).drop("_text"), False)
    exact = _shingled(bench, False).select("_item", "item_id", F.array_distinct("_shingles").alias("_set"))
    found = found.select(F.col("_id").alias("_f"), F.col("_hash").alias("_fh"), "_item")
    pairs = texts.join(found, (F.col("_hash") == F.col("_fh")) & F.col("_id").eqNullSafe(F.col("_f"))).select("_id", "_hash", "_item", "_shingles")
    pairs = pairs.join(_short_items(exact), "_item")
    shared, m = F.size(F.array_intersect("_set", "_shingles")).cast("long"), F.size("_set").cast("long")
    out = pairs.select("_id", "_hash", "item_id", m.alias("n_item"), shared.alias("n_shared"))
    return out.filter(F.col("n_shared") >= least * F.col("n_item")).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def clean(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, without leaks of items; rows without id or text are judged like others."""
    bad = leaks(docs, items, doc_id=doc_id, text=text, **options).select(F.col("_id").alias("__q_w"), F.col("_hash").alias("__q_h")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__q_w"]) & (F.xxhash64(docs[text].cast("string")) == bad["__q_h"]), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("_id").alias("doc_id"), "item_id", "n_item", "n_shared", F.round("containment", 6).alias("containment"))


#: item shingles in documents, by joining all shingles of both sides
OP8_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(least(len(w), 1), len(w) - 4) + 1)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(least(len(w), 1), len(w) - 4) + 1)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, round(count(*) / n_item, 6) AS containment
FROM bs JOIN ds USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.75 * n_item
"""
