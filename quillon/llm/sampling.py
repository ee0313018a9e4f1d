"""Bounded training samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch

#: Characters of a sample, about: beyond, all classes' shares shrink alike, whatever the texts' lengths. One text is always whole.
MOST_CHARS = 48 << 20
#: Rows of a sample (an id, a label and a number each) that may be broadcast.
FEW = 200_000


def draw(key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(11)), F.lit(1_000_003)) / F.lit(1_000_003)


def class_sample(rows: DataFrame, label: str, key: str, per_class: int, scratch: Scratch) -> DataFrame:
    """A written table of some per_class of the rows (key, label) of each class, chosen by hash of the key, with _share: the chance of a row of its class.

    Null keys and labels are left out. The classes aren't bounded: the sample has some per_class rows for each.
    """
    rows = rows.select(key, label).filter(F.col(key).isNotNull() & F.col(label).isNotNull()).distinct()
    shares = rows.groupBy(F.col(label).alias("_class")).agg(F.least(F.lit(1.0), per_class / F.count("*")).alias("_share"))
    chosen = rows.join(shares, F.col(label) == F.col("_class")).drop("_class").filter(draw(F.col(key)) < F.col("_share"))
    return scratch.written(chosen, "sample-keys")


def with_texts(texts: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """texts whose keys are in the sample, which is broadcast if it has at most FEW rows."""
    few = keys.limit(FEW + 1).count() <= FEW
    return texts.join(F.broadcast(keys) if few else keys, on)


def bounded(sample: DataFrame, key: str, text: str, scratch: Scratch, most_chars: int = MOST_CHARS) -> DataFrame:
    """The sample as a written table of some most_chars characters at most: if it has more, a part of it by hash, with _share to match."""
    sample = scratch.written(sample, "sample")
    chars = sample.agg(F.sum(F.length(text))).collect()[0][0] or 0
    if chars <= most_chars:
        return sample
    part = most_chars / chars
    return sample.filter(draw(F.col(key)) < F.col("_share") * part).withColumn("_share", F.col("_share") * part)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _text, _label, _share) of a class sample of labelled documents for which `learn` (over `_id`) holds.

    A document with labels that differ counts by the greatest. The chance of a document depends on its class and id alone, not on its
    length or on whether other labels have a document, so 1 / _share is its weight.
    """
    ids = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).filter(F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_label").alias("_label"))
    ids = class_sample(ids.filter(learn), "_label", "_id", per_class, scratch)
    return with_texts(docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")), ids, ["_id"])
