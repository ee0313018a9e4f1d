"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

Statistics of all texts of a block come from one byte histogram, word spans and line spans in numpy. Trees of fixed depth are grown
level by level on binned features with the logistic loss, and kept as flat arrays: node i has children 2 i + 1 and 2 i + 2, so all
rows walk a tree together with `depth` array lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import sampling, scan
from quillon.llm.common import Scratch, map_batches, mix64, prepared, ragged, share

N_BINS = 64

_CLASSES = np.zeros((256, 12))
for _i, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\r\x0b\x0c", b".,;:'\"-", b"!?", b"()[]{}<>/\\", b"#$%&*@^~`+=_", b"|", bytes(range(128, 192)), bytes(range(192, 256)))):
    _CLASSES[list(_bytes), _i] = 1

FEATURES = [
    "log_bytes", "log_words", "lower", "upper", "digits", "spaces", "breaks", "stops", "marks", "brackets", "symbols", "bars", "continued", "leads",
    "entropy", "mean_word", "sd_word", "distinct_words", "top_word", "distinct_pairs", "same_as_before", "words_upper", "words_symbol_end", "words_stop_end",
    "words_short", "words_long", "distinct_lines", "mean_line", "link_words", "lines_no_stop",
]


def _counts_of(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of different keys, occurrences of the most frequent key) in each row."""
    mixed = np.sort(mix64(keys ^ mix64(row.astype(np.uint64) + np.uint64(1))) >> np.uint64(20) | row.astype(np.uint64) << np.uint64(44))
    first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]])) if len(mixed) else np.zeros(0, np.int64)
    rows = (mixed[first] >> np.uint64(44)).astype(np.int64)
    times = np.diff(np.concatenate([first, [len(mixed)]]))
    most = np.zeros(n)
    np.maximum.at(most, rows, times)
    return np.bincount(rows, minlength=n).astype(float), most


def statistics(block: scan.Block) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n = len(block.offsets) - 1
    size = np.diff(block.offsets)
    if not len(block.data):
        return np.zeros((n, len(FEATURES)))
    row = np.repeat(np.arange(n), size)
    hist = np.bincount(row * 256 + block.data, minlength=n * 256).reshape(n, 256).astype(float)
    per_byte = lambda x: x / np.maximum(size, 1)
    p = hist / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    starts, ends = scan.words(block)
    words = block.per_text(starts)
    if len(starts):
        w_row = np.repeat(np.arange(n), words)
        keys, length = scan.hashes(block.data, starts, ends), (ends - starts).astype(float)
        per_word = lambda x: np.bincount(w_row, x, minlength=n) / np.maximum(words, 1)
        mean = per_word(length)
        sd = np.sqrt(np.maximum(per_word(length**2) - mean**2, 0))
        distinct, top = _counts_of(keys, w_row, n)
        same_row = w_row[1:] == w_row[:-1]
        pairs = mix64(keys[:-1] * np.uint64(3) + keys[1:])[same_row]
        pair_row = w_row[1:][same_row]
        n_pairs = np.bincount(pair_row, minlength=n)
        distinct_pairs, _ = _counts_of(pairs, pair_row, n)
        repeats = np.bincount(w_row[1:][same_row], (keys[1:] == keys[:-1])[same_row], minlength=n)
        first, last = block.data[starts], block.data[ends - 1]
        second = block.data[np.minimum(starts + 1, ends - 1)]
        is_upper = _CLASSES[first, 1].astype(bool) & _CLASSES[second, 1].astype(bool) & (length > 1)
        link = np.isin(block.data[np.minimum(starts + 4, ends - 1)], [58, 46]) & (length > 8)
        word_side = [mean, sd, distinct / np.maximum(words, 1), top / np.maximum(words, 1), distinct_pairs / np.maximum(n_pairs, 1), repeats / np.maximum(n_pairs, 1),
                     per_word(is_upper), per_word(_CLASSES[last, 8] + _CLASSES[last, 6]), per_word(_CLASSES[last, 5]), per_word(length <= 2), per_word(length > 15)]
        link_words = per_word(link)
    else:
        word_side, link_words = [np.zeros(n)] * 11, np.zeros(n)
    breaks = np.flatnonzero(block.data == 10)
    cuts = np.union1d(breaks + 1, block.offsets[:-1][size > 0])
    cuts = cuts[cuts < len(block.data)]
    l_end = np.concatenate([cuts[1:], [len(block.data)]])
    l_row = row[cuts]
    lines = np.bincount(l_row, minlength=n)
    distinct_lines, _ = _counts_of(scan.hashes(block.data, cuts, l_end), l_row, n)
    tail = block.data[np.maximum(l_end - 2, cuts)]
    no_stop = np.bincount(l_row, ~np.isin(tail, list(b".!?:;\"'")), minlength=n) / np.maximum(lines, 1)
    shares = per_byte(1.0)[:, None] * (hist @ _CLASSES)
    line_side = [distinct_lines / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1)), link_words, no_stop]
    return np.column_stack([np.log1p(size), np.log1p(words), shares, entropy, *word_side, *line_side])


class Trees:
    """Boosted trees as flat arrays [tree, node]: feature, threshold (go left if value <= threshold) and leaf values."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.feature.shape[1] + 1)) if self.feature.size else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, l2: float = 2.0, least: float = 3.0) -> Trees:
    """Trees by second-order boosting on histograms of N_BINS quantile bins. Without both classes only the base remains."""
    total = weight.sum()
    share_1 = float((weight * y).sum() / total) if total else 0.5
    base = float(np.log(np.clip(share_1, 1e-3, 1 - 1e-3) / (1 - np.clip(share_1, 1e-3, 1 - 1e-3))))
    inner, leaves = 2**depth - 1, 2**depth
    if len(set(y.tolist())) < 2:
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, N_BINS)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    feature, threshold, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    margin = np.full(len(x), base)
    flat = bins + np.arange(x.shape[1]) * N_BINS
    width = x.shape[1] * N_BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            k = 2**level
            at = (node[:, None] * width + flat).ravel()
            gs = np.bincount(at, np.repeat(g, x.shape[1]), minlength=k * width).reshape(k, x.shape[1], N_BINS).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, x.shape[1]), minlength=k * width).reshape(k, x.shape[1], N_BINS).cumsum(axis=2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least * 0.1) | (ht - hs < least * 0.1)] = 0
            best = gain.reshape(k, -1).argmax(axis=1)
            f, b = best // N_BINS, best % N_BINS
            good = gain.reshape(k, -1)[np.arange(k), best] > 1e-9
            place = k - 1 + np.arange(k)
            feature[t, place] = np.where(good, f, 0)
            threshold[t, place] = [edges[j][c] if ok and c < len(edges[j]) else np.inf for j, c, ok in zip(f, b, good)]
            node = 2 * node + (x[np.arange(len(x)), feature[t, place][node]] > threshold[t, place][node])
        gs, hs = np.bincount(node, g, minlength=leaves), np.bincount(node, h, minlength=leaves)
        value[t] = -rate * gs / (hs + l2)
        margin = margin + value[t][node]
    return Trees(base, feature, threshold, value)


def _statistics(batch: dict) -> dict:
    x = np.concatenate([statistics(b) for _, _, b in scan.blocks(batch["_text"])])
    return {"_label": batch["_label"], "_share": batch["_share"], "_x": pa.ListArray.from_arrays(pa.array(ragged(np.full(len(x), x.shape[1])), pa.int32()), pa.array(x.ravel()))}


def _score(batch: dict, model: Trees) -> dict:
    x = np.concatenate([statistics(b) for _, _, b in scan.blocks(batch["_text"])])
    return {"_id": batch["_id"], "_score": model.score(x)}


def learn(docs: DataFrame, labels: DataFrame, chosen: Column, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", per_class: int = 4000) -> Trees:
    """A model of `label` (0 or 1) from some per_class labelled documents of each class for which `chosen` (over `_id`) holds.

    A class of which only a share was taken is weighted up, so scores keep the natural odds. Texts of any length count, as only their
    statistics reach the driver. Null texts count as empty, repeated rows of a document as often as they occur; without labelled
    documents, or with one class only, all scores are equal.
    """
    with Scratch(docs.sparkSession) as scratch:
        sample = sampling.labelled_texts(docs, labels, label, chosen, per_class, scratch, doc_id=doc_id, text=text)
        sample = sample.select(F.col("_label").cast("int").alias("_label"), "_share", "_text")
        rows = map_batches(sample, _statistics, "_label int, _share double, _x array<double>").collect()
    rows = sorted((r._label, tuple(r._x), r._share) for r in rows)
    x, y = np.array([r[1] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r[0] for r in rows], float)
    weight = np.array([1 / r[2] for r in rows])
    return fit(x, y, weight / weight.mean() if len(weight) else weight)


def scored(docs: DataFrame, model: Trees, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _score of every whole text, however long: null counts as empty, whose statistics are all zero.

    Repeated rows are scored each, equal texts alike; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return map_batches(rows, _score, f"_id {kind}, _score double", model)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents. A row without an id has no remainder: its held_out is null and nothing is learned from it."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), share("_id", 5) != 0)
    return scored(docs, model).select(F.col("_id").alias("doc_id"), (share("_id", 5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))
