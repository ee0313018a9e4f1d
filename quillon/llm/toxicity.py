"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams, a window of a text the mean of its words, and two classes are a
softmax of a linear map of that; vectors and map are learned together. A misspelt or inflected word shares n-grams, and so vectors, with those
seen. For scoring, the map is folded into one number for each n-gram bucket, so a text's score needs one number for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import sampling, scan
from quillon.llm.common import Scratch, held, map_batches, mix64, prepared, ragged, share, trim, working

BUCKETS, DIM, GRAMS = 1 << 18, 8, (3, 4, 5, 6, 7, 8)
#: Words that are averaged: a text is as toxic as its most toxic window, so a lone passage in a long text isn't diluted.
WINDOW = 4
#: Times that a mean is multiplied by before the softmax; windows of texts that aren't toxic taken in each round.
GAIN, HARD = 4.0, 3
#: Texts that an n-gram must occur in to be learned; pull of vectors to zero.
LEAST_TEXTS, DECAY = 5, 1e-4

_RANDOM = np.random.default_rng(17)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_WIDTH = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64)
#: Bytes that a word keeps: letters, digits and all of UTF-8's longer characters.
_KEPT = np.zeros(256, bool)
_KEPT[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def grams(words: list[bytes], chunk: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams of the words between marks, and of the words themselves; how many each word has)."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    parts = [_grams(words[i : i + chunk]) for i in range(0, len(words), chunk)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"".join(b"<" + w + b">" for w in words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(joined, np.uint8)
    row = np.repeat(np.arange(len(words)), length)
    edge = (data == 60) | (data == 62)
    starts = ragged(length)[:-1]
    edge_real = np.zeros(len(data), bool)
    edge_real[starts], edge_real[starts + length - 1] = True, True
    keep = _KEPT[data] | edge_real
    del edge
    data, row = data[keep], row[keep]
    length = np.bincount(row, minlength=len(words))
    place = np.arange(len(data)) - np.repeat(ragged(length)[:-1], length)
    left = np.repeat(length, length) - place
    key, found, rows = np.zeros(len(data), np.uint64), [], []
    for n in range(1, max(GRAMS) + 1):
        at = np.flatnonzero(left >= n)
        key[at] = key[at] * np.uint64(0x100000001B3) + _BYTE[data[at + n - 1]]
        if n in GRAMS:
            found.append(mix64(key[at] + _WIDTH[n]))
            rows.append(row[at])
    whole = mix64(scan.hashes(data, ragged(length)[:-1], ragged(length)[1:]) + _WIDTH[0])
    found.append(whole)
    rows.append(np.arange(len(words)))
    found, rows = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return (found[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(rows, minlength=len(words))


def best_window(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Greatest mean of WINDOW consecutive values of each text (of all, if it has fewer); 0 without values."""
    total, at = np.concatenate([[0.0], np.cumsum(values)]), ragged(n)
    width = np.minimum(n, WINDOW)
    k = np.where(n > 0, n - width + 1, 0)
    row = np.repeat(np.arange(len(n)), k)
    start = at[:-1][row] + np.arange(int(k.sum())) - ragged(k)[:-1][row]
    means = (total[start + width[row]] - total[start]) / width[row]
    out = np.zeros(len(n))
    if len(means):
        out[n > 0] = np.maximum.reduceat(means, ragged(k)[:-1][n > 0])
    return out


class Model:
    """What scoring needs: the folded number of each bucket and the bias of the two classes' difference."""

    def __init__(self, folded: np.ndarray, bias: float):
        self.folded, self.bias = folded.astype(np.float32), bias
        self.key, self.memo = hashlib.sha256(self.folded.tobytes() + repr(bias).encode()).digest(), None

    def __getstate__(self):
        return {"folded": self.folded, "bias": self.bias, "key": self.key, "memo": None}

    def _words(self, new: list[bytes]) -> np.ndarray:
        found, n = grams(new)
        return (np.add.reduceat(self.folded[found], ragged(n)[:-1]) / n).astype(np.float32)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.memo is None:
            self.memo = scan.Memo(self._words)
        out = []
        for _, _, block in scan.blocks(texts, lower=True):
            starts, ends = scan.words(block)
            n = block.per_text(starts)
            at = self.memo(block, starts, ends)
            out.append(GAIN * best_window(self.memo.values[at].astype(float), n) + self.bias if len(starts) else np.full(len(n), self.bias))
        margin = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


class _Trainer:
    """Joint learning of bucket vectors and the linear softmax by Adam on bags of words (ids, parts)."""

    def __init__(self, words: list[bytes], texts_of_gram, bias: np.ndarray, seed: int):
        self.flat, self.n = grams(words)
        self.first = ragged(self.n)
        self.rng = np.random.default_rng(seed)
        # vectors start at zero, so n-grams that were never learned say nothing; those of fewer than LEAST_TEXTS texts are not learned
        self.vectors, self.linear, self.bias = np.zeros((BUCKETS, DIM), np.float32), self.rng.normal(0, 1, (DIM, 2)).astype(np.float32), bias
        self.moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (self.vectors, self.linear, self.bias)]
        self.learned = texts_of_gram(self) >= LEAST_TEXTS
        self.step = 0

    def at(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.n[ids]
        return self.flat[np.repeat(self.first[ids] - ragged(counts)[:-1], counts) + np.arange(int(counts.sum()))], counts

    def word_margins(self) -> np.ndarray:
        folded = self.vectors @ (self.linear[:, 1] - self.linear[:, 0])
        return np.add.reduceat(folded[self.flat], self.first[:-1]) / self.n

    def train(self, bags: list, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, batch: int = 32) -> None:
        for epoch in range(epochs):
            order = self.rng.permutation(len(bags))
            for i in range(0, len(order), batch):
                self._batch([bags[r] for r in order[i : i + batch]], y[order[i : i + batch]], weight[order[i : i + batch]], rate * (1 - epoch / epochs))

    def _batch(self, bags: list, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        ids, part = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
        if not len(ids):
            return
        doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
        words, back = np.unique(ids, return_inverse=True)
        at, counts = self.at(words)
        vec = np.add.reduceat(self.vectors[at], ragged(counts)[:-1], axis=0) / counts[:, None]
        mean = np.stack([np.bincount(doc, vec[back, d] * part, minlength=len(bags)) for d in range(DIM)], axis=1)
        z = GAIN * (mean @ self.linear) + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(bags)), y.astype(int)] -= 1
        dz = p * weight[:, None] / len(bags)
        mean_grad = GAIN * (dz @ self.linear.T)
        word_grad = np.stack([np.bincount(back, mean_grad[doc, d] * part, minlength=len(words)) for d in range(DIM)], axis=1) / counts[:, None]
        spread = np.repeat(word_grad, counts, axis=0)
        used, back = np.unique(at, return_inverse=True)
        grad = np.stack([np.bincount(back, spread[:, d], minlength=len(used)) for d in range(DIM)], axis=1).astype(np.float32)
        grad = (grad + DECAY * self.vectors[used]) * self.learned[used][:, None]
        self.step += 1
        rate *= np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for value, rows, g, (m1, m2) in zip((self.vectors, self.linear, self.bias), (used, slice(None), slice(None)), (grad, GAIN * (mean.T @ dz), dz.sum(axis=0)), self.moments):
            m1[rows] = 0.9 * m1[rows] + 0.1 * g
            m2[rows] = 0.999 * m2[rows] + 0.001 * g * g
            value[rows] -= rate * m1[rows] / (np.sqrt(m2[rows]) + 1e-6)


def _windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's windows of WINDOW words, half overlapping; a shorter text is one window."""
    starts = np.arange(0, max(n - WINDOW, 0) + 1, WINDOW // 2)
    if n > WINDOW and starts[-1] + WINDOW < n:
        starts = np.append(starts, n - WINDOW)
    return starts, np.minimum(starts + WINDOW, n)


def _bag(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, c = np.unique(ids, return_counts=True)
    return u, (c / max(len(ids), 1)).astype(np.float32)


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, *, rounds: int = 8, epochs: int = 3, rate: float = 0.03, seed: int = 3) -> Model:
    """Trains on texts, which are used up. Whole texts first; then rounds on the windows that the model finds most toxic: one of each toxic text, HARD of each other.

    Without both classes only the bias remains.
    """
    share_1 = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(y) else 0.01
    bias = np.array([0.0, np.log(share_1 / (1 - share_1))])
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(BUCKETS), float(bias[1]))
    number: dict[bytes, int] = {}
    rows = []
    while texts:  # texts are not needed once their words are numbered
        words = texts.pop().encode("utf-8", "replace").lower().split()
        rows.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
    rows.reverse()
    bags = [_bag(r) for r in rows]

    def texts_of_gram(t: _Trainer) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int64)
        for u, _ in bags:
            out[np.unique(t.at(u)[0])] += 1
        return out

    t = _Trainer(list(number), texts_of_gram, bias, seed)
    del number, words
    t.train(bags, y, weight, 1, rate)
    bags.clear()
    for _ in range(rounds):
        margins = t.word_margins()
        chosen, labels, weights = [], [], []
        for row, label, w in zip(rows, y, weight):
            if not len(row):
                continue
            starts, ends = _windows(len(row))
            total = np.concatenate([[0], np.cumsum(margins[row])])
            best = np.argsort((total[ends] - total[starts]) / (ends - starts))[::-1][: 1 if label else HARD]
            chosen += [_bag(row[starts[k] : ends[k]]) for k in best]
            labels += [label] * len(best)
            weights += [w / len(best)] * len(best)
        t.train(chosen, np.array(labels), np.array(weights) / np.mean(weights), epochs, rate)
    model = Model(t.vectors @ (t.linear[:, 1] - t.linear[:, 0]), float(t.bias[1] - t.bias[0]))
    del t, rows, chosen
    trim()
    return model


def learn(docs: DataFrame, labels: DataFrame, chosen: Column, *, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", per_class: int = 1500) -> Model:
    """A model of `label` (0 or 1) from some per_class labelled documents of each class for which `chosen` (over `_id`) holds.

    Whole texts of any length; the sample has some sampling.MOST_CHARS characters at most. Null texts count as empty and teach the
    bias only, repeated rows count as often as they occur; without labelled documents, or with one class only, all scores are equal.
    """
    with Scratch(docs.sparkSession) as scratch:
        sample = sampling.labelled_texts(docs, labels, label, chosen, per_class, scratch, doc_id=doc_id, text=text)
        table = sampling.bounded(sample, "_id", "_text", scratch).select("_label", "_share", "_text").toArrow()
    rows = sorted(zip(table["_label"].to_pylist(), (t or "" for t in table["_text"].to_pylist()), table["_share"].to_pylist()))
    del table
    y = np.array([float(r[0]) for r in rows])
    weight = np.array([1 / r[2] for r in rows])
    texts = [r[1] for r in rows]
    del rows
    return fit(texts, y, weight / weight.mean() if len(weight) else weight)


def _score(batch: dict, model: Model) -> dict:
    return {"_id": batch["_id"], "_score": _held(model).scores(batch["_text"])}


def _held(model: Model) -> Model:
    """One model of equal content for all tasks of a worker, with its memo."""
    return held(("toxicity", model.key), lambda: model)


def scored(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _score of every whole text, however long; null counts as empty, and an empty text has the bias alone.

    Repeated rows are scored each, equal texts alike; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return map_batches(rows, _score, f"_id {kind}, _score double", model)


def _below(limit: float, model: Model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working():
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array(_held(model).scores(batch.column(text)) < limit))

    return run


def kept(docs: DataFrame, model: Model, limit: float, *, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is below limit: one narrow pass."""
    return docs.mapInArrow(_below(limit, model, text), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents. A row without an id has no remainder: its held_out is null and nothing is learned from it."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), share("_id", 3) != 1)
    return scored(docs, model).select(F.col("_id").alias("doc_id"), (share("_id", 3) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))
