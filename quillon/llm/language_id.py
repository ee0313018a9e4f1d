"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all ways to cut it
into pieces, by the forward algorithm; expected piece counts for learning come from forward and backward sums (EM). A text's score is
the product over its letter runs. All words of a batch advance together in numpy, one character position at a time.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import sampling, scan
from quillon.llm.common import Scratch, held, map_batches, mix64, prepared, ragged, share

#: Runs of letters are words; longer ones are summed in parts of MAX_RUN characters.
RUN, MAX_RUN = re.compile(r"[^\W\d_]+"), 24
MARK = "▁"
#: Pseudo-count of every piece, in occurrences.
SMOOTH = 0.05

_RANDOM = np.random.default_rng(9)
_CHAR = _RANDOM.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _char_values(chars: np.ndarray) -> np.ndarray:
    return _CHAR[chars & 4095] * (chars.astype(np.uint64) | np.uint64(1))


class Pieces:
    """The vocabulary's lower-case letter pieces, numbered; 0 stands for any other single character."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i)}
        self.names = sorted(p for p in found if p.replace(MARK, "", 1).isalpha() or p == MARK)
        self.longest = max(map(len, self.names))
        self.index = scan.HashIndex()
        keys = np.concatenate([self._keys(*_codes([p]))[len(p) - 1][-1:] for p in self.names])
        self.index.add(keys)
        self.n = len(self.names) + 1

    def _keys(self, chars: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """For each length, the hash of the substring that ends at each character (of any value where it would begin too early)."""
        value, out = _char_values(chars), []
        key = np.zeros(len(chars), np.uint64)
        for length in range(1, min(self.longest, int(place.max()) + 1) + 1):
            before = np.concatenate([[np.uint64(0)], key[:-1]]) if length > 1 else key
            key = before * _STEP + value
            out.append(mix64(key + np.uint64(length)))
        return out

    def ends(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number + 1 of the piece of each length that ends at each position, 0 for none: [words, positions, lengths]; lengths)."""
        chars, place = _codes(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        row = np.repeat(np.arange(len(words)), lengths)
        out = np.zeros((len(words), int(lengths.max()), min(self.longest, int(lengths.max()))), np.int32)
        for k, key in enumerate(self._keys(chars, place)):
            fits = np.flatnonzero(place >= k)
            found = self.index.find(key[fits])
            out[row[fits], place[fits], k] = np.where(found >= 0, found + 2, 0)
        first = out[:, :, 0]
        out[:, :, 0] = np.where((first == 0) & (np.arange(first.shape[1]) < lengths[:, None]), 1, first)
        return out, lengths


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return chars, np.arange(len(chars)) - np.repeat(ragged(lengths)[:-1], lengths)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(ends: np.ndarray, lengths: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of every prefix: [words, positions + 1, languages]. probs: [0 for none, then pieces; languages]."""
    n, width, _ = ends.shape
    out = np.zeros((n, width + 1, probs.shape[1]))
    out[:, 0] = 1
    for t in range(width):
        rows = np.flatnonzero(lengths > t)
        for k in range(min(ends.shape[2], t + 1)):
            piece = ends[rows, t, k]
            hit = piece > 0
            at = rows[hit]
            out[at, t + 1] += out[at, t - k] * probs[piece[hit]]
    return out


def backward(ends: np.ndarray, lengths: np.ndarray, probs: np.ndarray) -> np.ndarray:
    n, width, _ = ends.shape
    out = np.zeros((n, width + 1, probs.shape[1]))
    out[np.arange(n), lengths] = 1
    for t in range(width - 1, -1, -1):
        rows = np.flatnonzero(lengths > t)
        for k in range(min(ends.shape[2], t + 1)):
            piece = ends[rows, t, k]
            hit = piece > 0
            at = rows[hit]
            out[at, t - k] += out[at, t + 1] * probs[piece[hit]]
    return out


def runs(word: str) -> list[str]:
    """Letter runs of a text or word, lower-case, marked and cut to MAX_RUN characters."""
    found = (r if r.isalpha() else "".join(filter(str.isalpha, r)) for r in RUN.findall(word.lower()))
    return [MARK + r[i : i + MAX_RUN] for r in found for i in range(0, len(r), MAX_RUN)]


def fit(texts: list[str], langs: list[str], path: str, *, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """(languages in order, probabilities [0 for none, then pieces; languages]) by EM on the texts' words."""
    names = sorted(set(langs))
    vocab: dict[str, np.ndarray] = {}
    for text, lang in zip(texts, langs):
        j = names.index(lang)
        for r in runs(text):
            row = vocab.get(r)
            if row is None:
                row = vocab[r] = np.zeros(len(names))
            row[j] += 1
    model = pieces(path)
    probs = np.full((model.n + 1, len(names)), 1.0 / model.n)
    probs[0] = 0
    words = sorted(vocab)
    for _ in range(rounds):
        counts = np.full((model.n + 1, len(names)), SMOOTH)
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            weight = np.array([vocab[w] for w in part])
            ends, lengths = model.ends(part)
            a, b = forward(ends, lengths, probs), backward(ends, lengths, probs)
            scale = weight / np.maximum(a[np.arange(len(part)), lengths], 1e-300)
            for k in range(ends.shape[2]):
                w, t = np.nonzero(ends[:, :, k])
                piece = ends[w, t, k]
                gain = a[w, t - k] * probs[piece] * b[w, t + 1] * scale[w]
                for j in range(len(names)):
                    counts[:, j] += np.bincount(piece, gain[:, j], minlength=model.n + 1)
        counts[0] = 0
        probs = counts / counts.sum(axis=0)
    return names, probs


class Scorer:
    def __init__(self, path: str, probs: np.ndarray):
        self.pieces, self.probs = pieces(path), probs
        self.memo = scan.Memo(self._words, 600_000)

    def _words(self, new: list[bytes]) -> np.ndarray:
        found = [runs(w.decode("utf-8", "replace")) for w in new]
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = [r for x in found for r in x]
        logs = np.zeros((len(flat), self.probs.shape[1]))
        order = sorted(range(len(flat)), key=lambda i: len(flat[i]))
        for i in range(0, len(order), 8192):
            at = order[i : i + 8192]
            ends, lengths = self.pieces.ends([flat[j] for j in at])
            logs[at] = np.log(np.maximum(forward(ends, lengths, self.probs)[np.arange(len(at)), lengths], 1e-300))
        out = np.concatenate([scan.text_sums(logs, n), n[:, None].astype(float)], axis=1)
        return out.astype(np.float32)

    def sums(self, texts: pa.Array) -> np.ndarray:
        """Log-likelihoods by language and number of letter runs, for each text."""
        parts = []
        for _, _, block in scan.blocks(texts, lower=True):
            starts, ends = scan.words(block)
            if not len(starts):
                parts.append(np.zeros((len(block.offsets) - 1, self.probs.shape[1] + 1)))
                continue
            at = self.memo(block, starts, ends)
            parts.append(scan.text_sums(self.memo.values[at], block.per_text(starts)))
        return np.concatenate(parts)


def _predict(batch: dict, path: str, names: list[str], probs: np.ndarray, key: str) -> dict:
    sums = held(("language", key), lambda: Scorer(path, probs)).sums(batch["_text"])
    logs, n = sums[:, :-1], sums[:, -1]
    known = n > 0
    if names:
        best = logs.argmax(axis=1)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    else:
        best, score, known = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n), bool)
    lang = [names[b] if k else "und" for b, k in zip(best, known)]
    return {"_id": batch["_id"], "_lang": lang, "_score": np.where(known, np.clip(score, 0, 1), 0.0)}


def identify(docs: DataFrame, tokenizer: str, learn, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_class: int = 500) -> DataFrame:
    """_id, _lang, _score of every whole text. Learns piece probabilities from some per_class documents of each non-null language
    for which `learn` (a condition over `_id`) holds; the sample has some sampling.MOST_CHARS characters at most.

    Null texts and texts without a letter get 'und' and score 0; with no labelled text at all, as in an empty table, every text does.
    Texts of any length are taken whole, and are predicted with equal priors; ties go to the language that sorts first. Repeated
    rows are rows of their own; other columns are not read. The driver holds the sample and the model (some 30,000 numbers for each
    language), which is what the executors get.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("_label"), F.col(text).cast("string").alias("_text"))
    with Scratch(docs.sparkSession) as scratch:
        known = rows.filter(learn)
        sample = sampling.with_texts(known, sampling.class_sample(known, "_label", "_id", per_class, scratch), ["_id", "_label"])
        table = sampling.bounded(sample, "_id", "_text", scratch).select("_label", "_text").toArrow()
    texts, langs = [t or "" for t in table["_text"].to_pylist()], table["_label"].to_pylist()
    names, probs = fit(texts, langs, tokenizer) if texts else ([], np.zeros((pieces(tokenizer).n + 1, 1)))
    key = f"{tokenizer}-{hashlib.sha256(probs.tobytes()).hexdigest()}"
    kind = rows.schema["_id"].dataType.simpleString()
    return map_batches(rows.select("_id", "_text"), _predict, f"_id {kind}, _lang string, _score double", tokenizer, names, probs.astype(np.float64), key)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents. A row without an id has no remainder: its held_out is null and nothing is learned from it."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, public_tokenizers.path("piece_bpe_32k.model"), share("_id", 5) != 0)
    return found.select(F.col("_id").alias("doc_id"), (share("_id", 5) == 0).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
