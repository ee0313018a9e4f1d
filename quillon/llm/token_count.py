"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie in one flat array of symbols with a row number each. In every round each row finds its pair of lowest
rank, and all rows merge all occurrences of that pair at once; rows without a pair that merges leave with their length as count.
"""

from __future__ import annotations

import json

import numpy as np
import public_tokenizers
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import Memo, held, map_batches, prepared, ragged

NONE = np.int32(2**31 - 1)
#: A space that does not by itself begin a pre-token: another white space or the end follows.
GLUED = regex.compile(r" (?=\s|\Z)")


class PairTable:
    """Ranks and results of merges, by open addressing over both symbols."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << self.bits, NONE)
        self.made = made.astype(np.int32)
        at, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.rank[at[won]] = keys[open_[won]], open_[won]
            rest = np.ones(len(open_), bool)
            rest[won] = False
            open_, at = open_[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at, out, todo = self._slot(keys), np.full(len(keys), NONE), np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.rank[at[hit]]
            on = ~hit & (held != np.uint64(2**64 - 1))
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


def merge_counts(table: PairTable, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols that are left of each ragged row after all merges."""
    counts = lengths.astype(np.int64).copy()
    ids = np.flatnonzero(lengths > 1)
    keep = np.repeat(lengths > 1, lengths)
    symbols, lengths = symbols[keep].astype(np.int32), lengths[ids].astype(np.int64)
    while len(ids):
        row = np.repeat(np.arange(len(ids)), lengths)
        starts = ragged(lengths)[:-1]
        same = row[1:] == row[:-1]
        ranks = np.full(len(symbols), NONE)
        pairs = np.flatnonzero(same)
        ranks[pairs] = table.ranks(symbols[pairs], symbols[pairs + 1])
        low = np.minimum.reduceat(ranks, starts)
        hit = (ranks == low[row]) & (ranks != NONE)
        # of overlapping occurrences (a run of hits on equal symbols) every second one merges, from the left
        at = np.flatnonzero(hit)
        if len(at):
            new_run = np.ones(len(at), bool)
            new_run[1:] = np.diff(at) != 1
            run_start = np.maximum.accumulate(np.where(new_run, at, 0))
            at = at[(at - run_start) % 2 == 0]
            symbols[at] = table.made[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            lengths = lengths - np.bincount(row[at], minlength=len(ids))
            symbols = symbols[keep]
        counts[ids] = lengths
        active = (low != NONE) & (lengths > 1)
        symbols, ids, lengths = symbols[np.repeat(active, lengths)], ids[active], lengths[active]
    return counts


class Counter:
    """Counts of whole texts under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, limit: int = 800_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path}: only byte-level BPE without normaliser or prefix space is known")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = model["vocab"]
        column = lambda f: np.array([ids[f(a, b)] for a, b in pairs])
        self.table = PairTable(column(lambda a, b: a), column(lambda a, b: b), column(lambda a, b: a + b))
        self.byte_id = np.array([ids[c] for c in byte_characters()], np.int32)
        self.pattern = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo = Memo(self._units, limit)

    def _units(self, units: list[str]) -> np.ndarray:
        split = self.pattern.findall
        tokens = [(u,) if u[1:].isalpha() and u[0] == " " else split(u) for u in units]
        pieces = [p.encode("utf-8", "surrogatepass") for x in tokens for p in x]
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        counts = merge_counts(self.table, symbols, np.fromiter(map(len, pieces), np.int64, len(pieces)))
        return np.diff(np.concatenate([[0], np.cumsum(counts)])[ragged(np.fromiter(map(len, tokens), np.int64, len(tokens)))])

    def units(self, text: str) -> list[str]:
        """Parts of a text that end where a pre-token ends: cut before every lone space that a non-space follows."""
        first, *rest = text.split(" ")
        if not GLUED.search(text):
            return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))
        out = [first]
        for x in rest:
            if not x or x[0].isspace():
                out[-1] += " " + x
            else:
                out.append(" " + x)
        return [x for x in out if x]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        rows, extra = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                rows.append([])
            elif self.special and "<|" in text and (parts := self.special.split(text))[1:]:
                extra[i] = len(parts) - 1
                rows.append([u for p in parts for u in (self.units(p) if p else [])])
            else:
                rows.append(self.units(text))
        if not any(rows):
            return extra
        values, at = self.memo(rows)
        sums = np.concatenate([[0], np.cumsum(values[at])])
        return np.diff(sums[ragged(np.fromiter(map(len, rows), np.int64, len(rows)))]) + extra


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256))
    return [chr(b) if b in set(shown) else chr(256 + next(hidden)) for b in range(256)]


def counter(path: str) -> Counter:
    return held(("token counts", path), lambda: Counter(path))


def _count(batch: dict, path: str, text_col: str) -> dict:
    texts = batch[text_col]
    size = pc.fill_null(pc.binary_length(texts), 0)
    return {"_n_bytes": size, "_n_tokens": counter(path).counts(texts.to_pylist())} | {k: v for k, v in batch.items() if k != text_col}


def token_counts(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; other columns are not read; an empty table
    gives an empty result. Texts of any length are counted whole; a single word of very many letters takes time that grows faster
    than its length. One narrow pass without a shuffle; memory is a batch of texts plus a memo of bounded size.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    out = map_batches(slim, _count, f"doc_id {kind}, _n_bytes bigint, _n_tokens bigint", tokenizer, "text")
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_tokens").alias("n_tokens"), (F.col("_n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
