"""Document fingerprints: an improbable-feature digest of chained Bloom filters, compared by normalised bit overlap.

A byte window of fixed width begins at every byte of a text. Its rank is how far its entropy lies from that of ordinary text: the
rarer, the better. Of every `popular` consecutive windows the leftmost rarest gets a vote, and windows with enough votes are features.
A feature's hash sets five bits of a 2048-bit filter; a filter takes 160 features, then the next one of the chain begins. Short texts
have a second chain of narrower windows; two short texts are compared by those, any others by the wide ones that all texts have.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import scan
from quillon.llm.common import mix64, prepared, ragged, trim
from quillon.llm.records import by_order, n_shards


class Scale(NamedTuple):
    """Bytes of a window, consecutive windows that vote (at most `width`, so that two texts never meet), votes of a feature, and
    the usual entropy in bits of ordinary text's windows over 32 byte classes; windows below `weak` bits (runs) are no features."""

    width: int
    popular: int
    votes: int
    usual: float
    weak: float


WIDE, NARROW = Scale(32, 32, 10, 3.35, 1.0), Scale(8, 8, 3, 2.55, 0.5)
#: Texts of fewer bytes have narrow features too.
SHORT = 512
BITS, HASHES, MOST = 2048, 5, 160
CLASSES, UNIT, STEP = 32, 1 << 16, 1 << 16
#: What a byte adds to the counts of each eight classes, one byte of a whole number for each class.
_LANES = np.zeros((CLASSES // 8, 256), np.uint64)
_LANES[(np.arange(256) & (CLASSES - 1)) >> 3, np.arange(256)] = np.uint64(1) << (np.arange(256, dtype=np.uint64) & np.uint64(7)) * np.uint64(8)


def entropy_sums(data: np.ndarray, width: int) -> np.ndarray:
    """Sum of c * log2(c) * UNIT over the byte classes' counts c of each window of `width` bytes: entropy is log2(width) less its share.

    From one window to the next only the class that leaves and the one that enters change. A window's counts are differences of
    running sums, eight classes to a whole number; the sums may wrap, their differences don't, as no count is above `width`.
    """
    n = np.arange(width + 2)
    f = np.round(n * np.log2(np.maximum(n, 1)) * UNIT).astype(np.int64)
    enters, leaves = np.diff(f), np.concatenate([[0], f[:-1] - f[1:]])
    out = np.empty(max(0, len(data) - width + 1), np.int64)
    for a in range(0, len(out), STEP):
        b = min(len(out), a + STEP)
        part = data[a : b + width - 1]
        counts = np.empty((len(_LANES), b - a), np.uint64)
        for lane, table in enumerate(_LANES):
            running = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part], out=running[1:])
            np.subtract(running[width:], running[:-width], out=counts[lane])
        classes = part & np.uint8(CLASSES - 1)
        gone, new, at = classes[: b - a - 1], classes[width:], np.arange(b - a - 1)
        flat = counts.ravel()
        count = lambda c: (flat[(c >> 3).astype(np.int64) * (b - a) + at] >> (c & np.uint8(7)).astype(np.uint64) * np.uint64(8) & np.uint64(255)).astype(np.int64)  # noqa: E731, B023
        change = np.where(gone == new, 0, leaves[count(gone)] + enters[count(new)])
        out[a] = f[np.bincount(part[:width] & (CLASSES - 1), minlength=CLASSES)].sum()
        np.cumsum(change, out=out[a + 1 : b])
        out[a + 1 : b] += out[a]
    return out


def ranks(sums: np.ndarray, scale: Scale) -> np.ndarray:
    """Less is rarer; 511 for windows that are no features."""
    entropy = np.log2(scale.width) - sums / (scale.width * UNIT)
    return np.where(entropy < scale.weak, 511, 510 - np.minimum(np.round(np.abs(entropy - scale.usual) * 64), 510)).astype(np.uint64)


def popular(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` consecutive keys, which are padded by `width` - 1 greatest ones on both sides."""
    most = np.full(width - 1, np.uint64(2**64 - 1))
    out, span = np.concatenate([most, keys, most]), 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


def features(block: scan.Block, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' features in order, how many each text has); a text without any has itself as one, an empty one none."""
    size = np.diff(block.offsets)
    data, n_texts = block.data, len(size)
    sums = entropy_sums(data, scale.width)
    rank = ranks(sums, scale)
    ends = np.repeat(block.offsets[1:], size)[: len(sums)]
    usable = (np.arange(len(sums)) + scale.width <= ends) & (rank < 511)
    keys = np.where(usable, rank << np.uint64(40) | np.arange(len(sums), dtype=np.uint64), np.uint64(2**64 - 1))
    best = popular(keys, scale.popular) if len(keys) else keys
    best = best[best != np.uint64(2**64 - 1)] & np.uint64(2**40 - 1)
    votes = np.bincount(best.astype(np.int64), minlength=len(sums))
    at = np.flatnonzero(votes >= scale.votes)
    n = np.diff(np.searchsorted(at, block.offsets))
    hashes = np.empty(len(at), np.uint64)
    for i in range(0, len(at), 1 << 14):
        hashes[i : i + (1 << 14)] = scan.polynomial(data[at[i : i + (1 << 14), None] + np.arange(scale.width)])
    bare = np.flatnonzero((n == 0) & (size > 0))
    if len(bare):
        place = ragged(n)[bare]
        whole = [scan.hashes(data, block.offsets[i : i + 1], block.offsets[i + 1 : i + 2])[0] for i in bare]
        hashes = np.insert(hashes, place, whole)
        n[bare] = 1
    return mix64(hashes), n


class Chain:
    """A chain of packed filters with the number of features of each."""

    def __init__(self, hashes: np.ndarray):
        n = -(-len(hashes) // MOST)
        bits = np.zeros((n, BITS), bool)
        row = np.arange(len(hashes)) // MOST
        for k in range(HASHES):
            bits[row, (hashes >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
        self.filters, self.sizes = np.packbits(bits, axis=1).view(np.uint64), np.bincount(row, minlength=n)

    def text(self) -> str:
        return f"{int(self.sizes.sum())}:{base64.b64encode(self.filters.tobytes()).decode()}" if len(self.sizes) else ""

    def likeness(self, other: Chain) -> float:
        """0 to 1: each filter of the shorter chain finds its best overlap, beyond what chance gives, in the other; weighted by features."""
        a, b = (self, other) if len(self.sizes) <= len(other.sizes) else (other, self)
        if not len(a.sizes):
            return float(not len(b.sizes))
        size_b, total = np.bitwise_count(b.filters).sum(axis=1, dtype=np.int64), 0.0
        for f, weight in zip(a.filters, a.sizes):
            size = int(np.bitwise_count(f).sum(dtype=np.int64))
            shared = np.bitwise_count(b.filters & f).sum(axis=1, dtype=np.int64)
            most, chance = np.minimum(size, size_b), size * size_b / BITS
            cut = chance + 0.3 * np.maximum(most - chance, 0)
            total += weight * float(np.clip((shared - cut) / np.maximum(most - cut, 1e-9), 0, 1).max())
        return total / float(a.sizes.sum())


class Digest:
    """The chain of wide features, and that of narrow ones if the text is short."""

    def __init__(self, wide: np.ndarray, narrow: np.ndarray | None):
        self.wide, self.narrow = Chain(wide), Chain(narrow) if narrow is not None else None

    def text(self) -> str:
        return self.wide.text() + (f"/{self.narrow.text()}" if self.narrow is not None and len(self.narrow.sizes) else "")

    def likeness(self, other: Digest) -> float:
        """Likeness of the narrow chains of two short texts, else of the wide ones."""
        if self.narrow is not None and other.narrow is not None:
            return self.narrow.likeness(other.narrow)
        return self.wide.likeness(other.wide)


def digests(texts: list[str]) -> list[Digest]:
    out = []
    for _, _, block in scan.blocks(pa.array(texts, pa.large_string()), size=1 << 19):
        wide, n = features(block, WIDE)
        size, at = np.diff(block.offsets), ragged(n)
        short = np.flatnonzero(size < SHORT)
        byte = np.repeat(size < SHORT, size)
        narrow, m = features(scan.Block(block.data[byte], ragged(size[short])), NARROW)
        narrow_at = dict(zip(short.tolist(), zip(ragged(m)[:-1].tolist(), ragged(m)[1:].tolist())))
        for i in range(len(n)):
            part = narrow_at.get(i)
            out.append(Digest(wide[at[i] : at[i + 1]], narrow[part[0] : part[1]] if part else None))
    return out


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_ahead, _id, _text) in order; a shard's last row finds its next in the row marked ahead."""
    held: tuple[int | None, str, Digest] | None = None
    for batch in batches:
        rows = list(zip(batch.column("_ahead").to_pylist(), batch.column("_id").to_pylist(), (t or "" for t in batch.column("_text").to_pylist())))
        made = digests([r[2] for r in rows])
        pairs = []
        for (ahead, key, text), digest in zip(rows, made):
            if held is not None:
                pairs.append((held, (key, text, digest)))
            held = None if ahead else (key, text, digest)
        if not pairs:
            continue
        edited = [a[1][: len(a[1]) - len(a[1]) // 4] + b[1][: len(a[1]) // 4] for a, b in pairs]
        after = digests(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]), pa.array([a[2].text() for a, _ in pairs]), pa.array([d.text() for d in after]),
                pa.array([a[2].likeness(d) for (a, _), d in zip(pairs, after)], pa.float64()), pa.array([a[2].likeness(b[2]) for a, b in pairs], pa.float64()),
            ],
            names=[f.split(" ")[0] for f in SCHEMA.split(", ")],
        )
    trim()


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness and that to the next document's.

    The next document is the next by ascending doc_id, equal ids by their texts' hash, null ids last; the last one's is the first.
    Null counts as empty; an empty text has an empty fingerprint, which is like empty ones only. Repeated rows follow each other;
    texts of any length are read whole. An empty table gives an empty result; other columns are not read. Texts move once, into
    ranges of ids; only the first document of each range goes to the range before as well. The driver holds a row for each range, and
    there are at most MOST_SHARDS of them.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    ranged, shards = by_order(slim, n_shards(slim, shard_bytes))
    firsts = sorted((r["_shard"], r.i) for r in ranged.groupBy("_shard").agg(F.min(F.struct("_id", "_hash")).alias("i")).collect())
    numbers = [s for s, _ in firsts]
    target = {s: numbers[i - 1] for i, s in enumerate(numbers)}
    table = spark.createDataFrame([(s, i["_id"], i["_hash"], target[s]) for s, i in firsts], "_s int, _first bigint, _least bigint, _target int")
    both = ranged.join(F.broadcast(table), F.col("_shard") == F.col("_s"))
    here, ahead = F.struct(F.col("_shard").alias("s"), F.lit(0).alias("a")), F.struct(F.col("_target").alias("s"), F.lit(1).alias("a"))
    is_first = F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_hash") == F.col("_least"))
    both = both.withColumn("_to", F.explode(F.when(is_first, F.array(here, ahead)).otherwise(F.array(here))))
    dealt = both.select(F.col("_to.s").alias("_shard"), F.col("_to.a").alias("_ahead"), "_id", "_hash", "_text").repartitionById(shards, F.col("_shard"))
    return dealt.sortWithinPartitions("_shard", "_ahead", "_id", "_hash", "_text").select("_ahead", "_id", "_text").mapInArrow(_follow, SCHEMA)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(prepared(spark).read.parquet(f"{sf_dir}/documents.parquet"))
