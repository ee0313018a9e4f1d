"""N-gram scoring with a log-frequency Bloom filter.

Counts of all uni- and bigrams of the training texts are merged exactly, bucket by bucket of their hash. A count c is quantised to
its level floor(log2 c) + 1, and an n-gram of level l is held as the l items (n-gram, 1) ... (n-gram, l) of a Bloom filter; every bucket has
a segment of the filter of its own. A count is read back by probing level 1, 2, ... until one is absent. Probabilities are
P(w | v) = (c(v w) + MU * P(w)) / (c(v) + MU) with P(w) = (c(w) + 1) / (N + V + 1), all counts from the filter.

The filter holds every n-gram and grows with the corpus. While it is small it is broadcast; a larger one stays in its segments, and
the distinct n-grams of blocks of texts are sent to them and their counts sent back. Both ways read the same filter and give the
same scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import scan
from quillon.llm.common import Scratch, buckets_for, map_batches, mix64, prepared, ragged, share, trim, written

MU = 1000.0
#: Bits of an item in its segment; it sets three bits in each of two 64-bit words.
ITEM_BITS = 12
#: Bytes of the filter and of the words' exact counts up to which both are broadcast.
MOST_BYTES = 160 << 20
#: N-grams that a task holds before it merges and passes them on.
HELD = 1_000_000

END, BEGIN = (np.uint64(x) for x in (0x5DEECE66D1234567, 0x2545F4914F6CDD1D))
_PREV = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(block: scan.Block) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's words and its end, number of each text)."""
    starts, ends = scan.words(block)
    n = block.per_text(starts)
    return np.insert(scan.hashes(block.data, starts, ends), ragged(n)[1:], END), n + 1


def pairs(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the token before, hash of both) for each token; a text's first follows BEGIN."""
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[ragged(n)[:-1]] = BEGIN
    return before, mix64(before * _PREV + keys)


def _merge(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (0, 1):
                if held[kind]:
                    keys, counts = _merge(np.concatenate(held[kind]))
                    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                    rows = [b for b in range(buckets) if cut[b] < cut[b + 1]]
                    small = counts.astype(np.uint32)
                    for i in range(0, len(rows), 32):
                        part = rows[i : i + 32]
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array([keys[cut[b] : cut[b + 1]].tobytes() for b in part], pa.binary()), pa.array([small[cut[b] : cut[b + 1]].tobytes() for b in part], pa.binary())], ["kind", "bucket", "keys", "counts"])
                    held[kind] = []

        for batch in batches:
            for _, _, block in scan.blocks(batch.column(0), lower=True):
                keys, n = tokens(block)
                held[0].append(keys)
                held[1].append(pairs(keys, n)[1])
                size += len(keys)
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()
        trim()

    return run


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table["keys"]])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table["counts"]]).astype(np.int64)
    return keys, counts


def level(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def _merged(table: pa.Table) -> pa.Table:
    """The exact counts of a bucket's words or bigrams."""
    kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
    keys, counts = _merge(*_read(table))
    total, distinct = int(counts.sum()), len(keys)
    row = {"kind": [kind], "bucket": [bucket], "keys": [keys.tobytes()], "counts": [np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()], "total": [total], "distinct": [distinct]}
    return pa.table(row, schema=pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())]))


def _items(keys: np.ndarray, l: int | np.ndarray) -> np.ndarray:  # noqa: E741
    return mix64(keys ^ (np.asarray(l).astype(np.uint64) * _LEVEL))


def _place(items: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of a segment of `size` words, mask of three of its bits) for each item."""
    one = np.uint64(1)
    mask = one << (items & np.uint64(63)) | one << (items >> np.uint64(6) & np.uint64(63)) | one << (items >> np.uint64(12) & np.uint64(63))
    return ((items >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64), mask


def _second(items: np.ndarray) -> np.ndarray:
    return mix64(items + _PREV)


def segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words of a bucket's segment."""
    l = level(counts)  # noqa: E741
    n = int(l.sum())
    out = np.zeros(max(1, -(-n * ITEM_BITS // 64)), np.uint64)
    items = _items(np.repeat(keys, l), np.arange(n) - np.repeat(ragged(l)[:-1], l) + 1)
    for part in (items, _second(items)):
        word, mask = _place(part, np.uint64(len(out)))
        np.bitwise_or.at(out, word, mask)
    return out


def _segment(table: pa.Table) -> pa.Table:
    """A bucket's segment, with the exact counts of its words."""
    keys, counts = _read(table)
    words = table.filter(pc.equal(table["kind"], 0))
    word_keys, word_counts = _read(words) if len(words) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    row = {"bucket": [table["bucket"][0].as_py()], "bits": [segment(keys, counts).tobytes()], "keys": [word_keys.tobytes()], "counts": [word_counts.astype(np.uint32).tobytes()]}
    return pa.table(row, schema=pa.schema([("bucket", pa.int32()), ("bits", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())]))


class Filter:
    """Segments of a log-frequency Bloom filter in one array: those of all buckets, or of some."""

    def __init__(self, segments: dict[int, pa.Buffer | bytes], buckets: int):
        self.buckets = buckets
        empty = b"\0" * 8
        parts = [np.frombuffer(segments.get(b, empty), np.uint64) for b in range(buckets)]
        self.size, self.start = np.array([len(x) for x in parts], np.uint64), ragged(np.array([len(x) for x in parts], np.int64))[:-1]
        self.data = np.concatenate(parts)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level up to which all items are present; 0 if the first is absent."""
        found, todo, l = np.zeros(len(keys), np.uint8), np.arange(len(keys)), 1  # noqa: E741
        bucket = bucket_of(keys, self.buckets)
        size, start = self.size[bucket], self.start[bucket]
        while len(todo) and l < 64:
            items, on = _items(keys[todo], l), todo
            for again in (False, True):
                items = _second(items) if again else items
                word, mask = _place(items, size[on])
                hit = self.data[start[on] + word] & mask == mask
                on, items = on[hit], items[hit]
            found[on] = l
            todo, l = on, l + 1  # noqa: E741
        return found


def middle(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range (level 1 is the count 1)."""
    return np.where(levels > 1, 0.75 * 2.0**levels, levels.astype(float))


def _scores(keys: np.ndarray, n: np.ndarray, level_of: Callable, exact_of: Callable, total: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(model's score, base score, known tokens) of each text of tokens `keys`, `n` of them in each."""
    before, both = pairs(keys, n)
    unique, back = np.unique(keys, return_inverse=True)
    exact = exact_of(unique)
    known, base = (exact > 0).astype(np.int64)[back], np.log10((exact + 1.0) / (total + vocabulary + 1))[back]
    seen = middle(level_of(unique))[back]
    seen_before = np.empty_like(seen)
    seen_before[1:] = seen[:-1]
    seen_before[ragged(n)[:-1]] = middle(level_of(np.array([END])))[0]  # every text begins once and ends once
    p1 = (seen + 1) / (total + vocabulary + 1)
    joint = np.minimum(middle(level_of(both)), seen_before)
    score = np.log10((joint + MU * p1) / (seen_before + MU))
    return scan.text_sums(score, n), scan.text_sums(base, n), scan.text_sums(known, n)


def found_at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of wanted keys among ascending keys; 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], values.dtype.type(0))


def _score(batch: dict, shared, words, total: int, vocabulary: int) -> dict:
    """Scores of texts with the whole filter and the exact counts at hand."""
    model, (word_keys, word_counts) = shared.value, words.value
    parts, lengths = [], []
    for _, _, block in scan.blocks(batch["_text"], lower=True):
        keys, n = tokens(block)
        parts.append(_scores(keys, n, model.levels, lambda u: found_at(word_keys, word_counts, u), total, vocabulary))
        lengths.append(n)
    score, base, known = (np.concatenate(x) for x in zip(*parts))
    return {"_id": batch["_id"], "_n": np.concatenate(lengths), "_score": score, "_known": known, "_base": base}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as rows (block, ids, numbers of tokens, distinct words, tokens as places among them); a block's number holds its task's."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def row() -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        n = np.concatenate([h[1] for h in held])
        words, tokens = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (n.astype(np.int64), words, tokens.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *binary], ["block", "ids", "n", "words", "tokens"])

    for batch in batches:
        for first, last, block in scan.blocks(batch.column(1), lower=True):
            keys, n = tokens(block)
            held.append((batch.column(0).slice(first, last - first), n, keys))
            size += len(keys)
            if size >= HELD:
                yield row()
                number, held, size = number + 1, [], 0
    if held:
        yield row()


def _wanted(n: np.ndarray, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of a block, its distinct words and the end, its distinct bigrams), both ascending."""
    keys = words[places]
    return keys, np.unique(np.append(words, END)), np.unique(pairs(keys, n)[1])


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["n"], np.int64), np.frombuffer(row["words"], np.uint64), np.frombuffer(row["tokens"], np.uint32)


def _asked(buckets: int):
    """Rows (bucket, block, kind, keys): the distinct words (0) and bigrams (1) of each block, dealt by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, wanted in enumerate(_wanted(*_arrays(row))[1:]):
                    cut = np.searchsorted(bucket_of(wanted, buckets), np.arange(buckets + 1))
                    rows = np.flatnonzero(np.diff(cut)).tolist()
                    for i in range(0, len(rows), 256):
                        part = rows[i : i + 256]
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([row["block"]] * len(part), pa.int64()), pa.array([kind] * len(part), pa.int32()), pa.array([wanted[cut[b] : cut[b + 1]].tobytes() for b in part], pa.binary())], ["bucket", "block", "kind", "keys"])

    return run


ANSWER = "block bigint, kind int, bucket int, levels binary, counts binary"


def _answered(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Levels of what blocks ask of one bucket, in the order asked, and exact counts of its words."""
    out = {c: [] for c in ("block", "kind", "bucket", "levels", "counts")}
    model = Filter({0: held["bits"][0].as_buffer()}, 1) if len(held) else Filter({}, 1)
    words, counts = (np.frombuffer(held[c][0].as_buffer(), t) if len(held) else np.zeros(0, t) for c, t in (("keys", np.uint64), ("counts", np.uint32)))
    for row in asked.to_pylist():
        keys = np.frombuffer(row["keys"], np.uint64)
        out["levels"].append(model.levels(keys).tobytes())
        out["counts"].append(b"" if row["kind"] else found_at(words, counts, keys).tobytes())
        for c in ("block", "kind", "bucket"):
            out[c].append(row[c])
    return pa.table(out, schema=pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("levels", pa.binary()), ("counts", pa.binary())]))


def _gathered(total: int, vocabulary: int):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        """Scores of a block's texts from the answers to what it asked."""
        n, words, places = _arrays(block.select(["n", "words", "tokens"]).to_pylist()[0])
        keys, unigrams, bigrams = _wanted(n, words, places)
        rows = sorted(answers.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        join = lambda name, kind, of: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in rows if r["kind"] in of)])
        exact, levels = join("counts", np.uint32, (0,)), [join("levels", np.uint8, (k,)) for k in (0, 1)]
        if len(exact) != len(unigrams) or len(levels[1]) != len(bigrams):
            raise ValueError("a block's answers are not whole")
        asked = np.concatenate([unigrams, bigrams])
        order = np.argsort(asked, kind="stable")
        asked, levels = asked[order], np.concatenate(levels)[order]
        score, base, known = _scores(keys, n, lambda x: found_at(asked, levels, x), lambda x: found_at(unigrams, exact, x), total, vocabulary)
        return pa.table({"_id": block["ids"].combine_chunks().flatten(), "_n": pa.array(n), "_score": pa.array(score), "_known": pa.array(known), "_base": pa.array(base)})

    return run


def scored(docs: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """_id, _n (tokens with the end), _known, _total (training tokens), _base, _score of every whole text.

    Learns from rows for which `learn` (over `_id`) holds, all of them. Null and empty texts are one end token; repeated rows count
    as often as they occur in learning and are scored each; with nothing to learn every count is 0; an empty table gives an empty
    result; other columns are not read. Texts of any length are read whole; a long one is a block by itself. N-grams travel merged,
    as blocks of a hash bucket, so a frequent word is one entry of a block. `most_bytes` chooses the way, never a score: up to it
    the filter is broadcast, beyond it n-grams are sent to the filter's segments.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    buckets = buckets_for(rows)
    with Scratch(spark) as scratch:
        counted = rows.filter(learn).select("_text").mapInArrow(_counted(buckets), "kind int, bucket int, keys binary, counts binary")
        merged = counted.groupBy("kind", "bucket").applyInArrow(_merged, "kind int, bucket int, keys binary, counts binary, total bigint, distinct bigint")
        merged = scratch.written(merged, "ngrams")
        words = merged.filter("kind = 0").agg(F.sum("total").alias("t"), F.sum("distinct").alias("v")).collect()[0]
        total, vocabulary = words.t or 0, words.v or 0
        held = merged.groupBy("bucket").applyInArrow(_segment, "bucket int, bits binary, keys binary, counts binary")
        held = scratch.written(held, "segments")
        scratch.drop(merged)
        size = held.agg(F.sum(F.length("bits") + F.length("keys") + F.length("counts"))).collect()[0][0] or 0
        kind = rows.schema["_id"].dataType.simpleString()
        schema = f"_id {kind}, _n bigint, _score double, _known bigint, _base double"
        if size <= most_bytes:
            out = map_batches(rows, _score, schema, *_broadcast(held, buckets), total, vocabulary)
        else:
            blocks = scratch.written(rows.mapInArrow(_blocks, f"block bigint, ids array<{kind}>, n binary, words binary, tokens binary"), "blocks")
            asked = blocks.drop("ids").mapInArrow(_asked(buckets), "bucket int, block bigint, kind int, keys binary")
            answers = scratch.written(asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(_answered, ANSWER), "answers")
            out = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_gathered(total, vocabulary), schema), "scores")
    return out.select("_id", "_n", "_known", F.lit(total).cast("long").alias("_total"), "_base", "_score")


def _broadcast(held: DataFrame, buckets: int) -> tuple:
    """The whole filter and the exact counts, ascending by word, on every executor; they pass the driver as Arrow buffers."""
    context = held.sparkSession.sparkContext
    table = held.select("bucket", "keys", "counts").toArrow().sort_by("bucket")
    words = context.broadcast([np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_buffer(), t) for x in table[c])]) for c, t in (("keys", np.uint64), ("counts", np.uint32))])
    del table
    trim()
    table = held.select("bucket", "bits").toArrow()
    model = Filter({b: x.as_buffer() for b, x in zip(table["bucket"].to_pylist(), table["bits"])}, buckets)
    del table
    trim()
    return context.broadcast(model), words


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. A row without an id has no remainder: its held_out is null and nothing is learned from it."""
    found = scored(prepared(spark).read.parquet(f"{sf_dir}/documents.parquet"), share("_id", 7) != 2)
    return found.select(
        F.col("_id").alias("doc_id"), (share("_id", 7) == 2).alias("held_out"), F.col("_n").alias("n_tokens"), F.col("_known").alias("n_known"), F.col("_total").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"),
    )
