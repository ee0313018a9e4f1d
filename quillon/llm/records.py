"""Token ids in length-delimited binary records with a separate offset index.

A shard `shard-NNNNN.rec` is a sequence of frames:  length u64 | masked crc32c(length) u32 | payload | masked crc32c(payload) u32,
all little-endian; the payload is the ids of one document as u16 (vocabularies up to 65,536 ids) or u32. Its index
`shard-NNNNN.idx` has one 33-byte entry for each frame in the same order:  doc_id i64 | has_id u8 | offset u64 | n_ids u64 |
start u64, where start counts the ids before this document in its shard. `manifest.json` names the shards in order, with their
numbers of documents and ids, so any record can be read on its own for shuffled reads. A shard is written under a name of its
task attempt and then moved, so a repeated or speculative task leaves one whole shard.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import regex
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import scan
from quillon.llm.common import cleaning, held, planned_bytes, prepared, ragged, shared_path, working
from quillon.llm.token_count import byte_characters

END_ID = 1
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("n_ids", "<u8"), ("start", "<u8")])
#: Fixed values of the record framing: the Castagnoli polynomial (reflected) and the mask's constant.
CASTAGNOLI, MASK_DELTA = 0x82F63B78, 0xA282EAD8


#: Shards of one data set, which is what its manifest and the driver list; ids that are sampled for their borders.
MOST_SHARDS, SAMPLE = 100_000, 1_000_000


# --- checksums ---------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _crc_tables() -> np.ndarray:
    """tables[k][b]: effect of byte b, k bytes before the end of an 8-byte step."""
    tables = np.zeros((8, 256), np.uint32)
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(CASTAGNOLI), row >> 1).astype(np.uint32)
    tables[0] = row
    for k in range(1, 8):
        tables[k] = (tables[k - 1] >> 8) ^ row[tables[k - 1] & 0xFF]
    return tables


def _crc_zeros(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The raw registers after n_bytes zero bytes each, by squaring the linear map of one zero byte."""
    columns = _zero_maps(int(n_bytes.max()).bit_length()) if len(n_bytes) else []
    out = crc.copy()
    for k, column in enumerate(columns):
        rows = np.flatnonzero(n_bytes >> k & 1)
        out[rows] = np.bitwise_xor.reduce(np.where(out[rows][:, None] >> np.arange(32, dtype=np.uint32) & 1, column[None, :], 0), axis=1).astype(np.uint32)
    return out


@lru_cache(maxsize=64)
def _zero_maps(n: int) -> list[np.ndarray]:
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    maps = [(one >> 8) ^ _crc_tables()[0][one & 0xFF]]
    while len(maps) < n:
        m = maps[-1]
        maps.append(np.bitwise_xor.reduce(np.where(m[:, None] >> np.arange(32, dtype=np.uint32) & 1, m[None, :], 0), axis=1).astype(np.uint32))
    return maps


#: Bytes of a piece that is summed by itself; pieces of all records advance together.
PIECE = 512


def crc32c(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32c of ragged byte rows: all rows' pieces of PIECE bytes step together, then a row's pieces are joined linearly."""
    tables, starts = _crc_tables(), ragged(lengths)
    n_pieces = -(-lengths // PIECE)
    if not n_pieces.sum():
        return np.zeros(len(lengths), np.uint32)
    row = np.repeat(np.arange(len(lengths)), n_pieces)
    number = np.arange(len(row)) - np.repeat(ragged(n_pieces)[:-1], n_pieces)
    # the row's first piece is the short one, padded with zeros in front: zeros leave an empty register as it is
    short = np.where(n_pieces > 0, lengths - (n_pieces - 1) * PIECE, 0)
    end = starts[:-1][row] + short[row] + number * PIECE
    at = end[:, None] + np.arange(-PIECE, 0)
    block = np.where((at >= starts[:-1][row][:, None]) & (at >= 0), data[np.maximum(at, 0)], 0).astype(np.uint8)
    block = np.ascontiguousarray(block.T)
    crc = np.zeros(len(row), np.uint32)
    for i in range(0, PIECE, 8):
        step = tables[7][block[i] ^ (crc & 0xFF)]
        for k in range(1, 4):
            step = step ^ tables[7 - k][block[i + k] ^ (crc >> np.uint32(8 * k) & 0xFF)]
        for k in range(4, 8):
            step = step ^ tables[7 - k][block[i + k]]
        crc = step
    # joined from the left: register = zeros(register, PIECE) xor piece; rows of equal number of pieces advance together
    out, firsts = np.zeros(len(lengths), np.uint32), ragged(n_pieces)[:-1]
    for j in range(int(n_pieces.max())):
        rows = np.flatnonzero(n_pieces > j)
        before = out[rows] if not j else _crc_zeros(out[rows], np.full(len(rows), PIECE))
        out[rows] = before ^ crc[firsts[rows] + j]
    # a register that begins with all ones adds the effect of those ones through all bytes of the row
    out = out ^ _crc_zeros(np.full(len(lengths), 0xFFFFFFFF, np.uint32), lengths) ^ np.uint32(0xFFFFFFFF)
    return np.where(lengths > 0, out, 0).astype(np.uint32)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


# --- encoding ----------------------------------------------------------------------------------------------------------------


class Ragged:
    """Growing rows of ids: flat values and offsets."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self._flat, self._offsets = flat.astype(np.uint32), ragged(lengths)
        self.n, self.size = len(lengths), len(flat)

    @property
    def flat(self) -> np.ndarray:
        return self._flat[: self.size]

    @property
    def offsets(self) -> np.ndarray:
        return self._offsets[: self.n + 1]

    def extend(self, more: Ragged) -> Ragged:
        if self.size + more.size > len(self._flat):
            self._flat = np.concatenate([self.flat, np.zeros(self.size + 2 * more.size, np.uint32)])
        if self.n + more.n + 1 > len(self._offsets):
            self._offsets = np.concatenate([self.offsets, np.zeros(self.n + 2 * more.n, np.int64)])
        self._flat[self.size : self.size + more.size] = more.flat
        self._offsets[self.n + 1 : self.n + 1 + more.n] = more.offsets[1:] + self.size
        self.n, self.size = self.n + more.n, self.size + more.size
        return self

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of rows `at` in turn, and how many each row has."""
        first = self._offsets[at]
        counts = self._offsets[at + 1] - first
        return self._flat[np.repeat(first - ragged(counts)[:-1], counts) + np.arange(int(counts.sum()))], counts


class Encoder:
    """Ids as the tokenizers library gives them for a whole text, with the library's model run once for each distinct piece.

    Every white-space character ends a piece in the file's own pre-tokenizer, and its normaliser acts within words, so the ids of a
    text are those of its words in turn. Only special strings reach over that; they are cut out first, as the library does.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = spec["pre_tokenizer"].get("pretokenizers", [{}])
        if kinds != ["NFC", "Replace", "Lowercase"] or splits[0].get("pattern", {}).get("Regex") != self.PATTERN or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: its normaliser or pre-tokenizer is not known")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pattern = self.tokenizer.model, regex.compile(self.PATTERN.replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.marks = {k[:2].encode() for k in self.special}
        self.wide = max(max(spec["model"]["vocab"].values()), *self.special.values(), END_ID) > 0xFFFF
        self.shown = dict(enumerate(byte_characters()))
        self.limit, self.memo = limit, scan.Memo(self._words, limit, Ragged.extend)
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, int] = {}
        self.piece_ids = Ragged(np.zeros(0), np.zeros(0, np.int64))

    def _words(self, new: list[bytes]) -> Ragged:
        # lower-cased character by character, as the library does: no special final sigma
        text = unicodedata.normalize("NFC", b" ".join(new).decode("utf-8")).replace("Σ", "σ").lower()
        split = self.pattern.findall
        found = [(w,) if w.isalpha() else split(w) for w in text.split(" ")]
        fresh = set(chain.from_iterable(found)).difference(self.pieces)
        if len(self.pieces) + len(fresh) > self.limit:
            self._forget()
            fresh = set(chain.from_iterable(found))
        fresh = list(fresh)
        shown = [p if p.isascii() and p.isprintable() else p.encode("utf-8").decode("latin-1").translate(self.shown) for p in fresh]
        ids = [[t.id for t in self.model.tokenize(p)] for p in shown]
        self.pieces.update(zip(fresh, range(len(self.pieces), len(self.pieces) + len(fresh))))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.piece_ids.extend(Ragged(np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths))
        n = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
        flat, counts = self.piece_ids.rows(at)
        return Ragged(flat, scan.text_sums(counts, n))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, with END_ID after each text; number of ids of each text)."""
        flats, counts = [], []
        for first, last, block in scan.blocks(texts):
            data = block.data.tobytes()
            if any(m in data for m in self.marks) and self.cut.search(data.decode("utf-8")):
                parts = [self._cut_out(texts[i].as_py() or "") for i in range(first, last)]
                flat, n = np.concatenate([p for p in parts]), np.fromiter(map(len, parts), np.int64, len(parts))
            else:
                flat, n = self._block(block)
            flats.append(np.insert(flat, ragged(n)[1:], END_ID))
            counts.append(n + 1)
        return (np.concatenate(flats), np.concatenate(counts)) if counts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _block(self, block: scan.Block) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = scan.words(block)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(block.offsets) - 1, np.int64)
        at = self.memo(block, starts, ends)
        flat, n = self.memo.values.rows(at)
        return flat, scan.text_sums(n, block.per_text(starts))

    def _cut_out(self, text: str) -> np.ndarray:
        out = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                out.append(np.array([self.special[part]], np.uint32))
            else:
                out += [self._block(b)[0] for _, _, b in scan.blocks(pa.array([part]))]
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def encoder(path: str) -> Encoder:
    return held(("records", path), lambda: Encoder(path))


# --- files -------------------------------------------------------------------------------------------------------------------


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


def frames(ids: np.ndarray, counts: np.ndarray, wide: bool) -> tuple[bytes, np.ndarray]:
    """Framed records of ragged ids, and their lengths in bytes."""
    payload = ids.astype("<u4" if wide else "<u2").view(np.uint8)
    lengths = counts * (4 if wide else 2)
    head = np.zeros((len(counts), 12), np.uint8)
    head[:, :8] = lengths.astype("<u8").view(np.uint8).reshape(-1, 8)
    head[:, 8:] = masked(crc32c(head[:, :8].reshape(-1), np.full(len(counts), 8))).astype("<u4").view(np.uint8).reshape(-1, 4)
    tail = masked(crc32c(payload, lengths)).astype("<u4").view(np.uint8).reshape(-1, 4)
    at, out = ragged(lengths), []
    for i in range(len(counts)):
        out += (head[i].tobytes(), payload[at[i] : at[i + 1]].tobytes(), tail[i].tobytes())
    return b"".join(out), lengths + 16


def read_shard(fs: pafs.FileSystem, path: str, wide: bool, chunk: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index entries, ids, ids of each) of a shard, some documents at a time, with both checksums proved."""
    index = np.frombuffer(fs.open_input_stream(f"{path}.idx").read(), ENTRY)
    with fs.open_input_file(f"{path}.rec") as f:
        for at in range(0, len(index), chunk):
            part = index[at : at + chunk]
            payload = part["n_ids"].astype(np.int64) * (4 if wide else 2)
            start, end = int(part["offset"][0]), int(part["offset"][-1]) + int(payload[-1]) + 16
            f.seek(start)
            data = np.frombuffer(f.read(end - start), np.uint8)
            begin = part["offset"].astype(np.int64) - start
            head = data[begin[:, None] + np.arange(12)]
            tail = data[(begin + 12 + payload)[:, None] + np.arange(4)]
            if (head[:, :8].copy().view("<u8")[:, 0].astype(np.int64) != payload).any() or (head[:, 8:].copy().view("<u4")[:, 0] != masked(crc32c(head[:, :8].reshape(-1), np.full(len(part), 8)))).any():
                raise ValueError(f"{path}: a record's length is damaged")
            body = data[np.repeat(begin + 12 - ragged(payload)[:-1], payload) + np.arange(int(payload.sum()))]
            if (tail.copy().view("<u4")[:, 0] != masked(crc32c(body, payload))).any():
                raise ValueError(f"{path}: a record is damaged")
            yield part, body.view("<u4" if wide else "<u2").astype("<u4"), part["n_ids"].astype(np.int64)


class _Shard:
    """A shard that is being written."""

    def __init__(self, fs: pafs.FileSystem, name: str):
        self.fs, self.name, self.attempt = fs, name, uuid.uuid4().hex
        self.index, self.offset, self.start, self.n_docs = [], 0, 0, 0
        self.out = fs.open_output_stream(f"{name}.rec.{self.attempt}")

    def add(self, key: pa.Array, ids: np.ndarray, counts: np.ndarray, wide: bool) -> None:
        data, lengths = frames(ids, counts, wide)
        self.out.write(data)
        entry = np.zeros(len(counts), ENTRY)
        entry["doc_id"], entry["has_id"] = key.fill_null(0).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False)
        entry["offset"], entry["n_ids"], entry["start"] = self.offset + ragged(lengths)[:-1], counts, self.start + ragged(counts)[:-1]
        self.index.append(entry.tobytes())
        self.offset, self.start, self.n_docs = self.offset + int(lengths.sum()), self.start + int(counts.sum()), self.n_docs + len(counts)

    def close(self) -> None:
        self.out.close()
        with self.fs.open_output_stream(f"{self.name}.idx.{self.attempt}") as f:
            f.write(b"".join(self.index))
        for kind in ("rec", "idx"):
            if self.fs.get_file_info(f"{self.name}.{kind}").type != pafs.FileType.NotFound:
                self.fs.delete_file(f"{self.name}.{kind}")
            self.fs.move(f"{self.name}.{kind}.{self.attempt}", f"{self.name}.{kind}")


def _writer(uri: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working():
            done = list(_written(batches, *filesystem(uri), encoder(tokenizer)))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int32(), pa.int64(), pa.int64(), pa.int32()))], ["shard", "n_docs", "n_ids", "id_bytes"])

    return run


def _written(batches: Iterator[pa.RecordBatch], fs: pafs.FileSystem, root: str, enc: Encoder) -> Iterator[tuple]:
    """(number, documents, ids, bytes of an id) of each shard that was written from batches in order of shards."""
    shard, number = None, -1

    def closed() -> tuple:
        shard.close()
        return number, shard.n_docs, shard.start, 4 if enc.wide else 2

    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else []
        for a, b in zip(cuts, cuts[1:]):
            if shard is None or numbers[a] != number:
                if shard is not None:
                    yield closed()
                number = int(numbers[a])
                shard = _Shard(fs, f"{root}/shard-{number:05d}")
            part = batch.slice(a, b - a)
            shard.add(part.column(1), *enc.encode(part.column(2)), enc.wide)
    if shard is not None:
        yield closed()


def _reader(uri: str, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(uri)
        for batch in batches:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for entry, ids, counts in read_shard(fs, f"{root}/shard-{shard:05d}", wide):
                    data, at = memoryview(ids.view(np.uint8)), ragged(counts * 4)
                    crcs = [zlib.crc32(data[at[i] : at[i + 1]]) for i in range(len(counts))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(entry["doc_id"], pa.int64(), mask=entry["has_id"] == 0), pa.array(entry["start"].astype(np.int64) + before), pa.array(counts), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def n_shards(docs: DataFrame, each: int) -> int:
    """How many shards give some `each` bytes to one; at most MOST_SHARDS, which are then larger."""
    return min(MOST_SHARDS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-planned_bytes(docs) // each)))


def by_order(docs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """docs (_id, _text) with _hash and a _shard that ascends with (_id, _hash), null ids last, and the number of shards.

    Borders are quantiles of a sample of at most some SAMPLE ids; they only decide how even the shards are. An id that fills several
    shards, and rows without an id, are dealt over as many by ranges of the text's hash.
    """
    docs = docs.withColumn("_hash", F.shiftrightunsigned(F.xxhash64("_text"), 1))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    ids = docs.select("_id").sample(share, 7).toArrow()["_id"].combine_chunks()
    known = np.sort(ids.drop_null().to_numpy(zero_copy_only=False))
    without = max(1, round(n * ids.null_count / max(1, len(ids))))
    n = max(1, n - without)
    quantiles = known[np.arange(1, n) * len(known) // n] if len(known) else known
    borders, times = np.unique(quantiles, return_counts=True)
    borders, first = np.unique(borders.astype(np.float64), return_index=True)  # ids beyond 2**53 that doubles don't tell apart share a border
    times = np.add.reduceat(times, first).tolist() if len(first) else []
    exact = np.unique(quantiles)[first].tolist()
    base = [0, *(1 + np.concatenate([[0], np.cumsum(times)])[:-1]).tolist()] if times else [0]
    last = 1 + sum(times)
    ranged = F.shiftrightunsigned("_hash", 32)
    slot = F.lit(0)
    if times:
        splits = [-float("inf"), *borders.tolist(), float("inf")]
        docs = Bucketizer(splits=splits, inputCol="_d", outputCol="_at", handleInvalid="keep").transform(docs.withColumn("_d", F.col("_id").cast("double")))
        at = F.col("_at").cast("int")
        begin, copies = F.element_at(F.lit(base), at + 1), F.element_at(F.lit([1, *times]), at + 1)
        on_border = F.element_at(F.lit([None, *exact]), at + 1) == F.col("_id")
        slot = F.when(copies == 1, begin).when(on_border, begin + F.shiftright(ranged * (copies - 1), 31)).otherwise(begin + copies - 1)
    slot = F.when(F.col("_id").isNull(), last + F.shiftright(ranged * without, 31)).otherwise(slot)
    return docs.withColumn("_shard", slot.cast("int")).select("_shard", "_id", "_hash", "_text"), last + without


def write_records(docs: DataFrame, tokenizer: str, uri: str, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = 8 << 20) -> dict:
    """Write docs' ids as shards under uri in ascending doc_id order (equal ids by their texts' hash, null ids last) and return the manifest.

    Null and empty texts become a record with the end id alone, texts of any length one record; repeated rows are records each; an
    empty table gives a manifest without shards; other columns are not read. Texts move once, into shards of about equal numbers of
    documents; a task holds one batch of texts and its shard's index, and gives back one row for each shard. That, and the sample for
    the shards' borders, is all that reaches the driver.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    ranged, shards = by_order(slim, n_shards(slim, shard_bytes))
    fs, root = filesystem(uri)
    fs.create_dir(root)
    dealt = ranged.repartitionById(shards, F.col("_shard")).sortWithinPartitions("_shard", "_id", "_hash", "_text")
    with cleaning(docs.sparkSession):
        done = dealt.select("_shard", "_id", "_text").mapInArrow(_writer(uri, tokenizer), "shard int, n_docs bigint, n_ids bigint, id_bytes int").collect()
    before, listed = 0, []
    for r in sorted(done, key=lambda r: r.shard):
        listed.append({"shard": r.shard, "n_docs": r.n_docs, "n_ids": r.n_ids, "start": before})
        before += r.n_ids
    manifest = {"version": 1, "id_bytes": max((r.id_bytes for r in done), default=2), "end_id": END_ID, "shards": listed}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_records(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record under uri; start counts the ids of all records before it.

    Raises ValueError at a record whose checksums don't agree.
    """
    fs, root = filesystem(uri)
    manifest = json.loads(fs.open_input_stream(f"{root}/manifest.json").read())
    shards = [(s["shard"], s["start"], i) for i, s in enumerate(manifest["shards"])]
    listed = spark.createDataFrame(shards, "shard int, start bigint, i int")
    listed = listed.repartitionById(max(1, len(shards)), F.col("i")).select("shard", "start")
    return listed.mapInArrow(_reader(uri, manifest["id_bytes"] == 4), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs written as records to a new folder of the shared place and read back."""
    spark = docs.sparkSession
    uri = shared_path(spark, "records")
    write_records(docs, tokenizer, uri)
    return read_records(spark, uri)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
