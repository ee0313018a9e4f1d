"""The ten operators against brute force on small tables, and on odd and empty tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import decontaminate, fingerprint, language_id, mixing, near_dedup, ngram_lm, quality, records, sampling, scan, token_count, toxicity
from quillon.llm.common import Scratch, share

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"
N_ODD = 15


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """Smallest reachable id of each id, over all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_words_are_split_as_by_bytes():
    texts = ["A b\x0bC\x1cd \n", "", None, "é x  Y", " "]
    block = next(scan.blocks(pa.array(texts), lower=True))[2]
    starts, ends = scan.words(block)
    want = [(t or "").encode().lower().split() for t in texts]
    assert [block.span(a, b) for a, b in zip(starts, ends)] == [w for x in want for w in x]
    assert block.per_text(starts).tolist() == [len(x) for x in want]


def test_near_dedup(docs, rows, odd, empty):
    got = {r._id: (r._root, r._n) for r in near_dedup.near_groups(docs).collect()}
    root, size = components(rows)
    assert got == {i: (root[i], size[i]) for i in root}
    found = near_dedup.near_groups(odd).collect()
    assert len(found) == N_ODD and near_dedup.near_groups(empty).count() == 0
    by = defaultdict(set)
    for r in found:
        by[r._id].add(r._root)
    assert by[2] == by[3] == by[12] == {1} and by[8] == {7} and by[4] == {4} and by[6] == {6} and by[None] == {None}
    assert near_dedup.distinct_documents(odd).count() == 10 and near_dedup.distinct_documents(odd).columns == odd.columns


def test_near_dedup_chain_and_star(spark):
    """A chain of near texts is one component though its ends are far, and so is a star whose rays are not near each other."""
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words[k * 3 : k * 3 + 60]) for k in range(12)]
    star = [" ".join(words)] + [" ".join(words[:10 * k] + [f"new{k}"] + words[10 * k + 1 :]) for k in range(1, 10)]
    rows = [(i, t) for i, t in enumerate(chain)] + [(100 + i, t + " end") for i, t in enumerate(star)]
    root, _ = components(rows)
    got = {r._id: r._root for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root and root[11] == 0


def test_near_dedup_of_texts_with_a_common_passage(spark):
    """Texts just too far from each other share a passage; a few pairs also share one word and are near. Hardly a centre is one of these."""
    passage = " ".join(f"p{k}" for k in range(174))
    tail = lambda i, first: " ".join([first, *(f"u{i}x{k}" for k in range(28))])
    rows = [(i, f"{passage} {tail(i, f's{i % 290}')}") for i in range(300)]
    root, _ = components(rows)
    assert {i: r for i, r in root.items() if r != i} == {290 + k: k for k in range(10)}
    got = {r._id: r._root for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_near_dedup_of_many_short_texts_in_one_batch(spark):
    """Spark's own batches hold thousands of rows; a block takes 256 of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    rows = [(i, f"text {i % 600} has these words") for i in range(1200)]
    got = {r._id: (r._root, r._n) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {i: (i % 600, 1) for i in range(1200)}


def test_near_dedup_recall(spark):
    """All links of sf0.01, by pairs that share a shingle."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingle_set(r.text) for r in table.select("doc_id", "text").collect()}
    by, shared, root = defaultdict(list), Counter(), {i: i for i in sets}
    for i in sorted(sets):
        for x in sets[i]:
            by[x].append(i)
    for ids in by.values():
        shared.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in near_dedup.op3_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert len(links) > 50 and {i: r.component_id for i, r in got.items()} == {i: find(i) for i in sets}
    assert all(r.kept == (i == r.component_id) and r.n_shingles == len(sets[i]) for i, r in got.items())


def test_leaks(spark, docs, odd, empty):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = {(r._id, r.item_id): r.n_shared for r in decontaminate.leaks(docs, items).collect()}
    item_sets = {r.item_id: shingle_set(r.text) for r in items.collect()}
    want = {}
    for r in docs.collect():
        s = shingle_set(r.text)
        for k, m in item_sets.items():
            if len(s & m) >= 0.75 * len(m):
                want[r.doc_id, k] = len(s & m)
    assert got == want and want
    odd_items = spark.createDataFrame([(1, "beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "one two"), (None, "beta gamma delta epsilon zeta"), (1, "nothing of the kind is there")], "item_id int, text string")
    pairs = {(r._id, r.item_id) for r in decontaminate.leaks(odd, odd_items).collect()}
    assert pairs == {(i, k) for i in (1, 2, 3, 12, None) for k in (1, None)} | {(7, 4), (8, 4)}
    kept = decontaminate.clean(odd, odd_items)
    assert kept.count() == N_ODD - 8 and kept.columns == odd.columns
    assert decontaminate.leaks(empty, odd_items).count() == 0 and decontaminate.leaks(odd, odd_items.limit(0)).count() == 0
    with Scratch(spark) as scratch:
        plan = decontaminate._leaks(odd, odd_items, "doc_id", "text", "item_id", "text", 0.75, scratch)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" in plan
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared, r.containment) for r in decontaminate.op8_decontamination(spark, FOLDER).collect()}
    assert got == {k: (len(item_sets[k[1]]), n, round(n / len(item_sets[k[1]]), 6)) for k, n in want.items()}


def test_leaks_beyond_the_broadcast_bounds(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    want = {(r._id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "MOST_SKETCHES", 0)
    monkeypatch.setattr(decontaminate, "MOST_CHARS", 0)
    assert {(r._id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == want


def test_mixing(docs, odd, empty):
    sizes, sources = {}, defaultdict(int)
    for r in docs.collect():
        sizes[r.doc_id] = len((r.text or "").encode().split())
        sources[r.source] += sizes[r.doc_id]
    rows = mixing.mix(docs).collect()
    assert {r._id: r._size for r in rows} == sizes and rows == mixing.mix(docs).collect()
    taken = Counter()
    for r in rows:
        assert r._source_size == sources[r._group] and 0 <= r._copies <= 3
        taken[r._group] += r._copies * r._size
    for r in rows:
        assert r._target <= 3 * r._source_size + 1e-6 and abs(taken[r._group] - r._target) <= 0.02 * r._target + 50
    assert abs(sum({r._group: r._target for r in rows}.values()) - sum(sizes.values())) < 1e-3
    assert mixing.mix(odd).count() == N_ODD and mixing.mix(empty).count() == 0
    assert {r._copies for r in mixing.mix(odd).collect() if not r._size} == {0}
    out = mixing.taken(odd)
    assert out.columns == odd.columns and out.count() == mixing.mix(odd).agg(F.sum("_copies")).collect()[0][0]
    got = {r.doc_id: r for r in mixing.op7_mixing(docs.sparkSession, FOLDER).collect()}
    assert {i: (r.size, r.source_size) for i, r in got.items()} == {r._id: (r._size, r._source_size) for r in rows}
    assert {i: r.taken for i, r in got.items()} == {r._id: r._copies * r._size for r in rows} and all(r.taken <= 3 * r.size for r in got.values())
    names = sorted(sources)
    goal = mixing.capped_targets([sources[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    assert all(abs(r._target - goal[names.index(r._group)]) < 1e-6 for r in rows)


def test_mixing_of_hot_sources_and_repeated_rows(spark):
    """Sources meet their targets though one has most rows, one very long text, equal rows and rows without an id; so do they in a shuffle."""
    rows = [(i, "w " * (1 + i % 37), "hot") for i in range(3000)] + [(9000, "w " * 40_000, "hot")] + [(None, "same text here", "copies")] * 500 + [(None, f"t{i} " * 5, None) for i in range(300)] + [(5, "a b c", "twice")] * 40
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    results = []
    for most in (mixing.FEW_GROUPS, 0):
        found = mixing.mix(table, most_groups=most)
        results.append(sorted((-1 if r._id is None else r._id, r._group or "", r._size, r._copies) for r in found.collect()))
        sums = found.groupBy("_group").agg(F.sum(F.col("_copies") * F.col("_size")).alias("t"), F.first("_target").alias("w"), F.max("_size").alias("m")).collect()
        assert all(abs(r.t - r.w) <= 0.01 * r.w + 3 for r in sums), sums
    assert results[0] == results[1]
    out = Counter((r.doc_id, r.source) for r in mixing.taken(table).collect())
    want = Counter()
    for i, g, _, n in results[0]:
        want[None if i == -1 else i, g or None] += n
    assert out == +want


def test_mixing_of_very_many_sources(spark):
    table = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.concat(F.lit("s"), (F.col("id") % 2500).cast("string")).alias("source"))
    rows = mixing.mix(table).collect()
    sizes = Counter(f"s{i % 2500}" for i in range(3000))
    names = sorted(sizes)
    goal = dict(zip(names, mixing.capped_targets([3 * sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3)))
    assert all(abs(r._target - goal[r._group]) < 1e-6 for r in rows) and len(rows) == 3000


def test_capped_targets():
    assert mixing.capped_targets([10, 100], [5, 2], 3) == [30, 80]
    assert mixing.capped_targets([0, 100], [5, 2], 3) == [0, 100]
    assert mixing.capped_targets([], [], 3) == []


def test_balance_of_two_families(spark):
    """Targets over sources and languages at once are met by the tilt, which needs full Newton steps."""
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 50), ("b", "x", 20), ("b", "y", 80)], "s string, l string, size long")
    v = mixing.balance(cells, ["s", "l"], {("s", "a"): 125.0, ("s", "b"): 125.0, ("l", "x"): 100.0, ("l", "y"): 150.0})
    mass = {(s, la): n * math.exp(v["s", s] + v["l", la]) for s, la, n in [tuple(r) for r in cells.collect()]}
    assert abs(mass["a", "x"] + mass["a", "y"] - 125) < 1e-4 and abs(mass["a", "x"] + mass["b", "x"] - 100) < 1e-4


def test_token_counts(docs, rows, odd, empty):
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r for r in token_count.token_counts(docs, BYTES).collect()}
    for (i, t), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        assert got[i].n_tokens == len(e.ids) and got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (len(e.ids) > 1024)
    odd_rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in odd_rows)
    assert Counter((r.doc_id, r.n_tokens) for r in token_count.token_counts(odd, BYTES).collect()) == want
    assert token_count.token_counts(empty, BYTES).count() == 0
    op10 = {r.doc_id: tuple(r) for r in token_count.op10_token_counts(docs.sparkSession, FOLDER).collect()}
    assert op10 == {i: tuple(r) for i, r in got.items()}
    strange = ["q" * 3000, "  a  b\n\n c ", "don't 'S", "\x1c\x1c x\x85y", "aaaa" * 40, "<|endoftext|>x <|endoftext|>", "日本 語", " \t\n ", " 'll"]
    assert token_count.counter(BYTES).counts(strange).tolist() == [len(e.ids) for e in library.encode_batch(strange, add_special_tokens=False)]


def test_records(spark, docs, rows, odd, empty, tmp_path):
    library, start = Tokenizer.from_file(WORDS), 0
    got = {r.doc_id: r for r in records.encoded(docs, WORDS).collect()}
    for (i, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        ids = np.array(e.ids + [1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    odd_rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in odd_rows)
    found = records.encoded(odd, WORDS).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == want
    order = sorted(found, key=lambda r: r.start)
    assert [r.start for r in order] == np.concatenate([[0], np.cumsum([r.n_tokens for r in order])])[:-1].tolist()
    assert records.encoded(empty, WORDS).count() == 0
    strange = ["İstanbul ŞIŞ", "ſharp ẞ", "a\u0301 é e\u0301", "x\u200by \u00a0z\u2003w", "Σίσυφος ΟΔΟΣ", "don't I'LL we've 'S", "123 4.5e6 ½ ²", "日本語 한국어 नमस्ते", "🙂🙃 a🙂b", "\x00\x1f\x7f", "<|endoftext|>x<|endoftext|> y", "ǅ ﬁ Å Å", "--- ___ ...", "tab\tnew\nline\r\n\x0b\x0c\x85\u2028end"]
    table = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    want = {i: zlib.crc32(np.array(e.ids + [1], "<u4").tobytes()) for i, e in enumerate(library.encode_batch(strange, add_special_tokens=False))}
    assert {r.doc_id: r.ids_crc32 for r in records.encoded(table, WORDS).collect()} == want
    assert sorted(tuple(r) for r in records.op6_token_records(spark, FOLDER).collect()) == sorted(tuple(r) for r in got.values())
    same = spark.createDataFrame([(5, f"t{k}") for k in range(50)] + [(1, "a"), (9, "z")], "doc_id long, text string")
    ids = [r.doc_id for r in sorted(records.encoded(same, WORDS).collect(), key=lambda r: r.start)]
    assert ids == [1] + [5] * 50 + [9]
    uri = f"file://{tmp_path}/r"
    records.write_records(docs, WORDS, uri)
    shard = sorted(tmp_path.glob("r/*.rec"))[0]
    data = bytearray(shard.read_bytes())
    data[20] ^= 1
    shard.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, uri).collect()


def test_crc32c():
    def plain(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rows = [b"", b"123456789", *[bytes(range(n % 256)) * (n // 256 + 1) for n in (1, 7, 8, 9, 255, 700)]]
    got = records.crc32c(np.frombuffer(b"".join(rows), np.uint8), np.array([len(r) for r in rows]))
    assert got.tolist() == [plain(r) for r in rows] and got[1] == 0xE3069283


def test_ngram_lm(spark, docs, rows, odd, empty):
    """Base scores equal plain counts, scores a plain model of quantised counts, whether the filter is broadcast or not."""
    counts, pairs, texts = Counter(), Counter(), {}
    for i, t in rows:
        texts[i] = (t or "").encode().lower().split() + [None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(texts[i])
            pairs.update(zip(["begin", *texts[i][:-1]], texts[i]))
    n, v = sum(counts.values()), len(counts)
    read = lambda c: 0.75 * 2 ** (int(math.log2(c)) + 1) if c > 1 else float(c)
    results = []
    for most in (ngram_lm.MOST_BYTES, 0):
        got = {r._id: r for r in ngram_lm.scored(docs, share("_id", 7) != 2, most_bytes=most).collect()}
        assert len(got) == len(rows)
        results.append({i: (r._n, r._known, r._total, r._base, r._score) for i, r in got.items()})
        assert ngram_lm.scored(odd, share("_id", 7) != 2, most_bytes=most).count() == N_ODD
        assert ngram_lm.scored(empty, share("_id", 7) != 2, most_bytes=most).count() == 0
    assert results[0] == results[1]
    for i, w in texts.items():
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert (got[i]._n, got[i]._known, got[i]._total) == (len(w), sum(counts[x] > 0 for x in w), n) and abs(got[i]._base - base) < 1e-9 * abs(base)
        score = 0.0
        for a, x in zip(["begin", *w[:-1]], w):
            before = read(counts[None] if a == "begin" else counts[a])
            score += math.log10((min(read(pairs[a, x]), before) + ngram_lm.MU * (read(counts[x]) + 1) / (n + v + 1)) / (before + ngram_lm.MU))
        assert abs(got[i]._score - score) < 0.02 * abs(score) + 0.5  # false positives of the filter
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(got[i]._score for i in held) > sum(got[i]._base for i in held)
    op4 = {r.doc_id: r for r in ngram_lm.op4_ngram_lm(spark, FOLDER).collect()}
    assert {i: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for i, r in op4.items()} == results[0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) for i, r in op4.items())


@pytest.mark.parametrize("buckets", [1, 4])
def test_filter_reads_levels_back(buckets):
    keys = np.sort(np.random.default_rng(0).integers(1, 2**64, 4000, dtype=np.uint64))
    counts = np.where(np.arange(4000) % 2, 1, np.random.default_rng(1).integers(2, 5000, 4000))
    at = ngram_lm.bucket_of(keys, buckets)
    f = ngram_lm.Filter({b: ngram_lm.segment(keys[at == b], counts[at == b]).tobytes() for b in range(buckets)}, buckets)
    want, got = ngram_lm.level(counts), f.levels(keys)
    assert (got >= want).all() and (got == want).mean() > 0.98
    assert ngram_lm.middle(np.array([0, 1, 2, 3])).tolist() == [0, 1, 3, 6]
    absent = np.random.default_rng(2).integers(1, 2**64, 4000, dtype=np.uint64)
    assert (f.levels(absent) > 0).mean() < 0.03 and not ngram_lm.Filter({}, buckets).levels(keys).any()


def test_fingerprints(docs, rows, odd, empty):
    got = {r.doc_id: r for r in fingerprint.with_next(docs).collect()}
    prints = {}
    for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1]):
        k = len(a) // 4
        edited = a[: len(a) - k] + b[:k]
        assert got[i].n_chars == len(a) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(a, got[i].fingerprint) == got[i].fingerprint
        if a == b:
            assert got[i].near_next == 1.0
        assert 0 <= got[i].near_edited <= 1
    assert np.median([r.near_edited for r in got.values()]) > 0.5 and np.mean([r.near_next for r in got.values()]) < 0.1
    assert len(fingerprint.with_next(odd).collect()) == N_ODD and fingerprint.with_next(empty).count() == 0
    d = {r.doc_id: r for r in fingerprint.with_next(odd).collect()}
    assert d[4].fingerprint == "" and d[4].near_next == 1.0
    op2 = {r.doc_id: r for r in fingerprint.op2_fingerprints(docs.sparkSession, FOLDER).collect()}
    assert {i: tuple(r) for i, r in op2.items()} == {i: tuple(r) for i, r in got.items()}


def naive_features(data, scale):
    """Every window ranked by itself, every run of consecutive windows voting by itself."""
    ranks = {}
    for i in range(len(data) - scale.width + 1):
        c = Counter(b & 31 for b in data[i : i + scale.width])
        total = sum(round(n * math.log2(n) * 65536) for n in c.values())
        entropy = math.log2(scale.width) - total / (scale.width * 65536)
        if entropy >= scale.weak:
            ranks[i] = 510 - min(int(np.round(abs(entropy - scale.usual) * 64)), 510)
    votes = Counter()
    for start in range(1 - scale.popular, len(data)):
        inside = [(ranks[i], i) for i in range(start, start + scale.popular) if i in ranks]
        if inside:
            votes[min(inside)[1]] += 1
    return [data[i : i + scale.width] for i in sorted(votes) if votes[i] >= scale.votes] or ([data] if data else [])


@pytest.mark.parametrize("scale", [fingerprint.WIDE, fingerprint.NARROW])
def test_features_equal_naive_ones(rows, scale):
    texts = [t for _, t in rows[:25]] + ["", "a", "short", "x" * 300, "x" * 100 + "some words in between " * 3 + "y" * 90, "é" * 40, "0123456789" * 9]
    block = next(scan.blocks(pa.array(texts), size=1 << 30))[2]
    hashes, n = fingerprint.features(block, scale)
    at = np.concatenate([[0], np.cumsum(n)])
    for k, t in enumerate(texts):
        data = t.encode()
        want = naive_features(data, scale)
        assert n[k] == len(want)
        one = next(scan.blocks(pa.array([t])))[2]
        alone = fingerprint.features(one, scale)[0] if data else np.zeros(0, np.uint64)
        assert alone.tolist() == hashes[at[k] : at[k + 1]].tolist()  # what stands around a text doesn't matter
        named = {w: h for w, h in zip(want, hashes[at[k] : at[k + 1]].tolist())}
        assert len(set(named.values())) == len(named)


def test_fingerprints_near_the_border_of_short_texts(rows):
    long = "".join(c for c in max((t for _, t in rows), key=len) if c.isascii())
    a, b = fingerprint.digests([long[: fingerprint.SHORT - 5], long[: fingerprint.SHORT + 5]])
    assert a.narrow is not None and b.narrow is None and a.likeness(b) > 0.8


def test_order_of_shards(spark):
    """Shards ascend with (id, hash), null ids last, whatever the sample; hot ids and missing ids are dealt over several."""
    rows = [(i, f"t{i}") for i in range(300)] + [(7, f"s{i}") for i in range(400)] + [(None, f"n{i}") for i in range(300)] + [(2**60 + i, "x") for i in range(20)]
    table = spark.createDataFrame(rows, "_id long, _text string").repartition(3)
    found, n = records.by_order(table, 12)
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r._shard < n for r in got)
    key = lambda r: (r._id is None, r._id or 0, r._hash, r._text)
    assert [r._shard for r in sorted(got, key=key)] == sorted(r._shard for r in got)
    assert len({r._shard for r in got if r._id == 7}) > 2 and len({r._shard for r in got if r._id is None}) > 2
    order = [(r._id, r._text) for r in sorted(got, key=key)]
    follow = fingerprint.with_next(table.selectExpr("_id doc_id", "_text text")).collect()
    after = {x: order[(k + 1) % len(order)] for k, x in enumerate(order)}
    shas = Counter(hashlib.sha256((t[: len(t) - len(t) // 4] + u[: len(t) // 4]).encode()).hexdigest() for (_, t), (_, u) in after.items())
    assert Counter(r.edited_sha256 for r in follow) == shas


def test_language(docs, odd, empty):
    tokenizer = public_tokenizers.path("piece_bpe_32k.model")
    learn = share("_id", 5) != 0
    got = {r._id: (r._lang, r._score) for r in language_id.identify(docs, tokenizer, learn).collect()}
    held = [(got[r.doc_id][0], r.lang) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.9
    out = [(r._id, r._lang, r._score) for r in language_id.identify(odd, tokenizer, learn).collect()]
    assert len(out) == N_ODD and {la for i, la, _ in out if i in (4, 5, 6, 9)} == {"und"}
    assert language_id.identify(empty, tokenizer, learn).count() == 0


def test_language_query_and_bounded_sample(spark, docs):
    got = {r.doc_id: r for r in language_id.op9_language_id(spark, FOLDER).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    learn = docs.filter(share("doc_id", 5) != 0)
    with Scratch(spark) as scratch:
        keys = sampling.class_sample(learn, "lang", "doc_id", 20, scratch)
        assert {r.lang for r in keys.collect()} == {r.lang for r in learn.filter("lang is not null").collect()}
        many = spark.range(5000).selectExpr("id", "concat('c', id % 2500) label")
        assert sampling.class_sample(many, "label", "id", 5, scratch).count() == 5000  # no class is left out, however many there are
        texts = sampling.with_texts(docs.select("doc_id", "text"), keys, ["doc_id"]).withColumn("_share", F.lit(1.0))
        whole = sampling.bounded(texts, "doc_id", "text", scratch)
        part = sampling.bounded(texts, "doc_id", "text", scratch, most_chars=20_000)
        assert whole.count() == texts.count() and 0 < part.count() < whole.count() and part.first()["_share"] < 1
    long = docs.limit(50).withColumn("text", F.expr("repeat(concat(text, ' '), 60)"))  # longer than any bound on a text's length
    table = docs.unionByName(long.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("lang", F.lit("long")))
    found = language_id.identify(table, public_tokenizers.path("piece_bpe_32k.model"), share("_id", 5) != 0)
    assert "long" in {r._lang for r in found.collect()}


def test_forward_sums_all_segmentations():
    model = language_id.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    probs = np.zeros((model.n + 1, 1))
    probs[1:, 0] = np.random.default_rng(3).random(model.n)
    number = {p: i + 2 for i, p in enumerate(model.names)}

    def total(word):
        if not word:
            return 1.0
        return sum((probs[number[word[:k]], 0] if word[:k] in number else probs[1, 0] if k == 1 else 0.0) * total(word[k:]) for k in range(1, min(len(word), model.longest) + 1))

    words = ["▁the", "▁stand", "▁x", "▁quöl"]
    ends, lengths = model.ends(words)
    got = language_id.forward(ends, lengths, probs)[np.arange(len(words)), lengths, 0]
    assert np.allclose(got, [total(w) for w in words])
    assert np.allclose(language_id.backward(ends, lengths, probs)[:, 0, 0], got)


def test_quality(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.learn(docs, labels, share("_id", 5) != 0)
    got = {r._id: r._score for r in quality.scored(docs, model).collect()}
    held = [(got[r.doc_id] >= 0.3, bool(r.quality)) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.9 and all(0 <= s <= 1 for s in got.values())
    assert quality.scored(odd, model).count() == N_ODD and quality.scored(empty, model).count() == 0
    by = {(r._id, r._score) for r in quality.scored(odd, model).collect() if r._id in (4, 5, 7)}
    assert len(by) == 3 and {i: s for i, s in by}[4] == {i: s for i, s in by}[5]  # null is empty, equal rows fare alike
    op1 = {r.doc_id: r for r in quality.op1_quality(spark, "/root/testdata/sf0.01").collect()}
    assert {i: r.score for i, r in op1.items()} == got and all(r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in op1.items())
    blank = quality.learn(empty, labels, share("_id", 5) != 0)
    assert quality.scored(odd, blank).count() == N_ODD


def naive_statistics(text):
    """Some of a text's statistics, said plainly."""
    data, words = text.encode(), text.encode().split()
    hist = Counter(data)
    entropy = -sum(n / len(data) * math.log2(n / len(data)) for n in hist.values()) if data else 0.0
    lines = text.encode().split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
    pairs = list(zip(words, words[1:]))
    return {
        "log_bytes": math.log1p(len(data)), "log_words": math.log1p(len(words)), "digits": sum(chr(b).isdigit() for b in data if b < 128) / max(len(data), 1), "entropy": entropy, "mean_word": sum(map(len, words)) / max(len(words), 1),
        "distinct_words": len(set(words)) / max(len(words), 1), "top_word": max(Counter(words).values(), default=0) / max(len(words), 1), "distinct_pairs": len(set(pairs)) / max(len(pairs), 1), "same_as_before": sum(a == b for a, b in pairs) / max(len(pairs), 1),
        "words_short": sum(len(w) <= 2 for w in words) / max(len(words), 1), "words_long": sum(len(w) > 15 for w in words) / max(len(words), 1), "distinct_lines": len(set(lines)) / max(len(lines), 1), "mean_line": math.log1p(len(data) / max(len(lines), 1)) if data else 0.0,
    }


def test_statistics_and_trees_equal_naive_ones(rows):
    texts = [t for _, t in rows[:40]] + ["", "one", "a a a\nb b\n", "é ü\n\n", "x" * 50]
    x = np.concatenate([quality.statistics(b) for _, _, b in scan.blocks(pa.array(texts))])
    for row, t in zip(x, texts):
        for name, value in naive_statistics(t).items():
            assert abs(row[quality.FEATURES.index(name)] - value) < 1e-9, (name, t[:40])
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 4))
    y = (data[:, 0] + data[:, 1] ** 2 > 0.7).astype(float)
    model = quality.fit(data, y, np.ones(300), trees=20, depth=3)

    def walk(row):
        total = model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        return total

    assert np.allclose(model.margin(data), [walk(r) for r in data]) and ((model.score(data) > 0.5) == y).mean() > 0.9


def test_toxicity_scores_equal_plain_ones(spark, docs):
    """A text's score is the logistic of its most toxic window's mean word number, each word the mean of its n-grams' folded numbers."""
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), -1.0)
    texts = ["", "one", "a few plain words here", "Ünïcode ÉTÉ 123 !!! don't", " ".join(f"w{i}" for i in range(30))]
    for text, score in zip(texts, model.scores(pa.array(texts))):
        words = text.encode().lower().split()
        parts = [float(np.mean(model.folded[toxicity.grams([w])[0]])) for w in words]
        width = min(len(words), toxicity.WINDOW)
        best = max(np.mean(parts[i : i + width]) for i in range(len(parts) - width + 1)) if parts else 0.0
        assert abs(score - 1 / (1 + math.exp(-(toxicity.GAIN * best - 1.0)))) < 1e-6
    got = {r.doc_id: r for r in toxicity.op5_toxicity(spark, FOLDER).collect()}
    assert len(got) == docs.count() and all(r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    kept = {r.doc_id for r in toxicity.kept(docs, toxicity.learn(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"), share("_id", 3) != 1), 0.7).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}


def test_toxicity(spark, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.learn(docs, labels, share("_id", 3) != 1)
    got = {r._id: r._score for r in toxicity.scored(docs, model).collect()}
    english = {r.doc_id for r in docs.filter("lang = 'en'").select("doc_id").collect()}
    held = [(got[r.doc_id] >= 0.7, bool(r.toxic)) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in english]
    assert np.mean([a for a, b in held if b]) > 0.85 and np.mean([a for a, b in held if not b]) < 0.05
    out = {r._id: r._score for r in toxicity.scored(odd, model).collect()}
    assert out[12] > out[1] and 0 <= out[4] < 0.7
    assert toxicity.scored(empty, model).count() == 0 and toxicity.kept(odd, model, 0.7).columns == odd.columns
    words = model._words([b"idiot", b"idi0t", b"idiots", b"table"])
    assert min(words[0], words[2]) > 2 * abs(words[3])
