"""The pipeline's stages do what their operators' results say, on odd and empty documents too."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from quillon.llm import toxicity
from quillon.llm.common import written
from tests.llm.test_operators import components, shingle_set
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    """Each stage against brute force on what its predecessor kept; toxicity, a trained model, against its operator's scores."""
    columns, kept, library = docs.columns, docs, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
        kept = written(stage(spark, kept, FOLDER), name)
        if name == "token_records":
            continue
        assert kept.columns == columns
        after = sorted((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect())
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.op5_toxicity(spark, FOLDER).collect() if r.predicted}
            assert after == [x for x in before if x[0] not in bad]
        elif name == "near_dedup":
            root, _ = components(before)
            assert after == [x for x in before if root[x[0]] == x[0]] and len(after) < len(before)
        elif name == "decontamination":
            leaks = {i for i, t in before for m in items if m and len(shingle_set(t) & m) >= 0.75 * len(m)}
            assert after == [x for x in before if x[0] not in leaks] and leaks
        else:
            size = lambda t: len((t or "").encode().split())
            counts, whole = Counter(i for i, _ in after), {i: t for i, t in before}
            assert set(counts) <= set(whole) and max(counts.values()) <= 3 and all(whole[i] == t for i, t in after)
            assert abs(sum(size(t) for _, t in after) - sum(size(t) for _, t in before)) < 0.05 * sum(size(t) for _, t in before)
            mixed = after
    start, want = 0, Counter()
    for (i, _), e in zip(mixed, library.encode_batch([t or "" for _, t in mixed], add_special_tokens=False)):
        want[i, start, len(e.ids) + 1, zlib.crc32(np.array(e.ids + [1], "<u4").tobytes())] += 1
        start += len(e.ids) + 1
    assert Counter(tuple(r) for r in kept.collect()) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == want


def test_odd_and_empty(spark, odd, empty):
    for table in (odd, empty):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = written(stage(spark, kept, FOLDER), name)
        assert (kept.count() == 0) == (table is empty)


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names
