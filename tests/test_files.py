"""Sources and sinks on real files."""

import gzip
import os
import time

import pytest

from quillon.sources import files


def test_tsv_keeps_quotes_and_na(spark, tmp_path):
    path = str(tmp_path / "x.tsv.gz")
    with gzip.open(path, "wt") as f:
        f.write('id\ttitle\tregion\n1\t"Quoted\tNA\n2\tB\t\\N\n')
    rows = files.read_tsv(spark, path, "id int, title string, region string", partitions=2).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, '"Quoted', "NA"), (2, "B", None)]
    rows = files.read_tsv(spark, path, "id int, title string, region string", nulls=("\\N", "NA")).orderBy("id").collect()
    assert [r.region for r in rows] == [None, None]


def test_load_and_require(spark, tmp_path):
    stem = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        files.load(spark, stem)
    assert files.load(spark, stem, required=False) is None
    files.write_csv(spark.range(3), f"{stem}.csv")
    assert files.load(spark, stem).count() == 3
    files.write_parquet(spark.range(5), f"{stem}.parquet")
    assert files.load(spark, stem).count() == 5
    with pytest.raises(FileNotFoundError, match="nope"):
        files.require(spark, f"{stem}.csv", f"{stem}.nope")
    with pytest.raises(ValueError):
        files.read_table(spark, "a.xlsx")
    assert files.optional(spark, f"{stem}.nope", "a int", spark.read.parquet).count() == 0


def test_cache_snapshot_and_guard(spark, tmp_path):
    source, out = str(tmp_path / "in.txt"), str(tmp_path / "out.parquet")
    files.write_text(spark, source, "x")
    made = []

    def make():
        made.append(1)
        return spark.range(2)

    for _ in range(2):
        assert files.cached(spark, out, [source], make).count() == 2
    assert len(made) == 1
    os.utime(source, (time.time() + 100,) * 2)
    files.cached(spark, out, [source], make)
    assert len(made) == 2
    assert files.snapshot(spark.range(4), str(tmp_path / "s")).count() == 4
    with pytest.raises(RuntimeError), files.unchanged(spark, source):
        os.utime(source, (time.time() + 500,) * 2)


def test_notes_and_reviews(spark, tmp_path):
    rows = [{"column_name": "b", "role": "predictor", "feature_group": "lag", "included": 1, "note": "kept", "drop_reason": ""}, {"column_name": "a", "role": "dropped", "feature_group": "lag", "included": 0, "note": "left out", "drop_reason": "not used"}]
    text = files.feature_notes("F", rows)
    assert "Included: 1 of 2 columns." in text and text.index("`a`") < text.index("`b`") and "left out; not used" in text
    files.write_reviews(spark.range(10), str(tmp_path / "r"), {"low": "id < 3", "none": "id > 99"}, "id")
    assert spark.read.csv(str(tmp_path / "r" / "low"), header=True).count() == 3


def test_samples_documents_and_steps(spark, tmp_path):
    files.write_sample(spark.range(1000), str(tmp_path / "a"), "id")
    assert spark.read.csv(str(tmp_path / "a"), header=True).count() == 250
    assert "| id | bigint | key |" in files.dictionary_text("T", spark.range(1), {"id": "key"})
    config = tmp_path / "p.yaml"
    config.write_text("raw_dir: /r  # raw\ninterim_dir: '/i'\nprocessed_dir: /p\n")
    assert files.Paths.read(str(config)) == files.Paths("/r", "/i", "/p")
    seen = []
    assert files.run_steps({"a": lambda r: seen.append(("a", r)), "b": lambda r: seen.append(("b", r))}, ["--refresh"]) == ["a", "b"]
    assert seen == [("a", True), ("b", True)]
