"""The stored index: batches write their own rows only, the last word on a document counts, and readers never see half a batch."""

from pathlib import Path

import pytest
from helpers import rows_of

from passages.operators import chunking
from passages.sources import index


def _docs(spark, ids, text):
    return spark.createDataFrame([(i, f"d{i}.txt", f"{text} {i} common words of document") for i in ids], "doc int, name string, text string")


def _rows_in(spark, path):
    return {p.name: spark.read.parquet(str(p / "chunks")).count() for p in Path(path, "segments").iterdir() if (p / "chunks").exists()}


def test_batches_and_compaction(spark, tmp_path):
    held = index.StoredIndex(spark, str(tmp_path))
    with pytest.raises(ValueError):
        held.read("chunks")
    first, second = _docs(spark, range(40), "old"), _docs(spark, [3, 4, 50], "new")
    held.append(chunking.ingest_corpus(first), first, "b0")
    before = _rows_in(spark, tmp_path)
    held.append(chunking.ingest_corpus(second), second, "b1")
    assert sorted(_rows_in(spark, tmp_path).values()) == [3, 40] and before.items() <= _rows_in(spark, tmp_path).items()  # a batch of three writes three
    held.append(chunking.ingest_corpus(_docs(spark, range(40), "again")), first, "b1")  # a batch that is there already
    held.delete(spark.createDataFrame([(7,), (99,)], "doc int"), "b2")
    latest = first.where("doc NOT IN (3, 4, 7)").unionByName(second)
    want = {k: rows_of(v) for k, v in chunking.ingest_corpus(latest).items()}
    seen = lambda: {k: rows_of(held.read(k).select(sorted(v[0]))) for k, v in want.items()}
    assert seen() == want and held.batches() == ["b0", "b1", "b2"]
    asked = spark.createDataFrame([("new",), ("common",)], "term string")
    assert held.read("postings", asked).groupBy("term").count().orderBy("term").collect() == [("common", 40), ("new", 3)]
    held.compact()
    assert seen() == want and len(held._manifest(held._version())) == 1 and held.read("postings", asked).count() == 43
    held.append(chunking.ingest_corpus(second), second, "b1")  # still known after compaction
    assert held.batches() == ["b0+b1+b2"]


def test_half_a_batch_is_not_seen(spark, tmp_path):
    held = index.StoredIndex(spark, str(tmp_path))
    first = _docs(spark, range(5), "old")
    held.append(chunking.ingest_corpus(first), first, "b0")
    want = rows_of(held.read("chunks"))
    held._write("orphan", chunking.ingest_corpus(_docs(spark, range(5), "new")), first)  # a writer that died before its manifest
    Path(tmp_path, "manifests", "2").mkdir()
    Path(tmp_path, "manifests", "2", "part-0.parquet").write_bytes(b"half")
    assert rows_of(held.read("chunks")) == want and held.batches() == ["b0"]
    second = _docs(spark, [1], "new")
    held.append(chunking.ingest_corpus(second), second, "b1")
    assert held.batches() == ["b0", "b1"] and held.read("chunks").where("text like 'new%'").count() == 1


def test_many_batches_compact_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_SEGMENTS", 2)
    held = index.StoredIndex(spark, str(tmp_path))
    for i in range(4):
        docs = spark.createDataFrame([(i, f"text {i}"), (0, f"text {i}")], "doc int, text string")
        held.append({"chunks": docs}, docs, f"b{i}")
    assert len(held._manifest(held._version())) <= 2
    assert {(r.doc, r.text) for r in held.read("chunks").collect()} == {(0, "text 3"), (1, "text 1"), (2, "text 2"), (3, "text 3")}
