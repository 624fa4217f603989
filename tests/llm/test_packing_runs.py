"""Texts that are one long run: the tokenizer must neither give way nor differ from the exact one."""

import zlib

import numpy as np
import pytest

from barflow.llm import packing

RUNS = [" ", "\n", "a", "!", "\t \n"]


@pytest.mark.parametrize("piece", RUNS)
def test_runs_encode_exactly(piece):
    codec = packing.codec()
    for text in (piece * (5_000_000 // len(piece)), "word " + piece * (150_000 // len(piece)) + "word", piece * (99_000 // len(piece))):
        assert codec.encode(text) == codec.exact.encode(text, add_special_tokens=False).ids


def test_run_lengths():
    n = packing.LONG_RUN
    assert packing.has_long_run("a" * n) and packing.has_long_run("a b" + " " * n) and packing.has_long_run("a b " + "c" * n)
    assert not packing.has_long_run("ab " * n) and not packing.has_long_run("")


def test_runs_through_pack(spark):
    texts = [p * (1_200_000 // len(p)) for p in RUNS] + ["plain text."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held: dict = {}
    for r in packing.pack(df).collect():
        held.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate(texts):
        ids = np.array([*packing.codec().exact.encode(t, add_special_tokens=False).ids, packing.END_ID], "<u4")
        pieces = sorted(held[k], key=lambda r: r.start)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]] and sum(p.length for p in pieces) == len(ids)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces)


def test_runs_through_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [" " * 1_100_000, "\n" * 1_100_000, "a" * 1_100_000, "Some words that stay as they are, one after another."]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id for r in got} >= {0, 1, 3}
