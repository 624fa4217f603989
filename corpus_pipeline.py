"""A corpus pipeline of the operators in barflow.llm: each stage works on what the one before kept.

All stages but the last return rows of their input with its columns, whatever
further ones there are.  Defined results: null, empty and blank texts pass all
filters (they have no words to judge, copy or leak) and are packed as their end
token; of repeated rows of one doc_id one stays if it has words; ties go to the
smallest doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import decontaminate, neardup, packing, substring, toxicity
from barflow.llm.common import cut, table
from barflow.llm.text import sliced


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not reject; without labels of both classes the share of toxic ones decides."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    held = spark.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column("text").to_pylist()
            wordless = [not (t or "").strip(" \t\n\v\f\r") for t in texts]
            yield b.filter(pa.array((held.value.score(texts) < toxicity.THRESHOLD) | wordless))

    return docs.mapInArrow(clean, docs.schema)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: a row of its smallest doc_id; rows without doc_id count where no other has one."""
    return neardup.keep(docs)


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without runs of 20 words that also stand earlier; n_chars follows the text."""
    out = substring.remove(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeated runs", drop_repeated_runs), ("benchmark leaks", drop_leaks), ("packing", pack)]

#: A trained model and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
