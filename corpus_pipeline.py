"""The corpus pipeline: documents pass quality rules, line dedup, near-dedup, benchmark decontamination and BPE.

Each stage reads what the one before it wrote (Parquet in the shared folder of ``spark.checkpoint.dir``), works on
all of it, and all but the last return the columns of ``documents``; n_chars follows the text.

* quality: documents that fail the base rule or a risk-controlled cutoff go;
* lines: lines found in 10 or more different texts go, in every document (equal texts count once here, so that a
  group of copies is still whole when the next stage looks for it);
* near_duplicates: of each group linked by a Jaccard similarity of 0.8 over 5-word shingles the least doc_id stays;
* benchmark: every occurrence of 10 consecutive words of a benchmark item is cut out of the text;
* tokens: the token ids of each text under a byte-level BPE, checked by decoding them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsight.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from jobsight.session import checkpoint_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, _table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.drop_lines(docs, min_docs=10, copies_once=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, shingle_words=5, threshold=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.remove_benchmark(docs, _table(spark, sf_dir, "benchmark"), window=10))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates),
          ("benchmark", benchmark), ("tokens", tokens)]

#: the binomial bounds, the registers and the merges have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids, round_trip."""
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
