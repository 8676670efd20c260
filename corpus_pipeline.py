"""From raw documents to token files: five stages, each over all that its predecessor kept.

1. quality: weak supervision over quality rules; documents that it rejects go.
2. near_duplicates: n-gram Jaccard join (five words, similarity 0.8); the smallest doc_id of each group stays.
3. decontaminate: spaced seeds against the benchmark table; documents that hold a passage of it go.
4. mix: Sainte-Lague apportionment of the sources; a document stays as often as the mix takes it (0 to 3 times).
5. tokens: token files in ascending doc_id order; one row per document read back from them.

Every stage keeps all columns of its input; null texts fall at the quality stage, null ids pass through. Stage results are
written as Parquet below the shared checkpoint folder and read again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.decontaminate import without_leaks
from tidewire.llm.mixing import mixed_documents
from tidewire.llm.ngram_join import one_of_each
from tidewire.llm.queries import tokenizer_file
from tidewire.llm.token_files import token_digest, tokens_path, write_tokens
from tidewire.llm.weak_quality import kept_only
from tidewire.workspace import checkpoint_root


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_only(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, n=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = tokens_path(spark, "pipeline-tokens")
    write_tokens(docs, path, tokenizer_file("word_bpe_49k.json"))
    return token_digest(spark, path)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: the near-duplicate stage and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds the stages against models
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
