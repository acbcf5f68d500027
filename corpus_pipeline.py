"""A training corpus from raw documents: language identification, near-duplicate removal, benchmark decontamination,
secret redaction and packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; ``docs`` has the columns
of ``documents``, and so has what every stage but the last returns. Null ids are kept with their texts; rows that
repeat an id are kept or dropped together; every stage accepts an empty table.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import decontaminate, jaccard, langid, packing, secret_scan
from foldwise.session import DEFAULT_BROADCAST_ROWS, ensure_checkpoint_dir
from foldwise.sources.tables import table

TOKENIZER = "word_bpe_49k.json"
LEAST_SCORE = 0.3  # a text whose language is less certain than this is rejected, like one without any letter


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose ``doc_id`` is not in the distinct ``ids``; these are broadcast only up to a bound of rows."""
    if ids.count() <= DEFAULT_BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified."""
    return langid.keep_identified(docs, langid.fit(docs), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of texts linked by five-word shingles with a similarity of 0.8 or more."""
    groups = jaccard.link_components(docs, n=5, share=Fraction(4, 5))
    return without(docs, groups.where("doc_id <> component_id").select("doc_id"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap with a benchmark item."""
    hits = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, hits.select("doc_id").distinct())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and puts a marker in the place of each secret."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.cut_documents(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # the language model and the packing are not SQL; tests/llm/test_pipeline.py has a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
