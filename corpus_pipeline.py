"""The corpus pipeline: five stages, each an operator of ``seamline.llm``.

Every stage takes the documents that the one before it kept and returns documents; the
last returns their tokens.  ``run`` writes each stage's rows as Parquet to the shared
folder and reads them again, so that a lost executor repeats only tasks of its stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seamline.llm import exact_dedup, pair_index_bpe, quality_rules, shingle_join, source_mix
from seamline.llm.frames import documents
from seamline.plans.staging import stage

WORDS_KEPT = 150_000  # by a worker of the last stage; earlier stages have used most of its executor's memory

def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs, "v3")


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their shingles the one with the least id."""
    return shingle_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mix.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens, ``n_tokens`` and packed ``ids``, and whether these decode to the text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = pair_index_bpe.tokenize(docs, path, keep=["doc_id", "lang", "source"], checked=True, words_kept=WORDS_KEPT)
    return found.select("doc_id", "lang", "source", "tokens.n_tokens", "tokens.ids", "tokens.round_trip")


STAGES = [
    ("quality rules", rules),
    ("exact dedup", copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
