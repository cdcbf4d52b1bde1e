"""One query for each operator, over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import (
    conversations, exact_dedup, hmm_lm, packing, pair_index_bpe, quality_rules, sharding, shingle_join, source_mix, surrogates,
    token_alignment, token_counts, toxicity,
)
from seamline.llm.frames import documents, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_counts(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(documents(spark, sf_dir), model)


@query
def op2_hmm_lm(spark, sf_dir):
    return hmm_lm.score(documents(spark, sf_dir))


@query
def op3_pair_index_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = pair_index_bpe.tokenize(documents(spark, sf_dir), path, decoded=True, keep=["doc_id"])
    return found.select(
        "doc_id", "tokens.n_tokens", F.sha2("tokens.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("tokens.decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op4_surrogates(spark, sf_dir):
    return surrogates.replace(documents(spark, sf_dir), key=surrogates.QUERY_KEY)


@query
def op5_source_mix(spark, sf_dir):
    return source_mix.mix(documents(spark, sf_dir))


@query
def op6_toxicity(spark, sf_dir):
    return toxicity.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@query
def op7_exact_dedup(spark, sf_dir):
    found = exact_dedup.copy_groups(documents(spark, sf_dir), digest_all=True)
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full_hash")).alias("text_sha256")
    )


@query
def op8_shingle_join(spark, sf_dir):
    return shingle_join.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.col("n_shingles").cast("long"), "component_id"
    )


@query
def op9_sharding(spark, sf_dir):
    return sharding.place(documents(spark, sf_dir))


@query
def op10_quality_rules(spark, sf_dir):
    ledger = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)), "v3")
    failed_base = F.col("failed_bits").bitwiseAND(F.lit(quality_rules.mask("base"))) != 0
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed_base.alias("base_failed"), "kept", "n_lines", "failed_bits",
    )


@query
def op11_token_alignment(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(documents(spark, sf_dir), *paths)


@query
def op12_packing(spark, sf_dir):
    return packing.pack_pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op13_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.audit(rows, conversations.damage(rows))
