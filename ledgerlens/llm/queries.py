"""The operators' registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import ann, bpe, bytebpe, convtrie, langid, lattice, packing, phrases, pii, quality, simhash, toxicity, urls
from ledgerlens.llm.common import held_out, table

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"


def op1_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), ~held_out(5, 1), public_tokenizers.path(PIECES))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), held_out(4, 2))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_phrase_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(table(spark, sf_dir, "conversations"))


def op13_byte_bpe_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE),
                                 public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (
    op1_quality_ledger, op2_one_bit_neighbours, op3_lattice_likelihood, op4_url_rules, op5_pii_field,
    op6_language_mixture, op7_mixture_packing, op8_toxicity_grammar, op9_simhash_popcount, op10_bpe_segment_tree,
    op11_phrase_subtrees, op12_conversation_trie, op13_byte_bpe_rank_queue)}

SQL = {"op1_quality_ledger": quality.SQL, "op11_phrase_subtrees": phrases.SQL,
       "op12_conversation_trie": convtrie.SQL}
