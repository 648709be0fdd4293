"""Registered queries of the training-data operators and their reference SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from veilframe.llm import (
    covertree,
    exact,
    infill,
    language,
    lines,
    mixing,
    negatives,
    pieces,
    quality,
    simhash,
    tokens,
    toxicity,
    warc,
)
from veilframe.llm.common import table

PIECE_MODEL = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark, sf_dir):
    return tokens.histogram(tokens.lengths(table(spark, sf_dir, "documents"),
                                           public_tokenizers.path(RANKS),
                                           public_tokenizers.PATTERN))


def op5_mixing(spark, sf_dir):
    chosen = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return chosen.select("row.doc_id", *mixing.LEVELS, "tokens", "epoch")


def op6_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark, sf_dir):
    done = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("row.doc_id", "n_lines", "n_dropped",
                       F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_language_id(spark, sf_dir):
    return language.language(table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "indexed")


def op10_sentencepiece(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op11_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_embedding_dedup(spark, sf_dir):
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark, sf_dir):
    return infill.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_toxicity, op3_exact_dedup, op4_token_counts, op5_mixing, op6_quality_rules,
    op7_line_dedup, op8_language_id, op9_warc, op10_sentencepiece, op11_hard_negatives,
    op12_embedding_dedup, op13_fill_in_middle)}

ORACLE = {"op3_exact_dedup": exact.SQL, "op5_mixing": mixing.sql(), "op7_line_dedup": lines.SQL,
          "op9_warc": warc.SQL,
          "op11_hard_negatives": negatives.SQL, "op12_embedding_dedup": covertree.SQL,
          "op13_fill_in_middle": infill.SQL}
