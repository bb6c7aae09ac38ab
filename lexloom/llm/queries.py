"""The queries opN_<name> of the corpus operators and their SQL."""

from __future__ import annotations

from . import cap_filters, chat_tree, language, licenses, mixing, ngram_join, packing, quality
from . import toxicity as toxic
from .session import read, vocabulary
from .token_counts import VOCABULARY, token_counts


def op1_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.mix_counts(read(spark, sf_dir, "documents"))


def op3_license_scan(spark, sf_dir):
    return licenses.license_scan(read(spark, sf_dir, "documents"), wrapped=True)


def op4_chat_tree(spark, sf_dir):
    return chat_tree.chat_tree(read(spark, sf_dir, "conversations"), vocabulary=vocabulary(spark, VOCABULARY))


def op5_packing(spark, sf_dir):
    return packing.pack_conversations(read(spark, sf_dir, "conversations"), vocabulary=vocabulary(spark, VOCABULARY))


def op6_near_embeddings(spark, sf_dir):
    return cap_filters.near_vectors(read(spark, sf_dir, "embeddings"))


def op7_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op8_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxic.toxicity(docs, lexicon=toxic.fit(docs, read(spark, sf_dir, "labels")))


def op9_token_counts(spark, sf_dir):
    return token_counts(read(spark, sf_dir, "documents"), vocabulary=vocabulary(spark, VOCABULARY))


def op10_quality_rules(spark, sf_dir):
    return quality.quality_filter(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_mixing, op3_license_scan, op4_chat_tree, op5_packing, op6_near_embeddings, op7_language_id, op8_toxicity, op9_token_counts, op10_quality_rules)}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": ngram_join.oracle_sql(),
    "op3_license_scan": licenses.oracle_sql(),
    "op6_near_embeddings": cap_filters.oracle_sql(),
    "op7_language_id": language.oracle_sql(),
    "op10_quality_rules": quality.oracle_sql(),
}
