"""The corpus pipeline: five operators, each on all that the one before it kept.

Toxic documents (by a lexicon fitted from the table labels) go, then those without a recognised language (the others are
labelled with the language found), one document of each group of near copies
stays, sources are mixed to target weights, and what is left is packed into bins.
"""

from lexloom.llm import language, mixing, ngram_join, packing, toxicity
from lexloom.llm.session import read, vocabulary, written


def drop_toxic(spark, docs, sf_dir):
    return toxicity.clean(docs, lexicon=toxicity.fit(docs, read(spark, sf_dir, "labels")))


def identify_language(spark, docs, sf_dir):
    return language.relabel(docs, language.fit(docs))


def drop_near_copies(spark, docs, sf_dir):
    return ngram_join.keep_one(docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


def pack(spark, docs, sf_dir):
    return packing.pack_documents(docs, vocabulary=vocabulary(spark, packing.VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("language", identify_language), ("near_copies", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]
#: Random duels and packing can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        # every stage reads its input more than once
        docs = docs if k == len(STAGES) else written(docs, f"pipeline-{name}")
    return docs
