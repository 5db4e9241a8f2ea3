"""Registered corpus queries over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import corpus_queries as Q
from textloom.plans.corpus_sql import ORACLE
from textloom.sources import corpus as C


def _over_documents(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(C.document_files(spark, sf_dir))

    return run


QUERIES = {
    name: _over_documents(query)
    for name, query in {
        "wordlist_lemma": Q.wordlist,
        "wordlist_text_cumulative": Q.wordlist_cumulative,
        "vocab_profile": Q.vocabulary_profile,
        "concordance": lambda f: Q.concordance(f, "inger"),
        "concordance_tagged": lambda f: Q.concordance(f, "inger", pos_filter="NOUN", k=20),
        "collocations": lambda f: Q.collocations(f, "inger"),
        "ngrams_2": lambda f: Q.ngrams(f, 2),
        "ngrams_3": lambda f: Q.ngrams(f, 3),
        "ngrams_pos_pattern": lambda f: Q.ngrams(f, 2, pos_pattern=["VERB", "NOUN"]),
        "keyness_lang": lambda f: Q.keyness(f, F.col("file_path").endswith(".fr"), F.col("file_path").endswith(".en")),
        "keyness_vs_rest": lambda f: Q.keyness(f, F.col("language") == "en", F.col("language") != "en"),
        "pos_distribution": lambda f: Q.tag_counts(f, "language"),
        "shannon_entropy_file": Q.file_entropy,
        "entropy_by_language": Q.entropy_by_language,
        "conditional_entropy": Q.conditional_entropy,
        "semantic_density": Q.semantic_density,
        "module_metrics": Q.module_metrics,
        "scope_tokens": Q.scope_tokens,
        "syntagmas": Q.syntagmas,
        "corpus_stats": Q.corpus_stats,
        "directory_groups": Q.directory_groups,
        "language_distribution": Q.language_distribution,
    }.items()
} | {"content_language": lambda spark, sf_dir: Q.content_languages(C.table(spark, sf_dir, "pages"), "html")}

ORACLE_SQL = ORACLE
