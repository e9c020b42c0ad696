"""Registered queries of this package: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import bpe, ctw, decontaminate, html_text, licenses, postings, prefix_trie, quality, rules, secrets, toxicity, whitening
from revlens.llm.common import read
from revlens.llm.simhash import simhash_components

#: Vocabulary file of the public tokenizers that op8 and the pipeline encode with.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build
    return add


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    return simhash_components(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=4, max_bits=4)


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the multilingual byte-level vocabulary, and decoded again."""
    import public_tokenizers
    return bpe.digests(read(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


@query("op2_secrets")
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents with the corpus-wide verdict on their values."""
    return secrets.report(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


@query("op3_decontamination", decontaminate.CONTAINED_SQL)
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item that it contains."""
    return decontaminate.contained_items(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark"))


@query("op1_licenses", licenses.license_sql())
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a licence notice, with the licences."""
    return licenses.license_report(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op7_rules", rules.rules_sql())
def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of all documents and the verdict of the adaptive rules."""
    return rules.apply_rules(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of all documents."""
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    return quality.quality_scores(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels"))


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op10_context_tree")
def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return ctw.score_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of all embeddings."""
    return whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), count=16)


@query("op12_neighbours")
def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every twentieth one."""
    return postings.nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=20, count=20)


@query("op11_prefix_trie", prefix_trie.TRIE_SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of the rebuilt conversations."""
    return prefix_trie.trie_nodes(read(spark, sf_dir, "conversations"))
