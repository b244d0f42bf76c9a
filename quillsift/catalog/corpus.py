"""Registered queries on tokens, passages, parents and windows of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillsift.functions import text as tx
from quillsift.operators import corpus
from quillsift.plans.retrieval import Corpus
from quillsift.sources import tables

# Documents of the driver have no articles; every line that is not empty stands for one.
ANY_LINE = "[^\\n]"


def token_stats(spark, folder) -> DataFrame:
    docs = tables.documents(spark, folder, "text", "lang")
    words = docs.select("lang", tx.tokens(F.col("text")).alias("t"))
    sizes = words.groupBy("lang").agg(F.count("*").alias("n_docs"),
                                      F.sum(F.size("t")).cast("bigint").alias("n_tokens"))
    # Distinct (language, token) first: equal tokens of one language meet inside the map tasks.
    kinds = (words.select("lang", F.explode("t").alias("token")).distinct()
             .groupBy("lang").agg(F.count("*").alias("n_distinct")))
    return sizes.join(kinds, "lang", "left")


def content_terms(spark, folder) -> DataFrame:
    rows = tables.documents(spark, folder, "doc_id", "text").select("doc_id", tx.tokens(F.col("text")).alias("t"))
    terms = tx.content_terms(F.col("t"))
    return rows.select("doc_id", F.size(terms).cast("bigint").alias("n_terms"),
                       F.sha2(F.array_join(terms, " "), 256).alias("terms_sha"))


def word_counts(spark, folder) -> DataFrame:
    text = F.col("text")
    return tables.documents(spark, folder, "doc_id", "text").select(
        "doc_id", tx.word_count(text).cast("bigint").alias("n_words"),
        F.size(tx.long_lines(text)).cast("bigint").alias("n_long_lines"),
        tx.document_year(text).alias("latest_year"))


def clean_documents(spark, folder) -> DataFrame:
    rows = tables.documents(spark, folder, "doc_id", "text").select(
        "doc_id", tx.clean_document(F.col("text")).alias("text"))
    return rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"),
                       F.sha2("text", 256).alias("text_sha"))


def passage_keys(spark, folder) -> DataFrame:
    rows = tables.documents(spark, folder, "doc_id", "text").select("doc_id", tx.group_key(F.col("text")).alias("k"))
    return rows.select("doc_id", F.sha2("k", 256).alias("group_sha"))


def dup_passages(spark, folder) -> DataFrame:
    docs = Corpus(tables.documents(spark, folder, "doc_id", "text")).docs
    return corpus.passage_groups(docs)


def corpus_report(spark, folder) -> DataFrame:
    docs = Corpus(tables.documents(spark, folder, "doc_id", "text")).docs
    return corpus.corpus_report(docs)


def chunk_windows(spark, folder) -> DataFrame:
    chunks = Corpus(tables.documents(spark, folder)).chunks()
    return chunks.select("chunk_id", "parent_id", "start", "end", F.sha2("text", 256).alias("text_sha"))


def _lines(spark, folder) -> DataFrame:
    docs = Corpus(tables.documents(spark, folder, "doc_id", "text")).docs
    return corpus.parents(docs, heading_line=ANY_LINE)


def line_parents(spark, folder) -> DataFrame:
    return _lines(spark, folder).select(
        "parent_id", "doc_id", "ordinal", "position", F.length("text").cast("bigint").alias("n_chars"))


def adjacent_parents(spark, folder) -> DataFrame:
    """Neighbours of the longest line of each document."""
    rows = _lines(spark, folder).select("parent_id", "doc_id", "position", F.length("text").alias("n"))
    seeds = rows.groupBy("doc_id").agg(
        F.max_by("position", F.struct("n", -F.col("position"))).alias("position"))
    near = corpus.neighbours(rows.select("parent_id", "doc_id", "position"), seeds, 1)
    return near.select("doc_id", "parent_id", "seed_position", "offset")


QUERIES = {f.__name__: f for f in (
    token_stats, content_terms, word_counts, clean_documents, passage_keys, dup_passages,
    corpus_report, chunk_windows, line_parents, adjacent_parents)}
