"""The numbered operators applied to their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillsift.llm import bpe, conversation_repair, exact_dedup, html_main, langid, minhash, mixing, quality, spelling, token_counts, topk, toxicity, warc
from quillsift.llm.common import table
from quillsift.llm.twins import TWINS


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return langid.predict(documents, langid.train(documents))


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, folder, "documents").select("doc_id", "text"))


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op6_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_main.extract(table(spark, folder, "pages"))


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(documents, toxicity.train(documents, table(spark, folder, "labels")))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    bundles = warc.fresh_folder(spark)
    return warc.read(warc.write(table(spark, folder, "pages"), bundles), bundles)


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents").select("doc_id", "text"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair_digests(conversation_repair.damaged(rows))


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.classes(table(spark, folder, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_quality, op3_token_counts, op4_bpe, op5_topk, op6_html, op7_minhash, op8_toxicity, op9_warc, op10_mixing, op11_spelling,
    op12_conversation_repair, op13_exact_dedup)}

#: Models, tokenizers, compression and hash-driven choices have no SQL twin; tests hold them against brute force.
SQL = {
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT html, max(page_id) AS response FROM p GROUP BY html),
        d AS (SELECT page_id, html, response, array_to_string(list_transform(string_split(sha1(html), ''), lambda c:
                  substr('0000000100100011010001010110011110001001101010111100110111101111',
                         4 * instr('0123456789abcdef', c) - 3, 4)), '') AS bits
              FROM p JOIN g USING (html))
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
                   + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
                   + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
               CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
        FROM d""",
    **TWINS,
}
