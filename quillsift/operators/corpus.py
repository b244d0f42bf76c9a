"""From source documents to unique passages, parents (articles) and overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.config import Chunking
from quillsift.functions import lexicon as lx, text as tx

# Window numbers of one document fit in this many bits of a chunk id.
WINDOW_BITS = 24


def parse_documents(raw: DataFrame, compose: bool = True) -> DataFrame:
    """``(id, name, link, passage, source_file)`` to the document schema with cleaned text."""
    return raw.select(
        F.col("id").cast("string").alias("doc_id"),
        F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"),
        F.coalesce(F.col("link").cast("string"), F.lit("")).alias("link"),
        tx.clean_document(F.col("passage"), compose).alias("text"),
        "source_file",
    )


def first_passages(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """Drop empty texts and later copies of a text, keeping the first in ``order``.

    The rank-one filter becomes a group limit that runs before the shuffle as well, so a text copied
    into a third of all rows leaves every map task as one row.
    """
    keyed = docs.withColumn("_key", F.sha2("text", 256))
    w = Window.partitionBy("_key").orderBy(order)
    first = keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")
    # Empty texts are one group by now; testing earlier would evaluate the cleaning twice.
    return first.where(F.length("text") > 0)


def passage_groups(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """One row per distinct non-empty text: the document kept and how many copies were dropped."""
    return (docs.where(F.length("text") > 0)
            .groupBy(F.sha2("text", 256).alias("passage"))
            .agg(F.min(order).alias("kept_id"), (F.count("*") - 1).alias("dropped")))


def corpus_report(docs: DataFrame) -> DataFrame:
    """Counts of the corpus scan: documents kept, empty ones, duplicate passages."""
    empty = docs.agg(F.count_if(F.length("text") == 0).alias("empty_documents"))
    kept = passage_groups(docs).agg(F.count("*").alias("documents"),
                                    F.sum("dropped").alias("duplicate_passages"))
    return kept.withColumn("empty_documents", empty.select("empty_documents").scalar())


def duplicate_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Identifiers that occur more than once (an error for a corpus)."""
    return docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def document_number(text: Column, opening: int | None = None) -> Column:
    """Number after the first line label of a document (of its ``opening`` characters only), else empty."""
    line = F.regexp_extract(text if opening is None else F.substring(text, 1, opening), lx.NUMBER_LINE, 1)
    return F.regexp_extract(line, "(?U)(" + lx.DOC_NUMBER + ")", 1)


def parents(docs: DataFrame, heading_line: str = lx.ARTICLE_LINE,
            heading: str = lx.ARTICLE_HEADING) -> DataFrame:
    """Split documents in front of every heading line.

    ``ordinal`` counts all pieces of a document, blank ones included; ``position`` counts the stored
    (non-blank) ones. Both come from the array of pieces of the row, so nothing is shuffled.
    """
    pieces = F.split("text", f"(?imUd)(?=^{heading_line})")
    numbered = F.transform(pieces, lambda p, i: F.struct(i.alias("ordinal"), tx.strip(p).alias("body")))
    stored = F.filter(numbered, lambda s: F.length(s["body"]) > 0)
    extra = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", *extra, document_number(F.col("text")).alias("number"),
                       F.posexplode(stored).alias("position", "piece"))
    body = F.col("piece.body")
    return rows.select(
        F.concat_ws(":", "doc_id", "piece.ordinal").alias("parent_id"), "doc_id",
        F.col("piece.ordinal").alias("ordinal"), "position",
        tx.squeeze(F.regexp_extract(body, "(?imU)\\A" + heading, 1)).alias("heading"),
        "number", body.alias("text"), *extra)


def header(number: Column, heading: Column, limit: int) -> Column:
    """Number and heading of a parent, cut to ``limit`` blank-separated tokens."""
    joined = F.concat_ws(" ", F.nullif(number, F.lit("")), F.nullif(heading, F.lit("")))
    return F.array_join(F.slice(tx.words(joined), 1, limit), " ")


def windows(parent_rows: DataFrame, chunking: Chunking | None = None) -> DataFrame:
    """Overlapping windows of blank-separated tokens with their character offsets.

    The text is cut once into strides of ``size - overlap`` tokens; a window is one stride plus the
    first ``overlap`` tokens of the next. A stride the previous window already covers starts no
    window of its own. Adds ``window``, ``start``, ``end`` and ``chunk``; other columns stay.
    """
    c = chunking or Chunking()
    stride = c.size - c.overlap
    unit = f"{lx.JAVA_NON_WS}[{lx.WS}]*+"
    blocks = F.regexp_extract_all("text", F.lit(f"(?:{unit}){{1,{stride}}}+"), F.lit(0))
    indent = F.length("text") - F.length(F.ltrim("text", F.lit(lx.WS_CHARS)))
    rest = [F.col(x) for x in parent_rows.columns if x != "text"]
    cut = parent_rows.select(*rest, blocks.alias("_b"), indent.alias("_indent"))
    heads = F.transform("_b", lambda b: F.regexp_extract(b, f"^(?:{unit}){{0,{c.overlap}}}+", 0))
    starts = F.transform("_b", lambda b, i: F.aggregate(
        F.slice("_b", F.lit(1), i), F.col("_indent"), lambda a, x: a + F.length(x)))
    cut = cut.select(*rest, "_b", heads.alias("_h"), starts.alias("_s"))
    pieces = F.transform("_b", lambda b, i: F.struct(
        i.alias("window"), F.get("_s", i).alias("start"), F.get("_h", i).alias("head"),
        b.alias("b"), F.coalesce(F.get("_h", i + 1), F.lit("")).alias("next")))
    kept = F.filter(pieces, lambda p: (p["window"] == 0) | (F.length(p["head"]) < F.length(p["b"])))
    rows = cut.select(*rest, F.explode(kept).alias("_p"))
    chunk = F.rtrim(F.concat("_p.b", "_p.next"), F.lit(lx.WS_CHARS))
    return rows.select(
        *rest, F.col("_p.window").alias("window"), F.col("_p.start").alias("start"),
        (F.col("_p.start") + F.length(chunk)).alias("end"), chunk.alias("chunk"))


def document_chunks(docs: DataFrame, chunking: Chunking | None = None) -> DataFrame:
    """Chunks of documents with integer ids that have no article structure.

    Each document is its own parent and its source serves as header. The chunk id is computed from
    document and window number, so it does not depend on the order of execution.
    """
    rows = windows(docs.select("doc_id", "text", F.col("source").alias("header")), chunking)
    return rows.select(
        chunk_key(F.col("doc_id"), F.col("window")).alias("chunk_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("parent_id"),
        "doc_id", "start", "end", "header", F.col("chunk").alias("text"))


def chunk_key(doc_id: Column, window: Column) -> Column:
    return (doc_id * F.lit(1 << WINDOW_BITS) + window).cast("bigint")


def neighbours(parent_rows: DataFrame, seeds: DataFrame, distance: int = 1) -> DataFrame:
    """Parents of the same document within ``distance`` stored positions of a seed, seeds excluded.

    Each seed names the positions it wants and meets the parents in an equi-join on
    (document, position); no pairs inside a document are formed.
    """
    offsets = [o for o in range(-distance, distance + 1) if o]
    extra = [c for c in seeds.columns if c not in ("doc_id", "position")]
    wanted = seeds.select("doc_id", *extra, F.col("position").alias("seed_position"),
                          F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"))
    wanted = wanted.withColumn("position", F.col("seed_position") + F.col("offset"))
    return wanted.join(parent_rows, ["doc_id", "position"])
