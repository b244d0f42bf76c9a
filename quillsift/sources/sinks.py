"""Writers: index tables, packaged answers and reports."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from quillsift.operators import blockmax, corpus, lexical
from quillsift.operators.sizing import lookup_join
from quillsift.sources import integrity
from quillsift.sources.json_objects import require_none


def write_index(chunks: DataFrame | Callable[[DataFrame], DataFrame], parents: DataFrame, path: str, vectors: DataFrame | None = None,
                block_chunks: int = blockmax.BLOCK_CHUNKS, folders: int = blockmax.FOLDERS) -> None:
    """Write parents, chunks, the blocks of every token (table ``postings``), and optionally vectors ``(chunk_id, vector)`` of a corpus.

    ``chunks`` may be a function of the stored parents, so that what made these is not repeated; columns of the
    parents that only chunks need are stored as well. Blocks are sorted by ``folder`` (one of ``folders``, a hash of
    the token) in every file, so a batch of few questions skips pages. Chunk ids and parent ids that occur twice and chunks without
    parent are an error. The manifest is written last, so an unfinished index is never read.
    """
    spark = parents.sparkSession
    parents.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/parents")
    owners = spark.read.parquet(f"{path}/parents")
    cut = chunks(owners) if callable(chunks) else chunks
    blockmax.with_blocks(blockmax.with_lengths(cut), block_chunks).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    stored = spark.read.parquet(f"{path}/chunks")
    require_none(corpus.duplicate_ids(stored, "chunk_id"), "duplicate chunk id")
    require_none(corpus.duplicate_ids(owners, "parent_id"), "duplicate parent id")
    require_none(stored.select("parent_id").distinct().join(owners, "parent_id", "left_anti"), "chunk without parent")
    if vectors is not None:
        require_none(corpus.duplicate_ids(vectors, "chunk_id"), "duplicate vector id")
        vectors.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vectors")
    stats = blockmax.statistics(stored)
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
    blockmax.blocks(stored, stats.first(), folders).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    manifest = integrity.table_digest(stored, "chunk_id", "parent_id", "header", "text")
    manifest.withColumn("folders", F.lit(folders)).withColumn("vectors", F.lit(vectors is not None)).coalesce(1).write.mode(
        "overwrite").json(f"{path}/manifest")


@dataclass(frozen=True)
class Index:
    """A finished index: its tables, statistics and identity."""

    parents: DataFrame
    chunks: DataFrame
    postings: DataFrame
    vectors: DataFrame | None
    statistics: Row
    identity: str
    folders: int

    def rankings(self, questions: lexical.Questions, cfg=None, branches=lexical.BRANCHES, report: list | None = None) -> DataFrame:
        """``(branch, qid, chunk_id, level, score, rank)`` from the stored blocks and chunks."""
        return blockmax.ranked(self.postings, self.chunks, self.statistics, questions, cfg, branches, self.folders, report)

    def chunks_of(self, ids: DataFrame, rows: int) -> DataFrame:
        """Stored chunks behind ``ids`` (at most ``rows`` chunk ids)."""
        return lookup_join(self.chunks, ids.select("chunk_id").distinct(), "chunk_id", rows, "left_semi", spread_by=["chunk_id"])


def read_index(spark: SparkSession, path: str, identity: str | None = None) -> Index:
    """Open an index; fails if it is unfinished or not the expected one."""
    if not integrity.exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError("the index was not completed")
    manifest = spark.read.schema("n long, identity string, folders int, vectors boolean").json(f"{path}/manifest").first()
    if identity is not None and manifest.identity != identity:
        raise ValueError("the index was built from other chunks")
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(table("parents"), table("chunks"), table("postings"), table("vectors") if manifest.vectors else None,
                 table("statistics").first(), manifest.identity, manifest.folders)


def package_answers(answers: DataFrame, target: str, member: str = "submission.json") -> int:
    """Write ``{id: {"answer": text}}`` as the only member of a zip file, then read it back to check.

    Rows are streamed in id order, one partition at a time; ids must be unique and texts not blank.
    """
    if os.path.basename(member) != member or not member.endswith(".json"):
        raise ValueError("the member must be a plain .json name")
    temporary, count, last = target + ".tmp", 0, None
    rows = answers.select(F.col("id").cast("string").alias("id"), "answer").orderBy("id").toLocalIterator()
    # A fixed time stamp: equal answers give equal bytes.
    info = zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0))
    info.compress_type = zipfile.ZIP_DEFLATED
    with zipfile.ZipFile(temporary, "w") as archive, archive.open(info, "w", force_zip64=True) as out:
        out.write(b"{")
        for row in rows:
            if row.id == last or row.answer is None or not row.answer.strip():
                raise ValueError(f"duplicate id or blank answer: {row.id}")
            piece = f'{"," if count else ""}{json.dumps(row.id)}:{json.dumps({"answer": row.answer}, ensure_ascii=False)}'
            out.write(piece.encode())
            last, count = row.id, count + 1
        out.write(b"}")
    with zipfile.ZipFile(temporary) as archive:
        if archive.testzip() is not None or archive.namelist() != [member]:
            raise ValueError("archive verification failed")
    os.replace(temporary, target)
    return count


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)
