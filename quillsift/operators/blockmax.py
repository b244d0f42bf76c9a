"""BM25 ranking from a stored index with block maxima.

The index holds one row per (token, block of chunks): how many chunks of the block hold the token, the largest
contribution it can make there (its inverse document frequency aside) and the postings themselves. A block is a run of
chunks as they were stored, so postings are made where the chunks lie and nothing is shuffled. Phrases have no rows of
their own, because all three- and four-token runs of a corpus take many times its size: the phrase ranking looks the
asked ones up in one pass over the stored chunks. The light columns alone decide which blocks can matter: the sum of the largest contributions of a question's units bounds every score in a block. The most promising
blocks are scored first; the k-th score found there is a lower bound of the final k-th score, so every block whose
bound lies below it is out, exactly. The strict conjunction needs blocks in which enough of its terms occur at all.
Chunks of other blocks are not scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillsift.config import Retrieval
from quillsift.functions import text as tx
from quillsift.operators import lexical, scoring
from quillsift.operators.lexical import B, BRANCHES, K1
from quillsift.operators.sizing import hinted, lookup_join
from quillsift.session import settled

#: Chunks of a block; groups of units by hash.
BLOCK_CHUNKS, FOLDERS = 32, 64
#: Tokens of a run of blocks that the build holds and sorts at once.
RUN_TOKENS = 1 << 20
#: Scores are rounded to nine digits; a bound has to fall short by more than that.
SLACK = 1e-6


def with_lengths(chunks: DataFrame) -> DataFrame:
    """Chunks with the tokens of header and text counted."""
    counted = F.size(tx.tokens(F.col("header"))) + F.size(tx.tokens(F.col("text")))
    return chunks.withColumn("length", counted)


def with_blocks(chunks: DataFrame, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """Chunks with the number of their block; blocks are fixed by the write that follows."""
    return chunks.withColumn("block", F.floor(F.monotonically_increasing_id() / F.lit(block_chunks)).cast("bigint"))


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunks and their tokens."""
    return chunks.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("n_tokens"))


def impact(f, length, average):
    """Contribution of a posting over its inverse document frequency."""
    return f * (K1 + 1) / (f + K1 * ((1 - B) + B * length / average))


def folder_of(unit, folders: int):
    """Folders are equal ranges of the unit's hash."""
    part = F.floor((F.xxhash64(unit).cast("double") / 2.0 ** 64 + 0.5) * folders)
    return F.least(part, F.lit(folders - 1)).cast("int")


BLOCKS = "unit string, block bigint, n bigint, most double"


def _postings(rows: pa.Table, average: float) -> pa.Table:
    """Chunks ``(length, block, head, body)`` of whole blocks to one row per unit and block, without folder."""
    length, block = (rows.column(c).to_numpy() for c in ("length", "block"))
    tokens, place, weight = [], [], []
    for name, w in scoring.WEIGHTS.items():
        column = rows.column(name).combine_chunks()
        n = np.diff(column.offsets.to_numpy())
        tokens.append(column.flatten())
        place.append(np.repeat(np.arange(len(n)), n))
        weight.append(np.full(int(n.sum()), w))
    coded = pa.concat_arrays(tokens).dictionary_encode()
    unit = coded.indices.to_numpy().astype(np.int64)
    # Rows of a chunk lie together, so in the order of unit and row those of a unit and block do as well.
    key, at = np.unique(unit * rows.num_rows + np.concatenate(place), return_inverse=True)
    f = np.bincount(at, np.concatenate(weight), len(key))
    unit, place = key // max(rows.num_rows, 1), key % max(rows.num_rows, 1)
    new = np.ones(len(key), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (block[place[1:]] != block[place[:-1]])
    starts, size = np.flatnonzero(new), length[place]
    ends = np.append(starts, len(key))
    most = np.maximum.reduceat(impact(f, size, average), starts) if len(starts) else np.zeros(0)
    return pa.table({"unit": coded.dictionary.take(pa.array(unit[starts])), "block": pa.array(block[place[starts]], pa.int64()),
                     "n": pa.array(np.diff(ends), pa.int64()), "most": pa.array(most)})


def _packed(average: float):
    """Chunks in stored order to rows per unit and block, a run of blocks at a time."""
    def out(rows: pa.Table):
        for batch in _postings(rows, average).to_batches(max_chunksize=1 << 14):
            yield batch

    def run(batches):
        held, tokens = [], 0
        for batch in batches:
            held.append(batch)
            tokens += sum(len(batch.column(c).flatten()) for c in scoring.WEIGHTS)
            if tokens < RUN_TOKENS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            # The last block may go on in the next batch.
            last = np.flatnonzero(rows.column("block").to_numpy() != rows.column("block")[-1].as_py())
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from out(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                tokens = sum(len(b.column(c).flatten()) for b in held for c in scoring.WEIGHTS)
        if held:
            yield from out(pa.Table.from_batches(held).combine_chunks())
    return run


def blocks(chunks: DataFrame, stats, folders: int = FOLDERS) -> DataFrame:
    """Tokens of ``chunks(header, text, length, block)`` by unit and block.

    Units are counted where the chunks lie; a block that two tasks read has a row of either, whose sums bound it as
    well. Rows are sorted by ``folder``, a hash of the unit, so readers of few units skip pages. ``stats`` is the row
    of ``statistics``.
    """
    cut = chunks.select(F.col("length").cast("int").alias("length"), "block",
                        tx.tokens(F.col("header")).alias("head"), tx.tokens(F.col("text")).alias("body"))
    average = stats.n_tokens / max(stats.n_rows, 1)
    rows = cut.where(F.col("head").isNotNull() & F.col("body").isNotNull()).mapInArrow(_packed(average), BLOCKS)
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return rows.select(folder_of(F.col("unit"), folders).alias("folder"), *names).sortWithinPartitions("folder")


def asked_blocks(index: DataFrame, units: DataFrame, rows: int, folders: int = FOLDERS) -> DataFrame:
    """Light rows ``(unit, block, n, most, folder)`` of the units that questions ask for."""
    asked = units.select("unit").distinct().withColumn("folder", folder_of(F.col("unit"), folders))
    named = [r.folder for r in asked.select("folder").distinct().collect()]  # at most ``folders``
    near = index.where(F.col("folder").isin(named)).select("unit", "block", "n", "most", "folder")
    return lookup_join(near, asked.select("unit"), "unit", rows, "left_semi", spread_by=["block"])


def weighed_units(units: DataFrame, light: DataFrame, stats, rows: int) -> DataFrame:
    """Questions' units that occur, with their inverse document frequency and a number for each unit."""
    df = light.groupBy("unit").agg(F.sum("n").alias("df")).withColumn("uid", F.row_number().over(Window.orderBy("unit")))
    idf = lexical.inverse_frequency(F.lit(float(stats.n_rows)), F.col("df"))
    return df.join(hinted(units, rows), "unit").withColumn("idf", idf).drop("df")


def bounds(light: DataFrame, weighed: DataFrame, rows: int, cfg: Retrieval, branches=BRANCHES) -> DataFrame:
    """``(branch, qid, block, bound, filled)``: no chunk of the block scores more for the question.

    ``filled`` is a lower bound of the chunks of the block that the branch admits. Blocks that cannot hold a
    conjunction are left out.
    """
    hits = lookup_join(light, weighed, "unit", rows, spread_by=["block"]).withColumn("s", F.col("idf") * F.col("most"))
    rank, entries, aggs = F.col("precise_rank"), [], []
    entry = lambda name, bound, filled, fits=F.lit(True): F.struct(
        F.lit(name).alias("branch"), bound.alias("bound"), filled.cast("bigint").alias("filled"), fits.alias("fits"))
    if "bm25" in branches:
        own = F.col("broad") == 1
        # Chunks with the unit that promises most: as many are admitted, and they are likely to score high.
        aggs += [F.sum(F.when(own, F.col("s"))).alias("bm25"), F.max_by(F.when(own, F.col("n")), F.when(own, F.col("s"))).alias("n_bm25")]
        entries.append(entry("bm25", F.col("bm25"), F.col("n_bm25"), F.col("bm25").isNotNull()))
    if "bm25_precise" in branches:
        widest = max(cfg.and_levels)
        aggs += [F.max("n_terms").alias("n_terms"), F.sum(F.when(rank > 0, F.col("s"))).alias("bm25_precise")]
        fits = F.lit(False)
        for width in cfg.and_levels:
            inside = (rank > 0) & (rank <= width)
            aggs.append(F.count_if(inside).alias(f"c{width}"))
            fits = fits | (F.col(f"c{width}") >= F.least(F.lit(width), F.col("n_terms")))
        entries.append(entry("bm25_precise", F.col("bm25_precise"), F.lit(0), fits & (F.col("n_terms") >= 3) & F.lit(widest > 0)))
    table = hits.groupBy("qid", "block").agg(*aggs)
    return (table.select("qid", "block", F.explode(F.filter(F.array(*entries), lambda e: e["fits"])).alias("e"))
            .select("e.branch", "qid", "block", "e.bound", "e.filled"))


def _scores(chunks: DataFrame, chosen: DataFrame, weighed: DataFrame, asked: scoring.Asked, cfg: Retrieval, average: float) -> DataFrame:
    """Best scores among the chunks of the chosen ``(branch, qid, block)``; others are dropped before their text is cut.

    A block that one question needs is scored for all, which changes nothing: their best chunks lie elsewhere.
    """
    wanted = settled(chosen.select("block").distinct())
    kept = lookup_join(chunks, wanted, "block", wanted.count(), "left_semi", spread_by=["chunk_id"])
    vocabulary = scoring.Vocabulary.of(weighed.select("unit", "uid").distinct())
    weights = scoring.Weights.of(weighed.select("uid", "idf", F.lit(average).alias("avg_length")).distinct(), vocabulary, K1, B)
    posts = scoring.packed_postings(lexical.cut_chunks(kept), vocabulary)
    return scoring.best_of_packed(posts, vocabulary, weights, asked, cfg)


def ranked(index: DataFrame, chunks: DataFrame, stats, questions: lexical.Questions, cfg: Retrieval | None = None, branches=BRANCHES,
           folders: int = FOLDERS, report: list | None = None) -> DataFrame:
    """``(branch, qid, chunk_id, level, score, rank)``, equal to ``lexical.rankings`` on the indexed chunks.

    ``index``, ``chunks`` and ``stats`` come from ``sinks.read_index``. ``report`` receives the table of block bounds with the
    column ``read``, true for the blocks that were not ruled out.
    """
    cfg, rows = cfg or Retrieval(), questions.units
    if "bm25_phrases" in branches:
        phrases = lexical.rankings(chunks, questions, cfg, ("bm25_phrases",))
        others = tuple(b for b in branches if b != "bm25_phrases")
        return phrases.unionByName(ranked(index, chunks, stats, questions, cfg, others, folders, report)) if others else phrases
    units = lexical.question_units(questions.rows, cfg, branches)
    light = settled(asked_blocks(index, units, rows, folders))
    weighed = settled(weighed_units(units, light, stats, rows))
    bound = settled(bounds(light, weighed, rows, cfg, branches))
    average = stats.n_tokens / max(stats.n_rows, 1)
    asked = scoring.Asked.of(weighed, branches)
    limit = F.when(F.col("branch") == "bm25", F.lit(cfg.broad_k)).otherwise(F.lit(cfg.precise_k))
    best = Window.partitionBy("branch", "qid").orderBy(F.desc("bound"), "block")
    before = best.rowsBetween(Window.unboundedPreceding, -1)
    # Enough blocks to hold k admitted chunks; a window over the blocks of one question and branch.
    first = bound.where("filled > 0").withColumn("so_far", F.coalesce(F.sum("filled").over(before), F.lit(0))).where(F.col("so_far") < limit)
    found = lexical.top_ranked(_scores(chunks, first, weighed, asked, cfg, average), cfg)
    least = found.where(F.col("rank") == limit).select("branch", "qid", F.col("score").alias("least"))
    judged = bound.join(hinted(least, 3 * questions.count), ["branch", "qid"], "left").withColumn(
        "read", F.col("bound") >= F.coalesce(F.col("least"), F.lit(0.0)) - SLACK)
    if report is not None:
        judged = settled(judged)
        report.append(judged)
    return lexical.top_ranked(_scores(chunks, judged.where("read"), weighed, asked, cfg, average), cfg)
