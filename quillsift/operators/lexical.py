"""Lexical ranking of chunks for whole batches of questions.

One pass over the corpus serves three rankings: a broad OR of the question's tokens, an OR of its
three- and four-word phrases and a strict conjunction of its most specific terms. The corpus is read
and cut into tokens once, only units that occur in some question leave the scan, and the single
shuffle before the top-k is by chunk, so the (question, chunk) table never crosses the network.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillsift.config import Retrieval
from quillsift.functions import text as tx
from quillsift.operators import scoring
from quillsift.operators.sizing import hinted, lookup_join
from quillsift.session import settled

K1, B = 1.2, 0.75
HEADER_WEIGHT, TEXT_WEIGHT = scoring.WEIGHTS["head"], scoring.WEIGHTS["body"]
IDF_FLOOR = 1e-6
DIGITS = 9
# Marks a unit found in the header; cannot be part of a token.
HEADER_MARK = "\x01"
# A pseudo unit every chunk holds once: its postings count chunks and sum their lengths.
EVERY = ""

# Units of questions (one row each) that are shared with every task.
ASKED_BOUND = 1_000_000

BRANCHES = ("bm25", "bm25_phrases", "bm25_precise")


@dataclass
class Questions:
    """A question table ``(qid, question)`` with its rows and tokens, which bound all derived sides."""

    rows: DataFrame
    count: int
    tokens: int

    @classmethod
    def of(cls, rows: DataFrame) -> "Questions":
        n, tokens = rows.agg(F.count("*"), F.coalesce(F.sum(F.size(tx.tokens(F.col("question")))), F.lit(0))).first()
        return cls(rows, n, max(tokens, 0))

    @property
    def units(self) -> int:
        """No more units than this: a token asks for itself, two phrases and a place among the strict terms."""
        return 4 * self.tokens + 1


def _first(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def question_units(questions: DataFrame, cfg: Retrieval, branches=BRANCHES) -> DataFrame:
    """What each question asks for: one row per (qid, unit) with the branches it serves.

    ``precise_rank`` numbers the content terms from the longest on (earlier position first among
    equals); ``n_terms`` is how many there are. Units without a role in ``branches`` are left out.
    """
    toks = tx.tokens(F.col("question"))
    q = questions.select("qid", toks.alias("toks"))
    parts = []
    if "bm25" in branches:
        parts.append(F.transform(
            _first(F.array_distinct("toks"), cfg.max_query_tokens),
            lambda t: F.struct(t.alias("unit"), F.lit(1).alias("broad"), F.lit(0).alias("phrase"),
                               F.lit(0).alias("precise_rank"))))
    if "bm25_phrases" in branches:
        grams = F.array_distinct(F.concat(tx.loaded_ngrams(F.col("toks"), 4),
                                          tx.loaded_ngrams(F.col("toks"), 3)))
        parts.append(F.transform(
            _first(grams, cfg.max_query_phrases),
            lambda t: F.struct(t.alias("unit"), F.lit(0).alias("broad"), F.lit(1).alias("phrase"),
                               F.lit(0).alias("precise_rank"))))
    if "bm25_precise" in branches:
        ranked = F.array_sort(F.transform(
            F.col("terms"), lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
        top = F.when(F.size("terms") >= 3, F.slice(ranked, 1, max(cfg.and_levels))).otherwise(
            F.slice(ranked, 1, 0))
        parts.append(F.transform(
            top, lambda s, i: F.struct(s["t"].alias("unit"), F.lit(0).alias("broad"),
                                       F.lit(0).alias("phrase"), (i + 1).alias("precise_rank"))))
    q = q.withColumn("terms", tx.content_terms(F.col("toks")))
    rows = q.select("qid", F.size("terms").alias("n_terms"), F.explode(F.concat(*parts)).alias("u"))
    return (rows.groupBy("qid", F.col("u.unit").alias("unit"))
            .agg(F.max("n_terms").alias("n_terms"), F.max("u.broad").alias("broad"),
                 F.max("u.phrase").alias("phrase"), F.max("u.precise_rank").alias("precise_rank")))


def chunk_units(toks: str, phrases: bool) -> Column:
    """Tokens of a token column, with its three- and four-token runs when phrases are asked for."""
    col = F.col(toks)
    return F.concat(col, tx.ngrams(col, 3), tx.ngrams(col, 4)) if phrases else col


def _occurrences(chunks: DataFrame, phrases: bool) -> DataFrame:
    """One row per occurrence of a unit: ``(chunk_id, length, unit, w)``."""
    # Tokens become columns first: the runs refer to them once per position.
    cut = chunks.select("chunk_id", tx.tokens(F.col("header")).alias("head"),
                        tx.tokens(F.col("text")).alias("body"))
    marked = F.transform(chunk_units("head", phrases), lambda u: F.concat(F.lit(HEADER_MARK), u))
    exploded = cut.select(
        "chunk_id", (F.size("head") + F.size("body")).alias("length"),
        F.explode(F.concat(F.array(F.lit(EVERY)), marked, chunk_units("body", phrases))).alias("raw"))
    in_header = F.startswith("raw", F.lit(HEADER_MARK))
    exploded = exploded.select(
        "chunk_id", "length",
        F.when(in_header, F.substring("raw", 2, 1 << 20)).otherwise(F.col("raw")).alias("unit"),
        F.when(in_header, F.lit(HEADER_WEIGHT)).otherwise(F.lit(TEXT_WEIGHT)).alias("w"))
    return exploded


def postings(chunks: DataFrame, vocabulary: DataFrame, rows: int, phrases: bool) -> DataFrame:
    """``(chunk_id, unit, length, f)`` for the units of the vocabulary, clustered by chunk.

    ``f`` weighs header and text occurrences, ``length`` is the token count of both fields. The
    vocabulary (at most ``rows`` entries) filters the exploded units on the map side; a column ``uid`` of it
    takes the place of the unit.
    """
    exploded = _occurrences(chunks, phrases)
    key = "uid" if "uid" in vocabulary.columns else "unit"
    # The null test is what joins on the unit would push down; stated here, every reader of the
    # shuffle below sees the same plan and it runs once.
    kept = lookup_join(exploded.where(F.col("unit").isNotNull()), vocabulary, "unit", rows,
                       "left_semi" if key == "unit" else "inner", spread_by=["chunk_id"])
    return (kept.repartition("chunk_id").groupBy("chunk_id", key, "length")
            .agg(F.sum("w").alias("f")))


def with_statistics(units: DataFrame, posts: DataFrame, rows: int) -> DataFrame:
    """Give every question unit its inverse document frequency and the corpus averages.

    The length takes part so that this branch needs the same columns as the scoring branch and the
    shuffle behind ``posts`` is executed once for both.
    """
    stats = posts.groupBy("unit").agg(F.count("length").alias("df"), F.sum("length").alias("total"),
                                      F.max("f").alias("max_f"))
    whole = stats.where(F.col("unit") == EVERY)
    joined = (stats.where(F.col("max_f") > 0).join(hinted(units, rows), "unit")
              .withColumn("n_rows", whole.select("df").scalar())
              .withColumn("n_tokens", whole.select("total").scalar()))
    return (joined.withColumn("avg_length", F.col("n_tokens") / F.col("n_rows"))
            .withColumn("idf", inverse_frequency(F.col("n_rows"), F.col("df")))
            .drop("df", "total", "max_f", "n_rows", "n_tokens"))


def inverse_frequency(rows: Column, df: Column) -> Column:
    idf = F.ln((rows - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR))


def contribution() -> Column:
    f, length = F.col("f"), F.col("length")
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.col("avg_length"))
    return F.col("idf") * f * F.lit(K1 + 1) / (f + norm)


def branch_scores(posts: DataFrame, units: DataFrame, rows: int, cfg: Retrieval,
                  branches=BRANCHES) -> DataFrame:
    """``(branch, qid, chunk_id, level, score)`` for every chunk a branch admits."""
    hits = lookup_join(posts, units, "unit", rows, spread_by=["chunk_id"]).withColumn("s", contribution())
    return entered(hits, cfg, branches)


def entered(hits: DataFrame, cfg: Retrieval, branches=BRANCHES, asked: str | None = None) -> DataFrame:
    """Contributions ``s`` of units summed per question and chunk; ``asked`` may name a column with the branches that want a row."""
    wants = lambda name: F.lit(True) if asked is None else F.array_contains(asked, name)
    rank = F.col("precise_rank")
    aggs = []
    if "bm25" in branches:
        aggs.append(F.sum(F.when((F.col("broad") == 1) & wants("bm25"), F.col("s"))).alias("bm25"))
    if "bm25_phrases" in branches:
        aggs.append(F.sum(F.when((F.col("phrase") == 1) & wants("bm25_phrases"), F.col("s"))).alias("bm25_phrases"))
    if "bm25_precise" in branches:
        aggs.append(F.max("n_terms").alias("n_terms"))
        for level in cfg.and_levels:
            inside = (rank > 0) & (rank <= level) & wants("bm25_precise")
            aggs += [F.count_if(inside).alias(f"c{level}"), F.sum(F.when(inside, F.col("s"))).alias(f"s{level}")]
    table = hits.groupBy("qid", "chunk_id").agg(*aggs)

    def entry(name, level, score):
        return F.struct(F.lit(name).alias("branch"), level.cast("int").alias("level"),
                        F.round(score, DIGITS).alias("score"))

    entries = [entry(b, F.lit(0), F.col(b)) for b in branches if b != "bm25_precise"]
    if "bm25_precise" in branches:
        # The strictest conjunction a chunk satisfies decides; a stricter one is a subset of a looser.
        level, score = F.lit(None), F.lit(None)
        for i, width in reversed(list(enumerate(cfg.and_levels))):
            met = F.col(f"c{width}") >= F.least(F.lit(width), F.col("n_terms"))
            met = met & (F.col("n_terms") >= 3)
            level = F.when(met, F.lit(i)).otherwise(level)
            score = F.when(met, F.col(f"s{width}")).otherwise(score)
        entries.append(entry("bm25_precise", level, score))
    admitted = F.filter(F.array(*entries), lambda e: e["score"].isNotNull())
    return (table.select("qid", "chunk_id", F.explode(admitted).alias("e"))
            .select(F.col("e.branch").alias("branch"), "qid", "chunk_id",
                    F.col("e.level").alias("level"), F.col("e.score").alias("score")))


def top_ranked(scores: DataFrame, cfg: Retrieval) -> DataFrame:
    """Best chunks of each branch: stricter level, higher score, lower chunk id first."""
    w = Window.partitionBy("branch", "qid").orderBy("level", F.desc("score"), "chunk_id")
    limit = F.when(F.col("branch") == "bm25", F.lit(cfg.broad_k)).otherwise(F.lit(cfg.precise_k))
    most = max(cfg.broad_k, cfg.precise_k)
    ranked = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.where(F.col("rank") <= limit)


def rankings(chunks: DataFrame, questions: Questions, cfg: Retrieval | None = None,
             branches=BRANCHES, asked_bound: int = ASKED_BOUND) -> DataFrame:
    """``(branch, qid, chunk_id, level, score, rank)`` of the asked branches.

    ``chunks`` needs ``chunk_id, header, text``. Up to ``asked_bound`` units of questions the question side is
    shared with every task and sums are made there; beyond that units, questions and chunks meet in joins.
    """
    cfg = cfg or Retrieval()
    rows = questions.units
    units = question_units(questions.rows, cfg, branches)
    if rows > asked_bound:
        posts = postings(chunks, vocabulary_of(units), rows, "bm25_phrases" in branches)
        weighed = with_statistics(units, posts, rows)
        return top_ranked(branch_scores(posts, weighed, rows, cfg, branches), cfg)
    units = settled(units)
    numbered = numbered_units(units)
    # Statistics and scores read the postings; the pass over the texts that makes them runs once.
    vocabulary = scoring.Vocabulary.of(numbered)
    posts = settled(scoring.packed_postings(cut_chunks(chunks), vocabulary))
    counts = scoring.unit_counts(posts, vocabulary)
    whole = F.col("uid") == 0
    every = counts.where(whole)
    stats = (counts.withColumn("n_rows", every.select("df").scalar()).withColumn("n_tokens", every.select("total").scalar()).where(~whole)
             .select("uid", inverse_frequency(F.col("n_rows"), F.col("df")).alias("idf"), (F.col("n_tokens") / F.col("n_rows")).alias("avg_length")))
    asked = scoring.Asked.of(units.join(F.broadcast(numbered), "unit"), branches)
    return top_ranked(scoring.best_of_packed(posts, vocabulary, scoring.Weights.of(stats, vocabulary, K1, B), asked, cfg), cfg)


def cut_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with the tokens of both fields, ``(chunk_id, head, body)``; a missing field leaves its chunk out."""
    cut = chunks.select("chunk_id", tx.tokens(F.col("header")).alias("head"), tx.tokens(F.col("text")).alias("body"))
    return cut.where(F.col("head").isNotNull() & F.col("body").isNotNull())


def numbered_units(units: DataFrame) -> DataFrame:
    """``(unit, uid)`` of the distinct units, numbered; 0 is the pseudo unit every chunk holds.

    One window over the vocabulary, whose size the questions bound.
    """
    place = F.row_number().over(Window.orderBy(F.col("unit") != EVERY, "unit")) - 1
    return settled(vocabulary_of(units).withColumn("uid", place))


def vocabulary_of(units: DataFrame) -> DataFrame:
    """Distinct units with the pseudo unit every chunk holds."""
    every = units.sparkSession.range(1).select(F.lit(EVERY).alias("unit"))
    return units.select("unit").unionByName(every).distinct()
