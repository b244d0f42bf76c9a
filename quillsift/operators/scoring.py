"""Scores of many questions at once from postings that lie together by chunk.

A row per (question, unit, chunk) is never made in the JVM: each task turns its postings into sums per question and
chunk with numpy, slice by slice, and lets only the best chunks of every question leave. The question side (which
unit serves which question) is small by a bound that the caller checks; it is shared as three sparse tables.

Postings are packed, one row per chunk: a chunk lies whole in one row of the scan, so its units are looked up and
counted there, and neither an occurrence nor a posting is ever shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quillsift.config import Retrieval

DIGITS = 9
SCORES = "branch string, qid long, chunk_id long, level int, score double"
#: Sums and hits that a task holds at once; rows that it keeps before it drops what no longer is among the best.
CELLS, HITS, KEPT = 1 << 22, 1 << 22, 1 << 20
PACKED = "chunk_id long, length int, uids binary, weights binary"
#: Weights of occurrences in header and text; their sums are exact in 32 bits.
WEIGHTS = {"head": 2.5, "body": 1.0}
#: Tokens of a batch that are looked up at once.
TOKENS = 1 << 20


@dataclass
class Sparse:
    """For every unit number the questions it serves (places into ``qids``) and its rank in each."""

    first: np.ndarray
    question: np.ndarray
    rank: np.ndarray

    @classmethod
    def of(cls, uid: np.ndarray, question: np.ndarray, rank: np.ndarray, units: int) -> "Sparse":
        order = np.argsort(uid, kind="stable")
        return cls(np.searchsorted(uid[order], np.arange(units + 1)), question[order], rank[order])

    def hits(self, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings and table rows of all (posting, question) pairs."""
        n = self.first[uid + 1] - self.first[uid]
        posting = np.repeat(np.arange(len(uid)), n)
        return posting, np.repeat(self.first[uid] - (np.cumsum(n) - n), n) + np.arange(len(posting))

    def count(self, uid: np.ndarray) -> np.ndarray:
        return self.first[uid + 1] - self.first[uid]


@dataclass
class Asked:
    """The question side: numbers of units come from the column ``uid``."""

    qids: np.ndarray
    terms: np.ndarray
    tables: dict[str, Sparse]

    @classmethod
    def of(cls, units: DataFrame, branches) -> "Asked":
        """From ``(uid, qid, n_terms, broad, phrase, precise_rank)``, collected: the caller has bounded its rows."""
        rows = units.select("uid", "qid", "n_terms", "broad", "phrase", "precise_rank").toArrow()
        uid, qid, terms, broad, phrase, rank = (rows.column(c).to_numpy() for c in range(6))
        qids, place = np.unique(qid.astype(np.int64), return_inverse=True)
        n_terms = np.zeros(len(qids), np.int64)
        n_terms[place] = terms
        roles = {"bm25": broad == 1, "bm25_phrases": phrase == 1, "bm25_precise": rank > 0}
        units_known = int(uid.max()) + 1 if len(uid) else 0
        tables = {b: Sparse.of(uid[roles[b]].astype(np.int64), place[roles[b]], rank[roles[b]], units_known) for b in branches}
        return cls(qids, n_terms, tables)


@dataclass
class Vocabulary:
    """Numbered units: tokens of questions, and a tree of their phrases whose nodes are (node before, token).

    Level ``n`` of the tree holds the sorted keys ``node * tokens + token`` of the runs of ``n + 2`` tokens that begin
    a phrase, and the unit of each run (-1 where it is no phrase itself).
    """

    tokens: pa.Array
    uids: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    units: int

    @classmethod
    def of(cls, numbered: DataFrame) -> "Vocabulary":
        """From ``(unit, uid)``, collected: the caller has bounded its rows. Unit 0 is the one every chunk holds."""
        rows = numbered.where("uid > 0").select("unit", "uid").toArrow()
        words, uids = [u.split(" ") for u in rows.column("unit").to_pylist()], rows.column("uid").to_pylist()
        place = {t: i for i, t in enumerate(dict.fromkeys(t for w in words for t in w))}
        single = np.full(len(place), -1, np.int64)
        tree: list[dict[int, list[int]]] = [{} for _ in range(max((len(w) for w in words), default=1) - 1)]
        for w, uid in zip(words, uids):
            if len(w) == 1:
                single[place[w[0]]] = uid
        # Level by level, because the number of a node is its place among the sorted keys of its level.
        node = [place[w[0]] for w in words]
        levels = []
        for depth in range(len(tree)):
            keys = {}
            for i, w in enumerate(words):
                if len(w) > depth + 1:
                    key = node[i] * len(place) + place[w[depth + 1]]
                    keys[key] = uids[i] if len(w) == depth + 2 else keys.get(key, -1)
            order = np.array(sorted(keys), np.int64)
            at = {key: i for i, key in enumerate(order.tolist())}
            for i, w in enumerate(words):
                if len(w) > depth + 1:
                    node[i] = at[node[i] * len(place) + place[w[depth + 1]]]
            levels.append((order, np.array([keys[k] for k in order.tolist()], np.int64)))
        return cls(pa.array(list(place), pa.string()), single, levels, max(uids, default=0) + 1)

    @property
    def kind(self):
        return np.uint16 if self.units <= 1 << 16 else np.int32

    def found(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Row and unit of every occurrence in a column of token lists."""
        lengths = np.diff(column.offsets.to_numpy())
        row = np.repeat(np.arange(len(lengths)), lengths)
        token = pc.fill_null(pc.index_in(column.flatten(), value_set=self.tokens), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = np.flatnonzero(token >= 0)
        uid = self.uids[token[known]] if len(known) else known
        rows, units = [row[known[uid >= 0]]], [uid[uid >= 0]]
        at, node = known, token[known]
        for depth, (keys, unit) in enumerate(self.levels, 1):
            inside = at + depth < len(token)
            at, node = at[inside], node[inside]
            follows = (row[at] == row[at + depth]) & (token[at + depth] >= 0)
            at, node = at[follows], node[follows]
            key = node * len(self.tokens) + token[at + depth]
            place = np.searchsorted(keys, key)
            hit = np.flatnonzero(place < len(keys))
            hit = hit[keys[place[hit]] == key[hit]]
            at, node = at[hit], place[hit]
            phrase = unit[node] >= 0
            rows.append(row[at[phrase]])
            units.append(unit[node[phrase]])
        return np.concatenate(rows), np.concatenate(units)


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of an array, which end at ``ends``, as one binary value each."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.BinaryArray, kind) -> np.ndarray:
    """All values of a binary column end to end."""
    if not len(column):
        return np.zeros(0, kind)
    first, last = (int(np.frombuffer(column.buffers()[1], np.int32)[column.offset + i]) for i in (0, len(column)))
    return np.frombuffer(column.buffers()[2], np.uint8)[first:last].view(kind) if last > first else np.zeros(0, kind)


def packer(vocabulary: Vocabulary):
    """Arrow batches ``(chunk_id, head, body)`` to one row per chunk with its units and their weighed counts."""
    def pieces(batch):
        size = sum(np.diff(batch.column(c).offsets.to_numpy()) for c in WEIGHTS)
        part = np.concatenate([[0], np.cumsum(size)[:-1]]) // TOKENS
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:]):
            yield batch.slice(a, b - a), size[a:b]

    def run(batches):
        for whole in batches:
            if not whole.num_rows:
                continue
            for batch, size in pieces(whole):
                keys, weights = [], []
                for name, weight in WEIGHTS.items():
                    row, uid = vocabulary.found(batch.column(name))
                    key, count = np.unique(row * vocabulary.units + uid, return_counts=True)
                    keys.append(key)
                    weights.append(count * weight)
                key, place = np.unique(np.concatenate(keys), return_inverse=True)
                f = np.bincount(place, np.concatenate(weights), len(key)).astype(np.float32)
                ends = np.searchsorted(key, np.arange(1, batch.num_rows + 1) * vocabulary.units)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk_id"), pa.array(size, pa.int32()), _binary((key % vocabulary.units).astype(vocabulary.kind), ends), _binary(f, ends)],
                    ["chunk_id", "length", "uids", "weights"])
    return run


def packed_postings(cut: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``PACKED`` rows of the chunks ``(chunk_id, head, body)``, also of those without any unit."""
    shared = cut.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        yield from packer(shared.value)(batches)

    return cut.select("chunk_id", "head", "body").mapInArrow(run, PACKED)


def unit_counts(posts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(uid, df, total)``: chunks that hold a unit; unit 0 counts all chunks and, in ``total``, their tokens."""
    units, kind = vocabulary.units, vocabulary.kind

    def run(batches):
        df, total = np.zeros(units, np.int64), 0
        for batch in batches:
            df += np.bincount(_values(batch.column("uids"), kind), minlength=units)
            df[0] += batch.num_rows
            total += int(batch.column("length").to_numpy().sum(dtype=np.int64))
        uid = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(df[uid]), pa.array(np.where(uid == 0, total, 0))], ["uid", "df", "total"])

    rows = posts.select("uids", "length").mapInArrow(run, "uid long, df long, total long")
    return rows.groupBy("uid").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


@dataclass
class Weights:
    """Inverse document frequency by unit, the average length and the constants of the contribution."""

    idf: np.ndarray
    average: float
    k1: float
    b: float

    @classmethod
    def of(cls, stats: DataFrame, vocabulary: Vocabulary, k1: float, b: float) -> "Weights":
        rows = stats.select("uid", "idf", "avg_length").toArrow()
        idf = np.zeros(vocabulary.units)
        idf[rows.column("uid").to_numpy()] = rows.column("idf").to_numpy()
        return cls(idf, float(rows.column("avg_length")[0].as_py()) if rows.num_rows else 1.0, k1, b)

    def contributions(self, uid: np.ndarray, f: np.ndarray, length: np.ndarray) -> np.ndarray:
        norm = self.k1 * ((1 - self.b) + self.b * length / self.average)
        return self.idf[uid] * f * (self.k1 + 1) / (f + norm)


def best_of_packed(posts: DataFrame, vocabulary: Vocabulary, weights: Weights, asked: Asked, cfg: Retrieval) -> DataFrame:
    """``(branch, qid, chunk_id, level, score)``: every task's best chunks of every question, from ``PACKED`` rows."""
    kind = vocabulary.kind
    shared = posts.sparkSession.sparkContext.broadcast((asked, weights))

    def unpacked(batches, weights):
        for batch in batches:
            uid = _values(batch.column("uids"), kind).astype(np.int64)
            n = pc.binary_length(batch.column("uids")).to_numpy() // np.dtype(kind).itemsize
            f = _values(batch.column("weights"), np.float32).astype(np.float64)
            s = weights.contributions(uid, f, np.repeat(batch.column("length").to_numpy(), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("chunk_id").to_numpy(), n)), pa.array(uid), pa.array(s)], ["chunk_id", "uid", "s"])

    def run(batches):
        asked, weights = shared.value
        yield from scorer(asked, cfg)(unpacked(batches, weights))

    return posts.mapInArrow(run, SCORES)


class _Best:
    """The best rows of every question of a branch among those seen."""

    def __init__(self, k: int, questions: int):
        self.k, self.parts, self.held = k, [], 0
        #: Level and score of every question's k-th row so far; what comes after both is out.
        self.level, self.score = np.full(questions, np.iinfo(np.int64).max), np.full(questions, -np.inf)

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held > KEPT:
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        """Columns (question, chunk, level, score) of the ``k`` best by level, score and chunk."""
        columns = tuple(np.concatenate(c) for c in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        question, chunk, level, score = columns
        order = np.lexsort((chunk, -score, level, question))
        question = question[order]
        place = np.arange(len(order)) - np.searchsorted(question, question)
        keep, last = order[place < self.k], order[place == self.k - 1]
        self.level[columns[0][last]], self.score[columns[0][last]] = level[last], score[last]
        self.parts = [tuple(c[keep] for c in columns)]
        # What stays may be many questions; the next round comes when as much again has been added.
        self.held = 0
        return self.parts[0]


def scorer(asked: Asked, cfg: Retrieval):
    """Arrow batches ``(chunk_id, uid, s)`` in the order of chunks to the best rows of every question and branch."""
    def slices(batches) -> Iterator[tuple[np.ndarray, ...]]:
        """Runs of whole chunks, not more than fit."""
        most = max(1, CELLS // max(len(asked.qids), 1))
        weight = sum((t.count(np.arange(len(t.first) - 1)) for t in asked.tables.values()), np.zeros(0, np.int64) if not asked.tables else 0)
        held: list[tuple[np.ndarray, ...]] = []

        def cut(rows, last: bool):
            chunk, uid, s = rows
            edge = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if len(chunk) else np.zeros(1, np.int64)
            hits = np.concatenate([[0], np.cumsum(weight[uid])])
            at, stop = 0, len(edge) - 1 - (not last)
            while at < stop:
                end = min(stop, at + most, int(np.searchsorted(hits[edge], hits[edge[at]] + HITS, "right")) - 1)
                end = max(end, at + 1)
                yield chunk[edge[at]:edge[end]], uid[edge[at]:edge[end]], s[edge[at]:edge[end]]
                at = end
            rest = edge[max(stop, 0)]
            held[:] = [(chunk[rest:], uid[rest:], s[rest:])] if rest < len(chunk) else []

        size = 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk_id", "uid", "s")))
            size += batch.num_rows
            if size >= 1 << 17:
                yield from cut(tuple(map(np.concatenate, zip(*held))), False)
                size = sum(len(h[0]) for h in held)
        if held:
            yield from cut(tuple(map(np.concatenate, zip(*held))), True)

    def run(batches):
        best = {b: _Best(cfg.broad_k if b == "bm25" else cfg.precise_k, len(asked.qids)) for b in asked.tables}
        for chunk, uid, s in slices(batches):
            names, column = np.unique(chunk, return_inverse=True)
            shape = (len(asked.qids), len(names))
            for branch, table in asked.tables.items():
                posting, row = table.hits(uid)
                if not len(posting):
                    continue
                cell = table.question[row] * shape[1] + column[posting]
                if branch != "bm25_precise":
                    score = np.bincount(cell, s[posting], shape[0] * shape[1]).reshape(shape)
                    # Scores are compared as rounded; a little less than the k-th one lets all through that may tie with it.
                    q, c = np.nonzero((score != 0) & (score >= best[branch].score[:, None] - 10.0 ** (1 - DIGITS)))
                    best[branch].add(q, names[c], np.zeros(len(q), np.int64), np.round(score[q, c], DIGITS))
                    continue
                # Few cells hold enough terms, so only the cells that occur are counted.
                used, at = np.unique(cell, return_inverse=True)
                q, rank, level, score = used // shape[1], table.rank[row], np.full(len(used), -1), np.zeros(len(used))
                for i, width in reversed(list(enumerate(cfg.and_levels))):
                    inside = rank <= width
                    met = (np.bincount(at[inside], minlength=len(used)) >= np.minimum(width, asked.terms[q])) & (asked.terms[q] >= 3)
                    level[met] = i
                    score[met] = np.bincount(at[inside], s[posting][inside], len(used))[met]
                score = np.round(score, DIGITS)
                worst, least = best[branch].level[q], best[branch].score[q]
                found = (level >= 0) & ((level < worst) | ((level == worst) & (score >= least)))
                best[branch].add(q[found], names[used[found] % shape[1]], level[found], score[found])
        for branch, kept in best.items():
            q, chunk, level, score = kept.prune()
            for a in range(0, len(q), 1 << 16):
                b = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([branch] * len(q[b])), pa.array(asked.qids[q[b]]), pa.array(chunk[b], pa.int64()), pa.array(level[b], pa.int32()), pa.array(score[b])],
                    ["branch", "qid", "chunk_id", "level", "score"])
    return run


def best_scores(postings: DataFrame, asked: Asked, cfg: Retrieval) -> DataFrame:
    """``(branch, qid, chunk_id, level, score)``: every task's best chunks of every question.

    ``postings(chunk_id, uid, s)`` hold all postings of a chunk in one partition.
    """
    shared = postings.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        yield from scorer(shared.value, cfg)(batches)

    return postings.select("chunk_id", "uid", "s").sortWithinPartitions("chunk_id").mapInArrow(run, SCORES)
