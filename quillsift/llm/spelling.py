"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

Words of one length are points: how often each letter occurs. A replaced letter moves a point by an L1 distance of
two, an inserted or deleted one by one. For every pair of lengths (n, n) and (n - 1, n) the words of the first are
searched for among those of the second: a k-d tree halves the points at medians, a search descends into every box
whose L1 distance is within two or one, and words in the reached leaves are compared letter by letter. Points of
equal vectors are never one edit apart, so anagrams meet only through their neighbours.

On Spark the upper part of each length's tree comes from a sample of at most ``SAMPLE`` words of that length (those of
smallest hash) and has a leaf per ``CELL_WORDS`` words. Every word lives in one cell and asks in all cells that its
ball reaches; pairs of one length are met once, in the later of their cells. A task indexes the words of a cell and
streams the questions past them, so its memory does not depend on how many ask.

A word's form is its near word of largest count (ties: smallest in code-point order) if that is at least twice its
own count. Counts at least double along forms, so roots are reached by a number of pointer doublings that the
largest count bounds. Null texts have no words, a null doc_id counts as the empty id, repeated rows count each, an
empty table gives no rows, other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillsift.operators.sizing import lookup_join
from quillsift.session import settled

LETTERS = r"A-Za-zÀ-ÿ"
#: Fixed by the task: share of runs that lose a letter, shortest word, rarest word.
DAMAGE, SHORTEST, RAREST = 97, 5, 3
SAMPLE, CELL_WORDS, LEAF_WORDS = 1 << 14, 1 << 13, 12
#: Pairs that a task compares at once, and questions it takes at once.
PAIRS, ASKED = 1 << 20, 1 << 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(documents: DataFrame, damage: int = DAMAGE, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """``(word, n)`` of all words of ``documents(doc_id, text)`` after the damage."""
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % damage == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= shortest) & (F.col("n") >= rarest))


# --- words as arrays ---------------------------------------------------------------------------------------------------


def letters_of(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length; all lie below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def slots() -> np.ndarray:
    """Dimension of every letter."""
    own = np.zeros(256, np.int64)
    own[97:123] = np.arange(26)
    own[0xC0:] = 26 + np.arange(64)
    return own


SLOT, DIMENSIONS = slots(), 90


def vectors_of(letters: np.ndarray) -> np.ndarray:
    """Letter counts, one row per dimension: a search reads one dimension of many points at a time."""
    n = len(letters)
    places = SLOT[letters] + DIMENSIONS * np.arange(n)[:, None]
    return np.ascontiguousarray(np.bincount(places.ravel(), minlength=DIMENSIONS * n).reshape(n, DIMENSIONS).T.astype(np.int32))


def lanes_of(letters: np.ndarray, backwards: bool = False) -> list[np.ndarray]:
    """Letters packed eight to an integer, the first letter (or the last, backwards) in the lowest byte."""
    letters = letters[:, ::-1] if backwards else letters
    width = -(-letters.shape[1] // 8) * 8
    padded = np.zeros((len(letters), width), np.uint8)
    padded[:, :letters.shape[1]] = letters
    return [np.ascontiguousarray(padded[:, k:k + 8]).view("<u8").ravel() for k in range(0, width, 8)]


_ONES = np.uint64(0x0101010101010101)


def _marks(x: np.ndarray) -> np.ndarray:
    """One bit for every byte that is not zero."""
    x = x | x >> np.uint64(4)
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return x & _ONES


@dataclass
class Tree:
    """A k-d tree in arrays: inner nodes split ``dim`` into counts up to ``at`` and above; leaves have ``dim`` -1.

    ``low`` and ``high`` bound the box of a node in the dimension in which its parent split; ``was_low`` and
    ``was_high`` bounded it there before. The distance of a point to a box grows by the difference.
    """

    dim: np.ndarray
    at: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    was_low: np.ndarray
    was_high: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    order: np.ndarray

    @classmethod
    def build(cls, vectors: np.ndarray, leaf: int) -> "Tree":
        """Halves the points until a node has at most ``leaf`` or only equal ones."""
        n = vectors.shape[1]
        order, far = np.arange(n), np.iinfo(np.int32).max
        nodes = [[-1, 0, 0, 0, far, 0, far, 0, n]]
        varied = np.flatnonzero(vectors.max(axis=1) > vectors.min(axis=1)) if n else np.zeros(0, np.int64)
        vectors = vectors[varied]
        boxes, queue = [np.array([np.zeros(len(varied), np.int64), np.full(len(varied), far, np.int64)])], [0]
        for node in queue:
            a, b = nodes[node][7:]
            if b - a <= leaf or not len(varied):
                continue
            own = vectors[:, order[a:b]]
            # Halve where the larger part is smallest; among these, where the counts spread most.
            middle = np.median(own, axis=1)
            below = np.stack([(own <= m[:, None]).sum(axis=1) for m in (np.floor(middle), np.floor(middle) - 1)])
            worse = np.maximum(below, b - a - below)
            k = worse.min(axis=0)
            best = int(np.lexsort((-own.var(axis=1), k))[0])
            if k[best] == b - a:
                continue
            at = int(np.floor(middle[best])) - int(worse[1, best] < worse[0, best])
            right = own[best] > at
            order[a:b] = np.concatenate([order[a:b][~right], order[a:b][right]])
            cut = b - int(right.sum())
            nodes[node][:3] = int(varied[best]), at, len(nodes)
            low, high = (int(x) for x in boxes[node][:, best])
            for lo, hi, s, e in ((low, at, a, cut), (at + 1, high, cut, b)):
                box = boxes[node].copy()
                box[:, best] = lo, hi
                queue.append(len(nodes))
                nodes.append([-1, 0, 0, lo, hi, low, high, s, e])
                boxes.append(box)
            boxes[node] = None
        columns = np.array(nodes, np.int64).T
        return cls(*columns, order)

    def reach(self, vectors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, leaf) of all leaves whose box lies within ``radius``; the points descend together."""
        points = np.arange(vectors.shape[1])
        node, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        found = []
        while len(points):
            done = self.dim[node] < 0
            found.append((points[done], node[done]))
            points, node, distance = points[~done], node[~done], distance[~done]
            if not len(points):
                break
            x = vectors[self.dim[node], points].astype(np.int64)
            away = lambda low, high: np.maximum(np.maximum(low - x, x - high), 0)
            parts = []
            for side in (0, 1):
                own = self.child[node] + side
                d = distance + away(self.low[own], self.high[own]) - away(self.was_low[own], self.was_high[own])
                near = d <= radius
                parts.append((points[near], own[near], d[near]))
            points, node, distance = (np.concatenate(p) for p in zip(*parts))
        return tuple(np.concatenate(p) for p in zip(*found)) if found else (points, node)


class Cell:
    """The words of one length that live in a cell, indexed."""

    def __init__(self, words: list[str]):
        self.words, self.length = words, len(words[0])
        self.letters = letters_of(words, self.length)
        self.tree = Tree.build(vectors_of(self.letters), LEAF_WORDS)
        self.letters = self.letters[self.tree.order]
        self.forth, self.back = lanes_of(self.letters), lanes_of(self.letters, True)

    def near(self, asking: list[str], same_cell: np.ndarray):
        """Pairs (asking, word) one edit apart, in slices; words that live here meet the later ones of the cell only."""
        length = len(asking[0])
        letters = letters_of(asking, length)
        point, leaf = self.tree.reach(vectors_of(letters), 2 if length == self.length else 1)
        forth, back = lanes_of(letters), lanes_of(letters, True)
        sizes = self.tree.stop[leaf] - self.tree.start[leaf]
        ends = np.cumsum(sizes)
        whole = int(ends[-1]) if len(ends) else 0
        for a in range(0, whole, PAIRS):
            pair = np.arange(a, min(a + PAIRS, whole))
            k = np.searchsorted(ends, pair, "right")
            i, j = point[k], self.tree.start[leaf[k]] + pair - (ends[k] - sizes[k])
            keep = self._replaced(i, j, forth) if length == self.length else self._inserted(i, j, forth, back, letters)
            i, j = i[keep], self.tree.order[j[keep]]
            own = same_cell[i]
            for p, q, s in zip(i.tolist(), j.tolist(), own.tolist()):
                if not s or asking[p] < self.words[q]:
                    yield p, q

    def _replaced(self, i, j, forth) -> np.ndarray:
        """Exactly one letter differs."""
        keep, wrong = np.arange(len(i)), None
        for mine, other in zip(forth, self.forth):
            count = np.bitwise_count(_marks(mine[i[keep]] ^ other[j[keep]])) + (0 if wrong is None else wrong)
            fine = count <= 1
            keep, wrong = keep[fine], count[fine]
        return keep[wrong == 1]

    def _inserted(self, i, j, forth, back, letters) -> np.ndarray:
        """The asking word is the other one without one letter: the beginnings and ends they share cover it."""
        shared = []
        for mine, other in ((forth, self.forth), (back, self.back)):
            z = _marks(mine[0][i] ^ other[0][j])
            # Bits below the lowest mark, eight for every equal letter; 8 means that the first lane tells no end.
            shared.append(np.bitwise_count((z & (~z + np.uint64(1))) - np.uint64(1)) >> 3)
        length = letters.shape[1]
        open_ = (shared[0] == 8) | (shared[1] == 8)
        keep = np.flatnonzero(open_ | (shared[0].astype(np.int64) + shared[1] >= length))
        mine, other = letters[i[keep]], self.letters[j[keep]]
        begin, end = mine == other[:, :-1], (mine == other[:, 1:])[:, ::-1]
        run = lambda same: np.where(same.all(axis=1), length, np.argmin(same, axis=1))
        return keep[run(begin) + run(end) >= length]


# --- cells on Spark ----------------------------------------------------------------------------------------------------


def upper_trees(vocabulary: DataFrame, cell_words: int = CELL_WORDS) -> dict[int, tuple[Tree, int]]:
    """For every length the upper tree and the number of its first cell. Lengths of one cell need no sample."""
    length = F.length("word")
    sizes = {r.length: r.n for r in vocabulary.groupBy(length.alias("length")).agg(F.count("*").alias("n")).toLocalIterator()}
    large = {n: size for n, size in sizes.items() if size > cell_words}
    drawn: dict[int, list[str]] = {}
    if large:
        # The hash bound keeps about twice the sample of a length before its words are ranked.
        bound = F.create_map(*[F.lit(x) for n, size in large.items() for x in (n, min(1.0, 2 * SAMPLE / size))])
        hashed = vocabulary.select("word", length.alias("length"), F.xxhash64("word").alias("h"))
        order = Window.partitionBy("length").orderBy("h", "word")
        sample = (hashed.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(bound, F.col("length")) * (1 << 20))
                  .withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE)
                  .groupBy("length").agg(F.collect_list("word").alias("words")))
        drawn = {r.length: sorted(r.words) for r in sample.toLocalIterator()}
    trees, first = {}, 0
    for n in sorted(sizes):
        words = drawn.get(n, [])
        points = vectors_of(letters_of(words, n)) if words else np.zeros((DIMENSIONS, 0), np.int32)
        tree = Tree.build(points, max(1, cell_words * len(words) // sizes[n]))
        trees[n] = tree, first
        first += len(tree.dim)
    return trees


ROUTED = "cell int, role int, length int, word string, n bigint"


def _routes(trees: dict[int, tuple[Tree, int]]):
    """Words to the cells they live in (role 0) or ask in (1: same length, 2: one longer)."""
    def run(batches):
        for batch in batches:
            words = np.array(batch.column("word").to_pylist(), object)
            counts = batch.column("n").to_numpy(zero_copy_only=False)
            lengths = np.array([len(w) for w in words])
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                vectors = vectors_of(letters_of(list(words[own]), int(length)))
                out = []
                tree, first = trees[int(length)]
                p, home = tree.reach(vectors, 0)
                lives = np.empty(len(own), np.int64)
                lives[p] = home
                out.append((p, first + home, np.zeros(len(p), np.int64)))
                p, asked = tree.reach(vectors, 2)
                later = asked >= lives[p]
                out.append((p[later], first + asked[later], np.ones(int(later.sum()), np.int64)))
                if int(length) + 1 in trees:
                    tree, first = trees[int(length) + 1]
                    p, asked = tree.reach(vectors, 1)
                    out.append((p, first + asked, np.full(len(p), 2)))
                p, cell, role = (np.concatenate(x) for x in zip(*out))
                for a in range(0, len(p), 1 << 16):
                    at = own[p[a:a + (1 << 16)]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[a:a + (1 << 16)], pa.int32()), pa.array(role[a:a + (1 << 16)], pa.int32()),
                         pa.array(lengths[at], pa.int32()), pa.array(words[at].tolist(), pa.string()), pa.array(counts[at], pa.int64())],
                        ["cell", "role", "length", "word", "n"])
    return run


NEAR = "word string, n bigint, other string, other_n bigint"


def _search(batches):
    """Rows sorted by cell, role: a cell's words come first and are indexed, then those that ask stream past."""
    number = cell = index = None
    living: list[str] = []
    counts: dict[str, int] = {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("cell", "role", "length", "word", "n")]
        asking: list[tuple[int, int, str, int]] = []
        out: list[tuple[str, int, str, int]] = []

        def answer():
            for a in range(0, len(asking), ASKED):
                part = asking[a:a + ASKED]
                words, ns, home = [w for _, w, _ in part], [n for _, _, n in part], [w in counts for _, w, _ in part]
                for p, q in index.near(words, np.array(home)):
                    other = index.words[q]
                    out.append((words[p], ns[p], other, counts[other]))
                    out.append((other, counts[other], words[p], ns[p]))
            asking.clear()

        for number, role, length, word, n in zip(*columns):
            if number != cell:
                answer()
                cell, index, living, counts = number, None, [], {}
            if role == 0:
                living.append(word)
                counts[word] = n
                continue
            if index is None and living:
                index = Cell(living)
            if index is None:
                continue
            if asking and asking[0][0] != length:
                answer()
            asking.append((length, word, n))
        answer()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64()] * 2)],
                                             ["word", "n", "other", "other_n"])


def near_words(vocabulary: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """``(word, n, other, other_n)`` of all words of ``vocabulary(word, n)`` one edit apart, both ways round."""
    trees = upper_trees(vocabulary, cell_words)
    routed = vocabulary.select("word", "n").mapInArrow(_routes(trees), ROUTED)
    return routed.repartition("cell").sortWithinPartitions("cell", "role", "length").mapInArrow(_search, NEAR)


def _roots(forms: DataFrame, largest: int) -> DataFrame:
    """``(word, root)`` of the words that have a form: every step at least doubles the count, every round the steps."""
    steps = max(1, int(np.log2(max(largest, 2))))
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(int(np.ceil(np.log2(steps))) + 1):
        onward = at.select(F.col("word").alias("via"), F.col("root").alias("further"))
        at = settled(at.join(onward, at["root"] == onward["via"], "left").select("word", F.coalesce("further", "root").alias("root")))
    return at


def variants(documents: DataFrame, cell_words: int = CELL_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``documents(doc_id, text)``."""
    vocabulary = settled(word_counts(documents))
    largest = vocabulary.agg(F.max("n")).first()[0] or 0
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_words(vocabulary, cell_words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    leads = -F.col("best.less") >= 2 * F.col("n")
    judged = settled(joined.select("word", F.when(leads, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                   F.when(leads, -F.col("best.less")).alias("form_n")))
    roots = _roots(judged.where("form IS NOT NULL"), largest)
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
