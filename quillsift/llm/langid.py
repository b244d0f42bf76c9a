"""Language by the nearest of several centroids per language over normalised TF-IDF n-gram vectors.

Letters are lower-cased, every other ASCII character is a blank; byte 2-, 3- and 4-grams inside that stream
are hashed to ``DIMENSIONS`` counts. A vector is log-damped counts times inverse document frequency, scaled to
length one. The training rows of each language are clustered into at most ``CENTROIDS`` groups by spherical
k-means; a text takes the language of the centroid with the largest cosine.

Distance-based rejection: every language keeps, per length band, the cosine that its labelled rows fall below only
in ``REJECT_SHARE`` of cases, less ``REJECT_SLACK`` or less its half, whichever leaves more. A text below the limit
of its nearest centroid is ``rejected``; so is a text that is null or has no letter, whose language is ``und`` with
score 0. Where a language has fewer than ``ENOUGH`` rows of a band, passages of that length from the middle of its
longer rows join them, then those of all languages; a band that even these do not fill takes the limit of the next
shorter band that is filled. Only with fewer than ``ENOUGH`` labelled rows in all is there no distance to go by.

The centroids come from a bounded number of rows of each language (``SAMPLE_PER_LANGUAGE``, ``SAMPLE_ROWS``), chosen
by a hash of the id, and their whole texts; a repeated row counts once there. Corpus frequencies and limits come from all labelled rows that are not
held out, in two passes that hand only counts to the driver. Prediction reads whole texts. Ties go to the first
language in order. Without any labelled row every text is ``und``.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F

from quillsift.llm.common import held_out, lean, released
from quillsift.operators.sizing import hinted
from quillsift.session import settled

DIMENSIONS = 4096
CENTROIDS = 4
ROUNDS = 12
#: Rows for centroids: at most so many of a language, and of all languages together (20 of each at least).
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 500, 4000
REJECT_SHARE, REJECT_SLACK = 0.002, 0.25
#: Upper limits of the length bands (n-grams of a text) that have a rejection limit of their own.
BANDS = (64, 256, 1024, 4096)
#: Rows that show the tail of a band, and the slots of a cosine's histogram.
ENOUGH, SLOTS = 50, 1000
ROWS = 256
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of one text; all zero if it has no letter."""
    if not _LETTER.search(text):
        return np.zeros(DIMENSIONS, np.float32)
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(DIMENSIONS, np.int64)
    gram = b[:-1] | b[1:] << np.uint32(8)
    for width in (2, 3, 4):
        if width > 2:
            if len(b) < width:
                break
            gram = gram[:-1] | b[width - 1:] << np.uint32(8 * (width - 1))
        place = ((gram + np.uint32(width)) * np.uint32(2654435761)) >> np.uint32(20)
        out += np.bincount(place, minlength=DIMENSIONS)
    return out.astype(np.float32)


class Centroids:
    """Clustered centroids with rejection limits; ``predict`` works on columns of texts."""

    def __init__(self, idf=None, vectors=None, owner=None, languages=(), limits=None):
        self.idf, self.vectors, self.owner, self.languages, self.limits = idf, vectors, owner, list(languages), limits

    def vectors_of(self, counted: np.ndarray) -> np.ndarray:
        x = np.log1p(counted) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: pa.Array):
        """Language, cosine as score and rejection of every text."""
        texts = pc.fill_null(texts, "")
        names, scores, rejected = [], [], []
        for k in range(0, len(texts), ROWS):
            counted = np.array([counts(t) for t in texts.slice(k, ROWS).to_pylist()], np.float32).reshape(-1, DIMENSIONS)
            total = counted.sum(1)
            if self.vectors is None:
                names += [UNKNOWN] * len(counted)
                scores += [0.0] * len(counted)
                rejected += [True] * len(counted)
                continue
            cosine = self.vectors_of(counted) @ self.vectors.T
            best = cosine.argmax(1)
            score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
            far = score < self.limits[best, np.searchsorted(BANDS, total)]
            empty = total == 0
            names += [UNKNOWN if e else self.languages[self.owner[i]] for i, e in zip(best, empty)]
            scores += np.where(empty, 0, score).astype(float).tolist()
            rejected += (far | empty).tolist()
        return names, scores, rejected


def passages(text: str, size: float) -> list[tuple[int, np.ndarray]]:
    """Band and counts of one passage per band below that of a text of ``size`` n-grams, from its middle."""
    out = []
    for band in range(int(np.searchsorted(BANDS, size))):
        # A letter has about three n-grams; half the upper limit is well inside every band.
        length = BANDS[band] // 6
        first = max(len(text) - length, 0) // 2
        counted = counts(text[first:first + length])
        if counted.any() and int(np.searchsorted(BANDS, counted.sum())) == band:
            out.append((band, counted))
    return out


def distances(model: Centroids, texts: list[str]) -> Counter:
    """How many rows (kind 0) and passages of longer rows (kind 1) by language, band and slot of the cosine."""
    found = Counter()
    for k in range(0, len(texts), ROWS):
        kinds, bands, rows = [], [], []
        for text in texts[k:k + ROWS]:
            counted = counts(text)
            size = counted.sum()
            if size:
                own = [(int(np.searchsorted(BANDS, size)), counted)] + passages(text, size)
                kinds += [0] + [1] * (len(own) - 1)
                bands += [b for b, _ in own]
                rows += [c for _, c in own]
        if rows:
            cosine = model.vectors_of(np.array(rows)) @ model.vectors.T
            slot = np.clip(cosine.max(1) * SLOTS, 0, SLOTS - 1).astype(int)
            found.update(zip(model.owner[cosine.argmax(1)].tolist(), bands, kinds, slot.tolist()))
    return found


def limits(model: Centroids, found: Counter) -> np.ndarray:
    """Rejection limits of every centroid and band from the histogram of ``distances``."""
    n = np.zeros((len(model.languages), len(BANDS) + 1, 2, SLOTS), np.int64)
    for at, times in found.items():
        n[at] += times
    out = np.zeros(n.shape[:2])
    for language in range(len(n)):
        for band in range(len(BANDS) + 1):
            # A longer text is nearer to its centroid, so the limit of a shorter band rejects too little, not too much.
            for b in range(band, -1, -1):
                tail = next((h for h in (n[language, b, 0], n[language, b].sum(0), n[:, b].sum((0, 1))) if h.sum() >= ENOUGH), None)
                if tail is not None:
                    low = np.searchsorted(np.cumsum(tail), REJECT_SHARE * (tail.sum() - 1), "right") / SLOTS
                    out[language, band] = max(low - REJECT_SLACK, low / 2)
                    break
    return out[model.owner]


def frequencies(texts: list[str]) -> np.ndarray:
    """Texts with every n-gram slot, and last the number of texts with a letter."""
    out = np.zeros(DIMENSIONS + 1, np.int64)
    for text in texts:
        counted = counts(text) > 0
        out[:-1] += counted
        out[-1] += counted.any()
    return out


def fit(texts: list[str], languages: list[str], corpus: np.ndarray | None = None) -> Centroids:
    """Centroids of these rows, with limits from them; ``corpus`` holds the ``frequencies`` of a larger collection, which
    then has to give the limits as well."""
    # One matrix of the sample, turned into unit vectors where it lies.
    x, n = np.zeros((len(texts), DIMENSIONS), np.float32), 0
    labels = []
    for text, language in zip(texts, languages):
        x[n] = counts(text)
        if x[n].any():
            labels.append(language)
            n += 1
    x, labels = x[:n], np.array(labels, object)
    if not n:
        return Centroids()
    alone = corpus is None
    if alone:
        corpus = frequencies(texts)
    model = Centroids(np.log((1 + corpus[-1]) / (1 + corpus[:-1])).astype(np.float32) + 1, languages=sorted(set(labels)))
    for k in range(0, n, ROWS):
        x[k:k + ROWS] = model.vectors_of(x[k:k + ROWS])
    centres, owner = [], []
    for k, name in enumerate(model.languages):
        own = x[labels == name]
        # Start from rows spread over the order of the distance to the mean, so that runs agree.
        order = np.argsort(own @ own.mean(0), kind="stable")
        start = own[order[np.unique(np.linspace(0, len(own) - 1, min(CENTROIDS, len(own))).astype(int))]]
        for _ in range(ROUNDS):
            near = (own @ start.T).argmax(1)
            start = np.array([own[near == c].mean(0) if (near == c).any() else start[c] for c in range(len(start))])
            start /= np.maximum(np.linalg.norm(start, axis=1, keepdims=True), 1e-9)
        centres.append(start)
        owner += [k] * len(start)
    model.vectors, model.owner = np.concatenate(centres).astype(np.float32), np.array(owner)
    if alone:
        model.limits = limits(model, distances(model, texts))
    return model


def corpus_frequencies(known: DataFrame) -> np.ndarray:
    """``frequencies`` of all rows, added up on Spark."""
    def count(batches):
        out = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            out += frequencies(batch.column("text").to_pylist())
        place = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(out[place])], ["place", "n"])

    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in known.select("text").mapInArrow(lean(count), "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r.place] = r.n
    return out


def corpus_distances(known: DataFrame, model: Centroids) -> Counter:
    """``distances`` of all rows, added up on Spark."""
    shared = known.sparkSession.sparkContext.broadcast(model)
    names = ["language", "band", "kind", "slot"]

    def count(batches):
        found = Counter()
        for batch in batches:
            found.update(distances(shared.value, batch.column("text").to_pylist()))
        columns = list(zip(*found)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(found.values(), pa.int64())], [*names, "n"])

    rows = known.select("text").mapInArrow(lean(count), "language int, band int, kind int, slot int, n bigint")
    return Counter({tuple(r)[:4]: r.n for r in rows.groupBy(*names).agg(F.sum("n").alias("n")).collect()})


def train(documents: DataFrame) -> Centroids:
    """Centroids from a bounded sample of the rows that have a language and are not held out, frequencies and limits from all of them."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    most = known.select("lang").distinct().count()
    most = max(20, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // max(most, 1)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    ids = settled(ids.select("doc_id", "lang").distinct())
    rows = known.select("doc_id", "lang", "text").join(hinted(ids, ids.count()), ["doc_id", "lang"])
    # An id counts once, however often its row is repeated.
    sample = rows.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").toArrow()
    model = fit(sample.column("text").to_pylist(), sample.column("lang").to_pylist(), corpus_frequencies(known))
    del sample
    if model.vectors is not None:
        model.limits = limits(model, corpus_distances(known, model))
    released()
    return model


def predict(documents: DataFrame, model: Centroids) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        for batch in batches:
            names, scores, rejected = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"])

    found = documents.select("doc_id", "text").mapInArrow(lean(label), "doc_id bigint, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def identified(documents: DataFrame, model: Centroids) -> DataFrame:
    """The rows of ``documents`` whose text is not rejected, all columns kept."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([not r for r in shared.value.predict(batch.column("text"))[2]], pa.bool_()))

    return documents.mapInArrow(lean(keep), documents.schema)
