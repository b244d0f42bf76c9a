"""Toxicity scores by a small bidirectional gated recurrent network with attention pooling, in numpy.

Words are runs of characters other than white space and ASCII punctuation, lower-cased. The input of a step
is the word's own vector (frequent words of the training sample) beside the mean of the vectors of its
hashed byte trigrams, word borders included. A document is read as overlapping windows of ``WINDOW`` words,
the last one aligned to the end; its score is that of its most toxic window. Training takes the window that
the model finds most toxic as the document's example (multiple instance learning): first updates see random windows,
then ``ROUNDS`` times all windows of every sampled document are scored anew and the most toxic one is its example.

The training sample is bounded: ``SAMPLE_DOCS`` labelled documents of each class chosen by a hash of their id, with
their whole texts. These stay on Spark; the driver holds a few windows of each. The number of updates is fixed.
A null or wordless text scores as an empty window. Without labelled rows of both classes every score is the
share of toxic labels, 0 without labels. Rows without id are scored and not held out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillsift.llm.common import WordScanner, held_out, lean, mix64, pieces, released
from quillsift.session import settled

WINDOW, STRIDE = 48, 24
HIDDEN, ATTENTION = 8, 6
VOCABULARY, TRIGRAMS = 2048, 8192
WORD_DIM, CHAR_DIM = 8, 12
SAMPLE_DOCS = 1500
#: Random windows of a document for the first ``WARM`` updates, and choices of its most toxic window after them.
DRAWN, WARM, ROUNDS = 4, 36, 6
UPDATES, BATCH, RATE, DECAY = 220, 128, 0.012, 0.04
#: Words whose input a worker keeps; beyond it the store starts anew.
STORED_WORDS = 150_000
#: Windows scored at once.
WINDOWS = 512

_SCAN = WordScanner(punctuation=True)


def _gate(x):
    """Piecewise linear sigmoid of the recurrent gates; works in place."""
    x *= np.float32(0.2)
    x += np.float32(0.5)
    return np.clip(x, 0, 1, out=x)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``first[i] .. first[i] + size[i] - 1``."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def _scatter(target: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """``target[index] += rows`` with repeated indices."""
    order = np.argsort(index, kind="stable")
    if len(order):
        index = index[order]
        cuts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        target[index[cuts]] += np.add.reduceat(rows[order], cuts, axis=0)


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Word starts, ends, hashes and the bounds of every row among the words."""
    start, end, row = _SCAN.spans(data, offsets)
    return start, end, _SCAN.hashes(data, start, end), np.searchsorted(row, np.arange(len(offsets)))


def trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Hashed byte trigrams of ``<word>`` for every span, flat, and the first position of every word."""
    size = end - start + 2
    first = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(first[-1] + 2, 1, np.uint32)
    inner = np.repeat(start - first[:-1] - 1, size) + np.arange(first[-1])
    edge = np.zeros(first[-1], bool)
    edge[first[:-1]] = edge[first[1:] - 1] = True
    flat[:first[-1]][~edge] = data[inner[~edge]]
    flat[first[1:] - 1] = 2
    code = flat[:-2] | flat[1:-1] << np.uint32(8) | flat[2:] << np.uint32(16)
    valid = np.ones(first[-1], bool)
    valid[first[1:] - 1] = valid[first[1:] - 2] = False
    hashed = (code * np.uint32(2654435761)) >> np.uint32(19)
    return hashed[valid].astype(np.int64), np.concatenate([[0], np.cumsum(size - 2)])


def window_starts(n: int) -> list[int]:
    """First words of the overlapping windows of a text of ``n`` words."""
    return [*range(0, max(n - WINDOW, 0), STRIDE), max(n - WINDOW, 0)]


class Network:
    """Parameters, scoring and gradients. Both directions are stacked on the first axis."""

    def __init__(self, vocabulary: list[int], seed: int = 7):
        draw = np.random.default_rng(seed)
        size = lambda *shape, scale=1.0: (draw.standard_normal(shape) * scale).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.known = {h: i + 1 for i, h in enumerate(vocabulary)}
        self.p = {
            "word": size(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": size(TRIGRAMS, CHAR_DIM, scale=0.3),
            "wx": size(2, d, 3 * HIDDEN, scale=d ** -0.5), "bx": np.zeros((2, 3 * HIDDEN), np.float32),
            "u": size(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN ** -0.5),
            "wa": size(2 * HIDDEN, ATTENTION, scale=0.3), "va": size(ATTENTION, scale=0.3),
            "wo": size(2 * HIDDEN, scale=0.3), "bo": np.zeros(1, np.float32)}
        self.p["word"][0] = 0

    def inputs(self, ids: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Input vectors of words given their vocabulary ids and trigrams."""
        sums = np.add.reduceat(self.p["char"][grams], first[:-1], axis=0) if len(ids) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][ids], sums / np.diff(first)[:, None]], 1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions, shape (2, words, 3 * HIDDEN)."""
        return np.matmul(x[None], self.p["wx"]) + self.p["bx"][:, None]

    def run(self, gates: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows; ``index`` (windows, steps) points into ``gates``, ``mask`` marks real words."""
        n, steps = index.shape
        u, h, cut = self.p["u"], np.zeros((2, n, HIDDEN), np.float32), 2 * HIDDEN
        flat, shift = gates.reshape(-1, 3 * HIDDEN), gates.shape[1]
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        both = np.concatenate([index.T[:, None], index.T[::-1, None] + shift], 1)
        real = None if mask is None else np.stack([mask.T, mask.T[::-1]], 1)[..., None]
        saved = []
        for t in range(steps):
            x = flat[both[t]]
            hu = np.matmul(h, u)
            zr = _gate(x[..., :cut] + hu[..., :cut])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = r * hu[..., cut:]
            c += x[..., cut:]
            np.tanh(c, out=c)
            new = h - c
            new *= z
            new += c
            m = None
            if real is not None:
                m = real[t]
                new = np.where(m, new, h)
            if keep:
                saved.append((h, hu, z, r, c, m))
            h = new
            states[t, :, :HIDDEN] = h[0]
            states[steps - 1 - t, :, HIDDEN:] = h[1]
        tense = np.tanh(states @ self.p["wa"])
        energy = tense @ self.p["va"]
        if mask is not None:
            energy = np.where(mask.T, energy, np.float32(-30))
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, states, tense, weight, pooled, saved) if keep else logit

    def gradients(self, x, index, mask, target):
        """Gradients of the mean logistic loss with respect to all parameters and the inputs ``x``."""
        gates = self.project(x)
        logit, states, tense, weight, pooled, saved = self.run(gates, index, mask, keep=True)
        n, steps = index.shape
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "char")}
        d_logit = (_sigmoid(logit) - target) / n
        g["bo"][0], g["wo"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * self.p["wo"]
        d_states = weight[..., None] * d_pooled[None]
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(0))
        g["va"] = np.einsum("tb,tba->a", d_energy, tense)
        d_tense = d_energy[..., None] * self.p["va"] * (1 - tense ** 2)
        g["wa"] = np.einsum("tbh,tba->ha", states, d_tense)
        d_states = d_states + d_tense @ self.p["wa"].T
        d_gates, u = np.zeros_like(gates), self.p["u"]
        steps_dx = np.empty((steps, 2, n, 3 * HIDDEN), np.float32)
        dh = np.zeros((2, n, HIDDEN), np.float32)
        for t in reversed(range(steps)):
            h, hu, z, r, c, m = saved[t]
            dh = dh + np.stack([d_states[t, :, :HIDDEN], d_states[steps - 1 - t, :, HIDDEN:]])
            d_new, d_skip = (dh, 0) if m is None else (np.where(m, dh, 0), np.where(m, 0, dh))
            dc = d_new * (1 - z) * (1 - c ** 2)
            dz = d_new * (h - c) * np.float32(0.2) * ((z > 0) & (z < 1))
            dr = dc * hu[..., 2 * HIDDEN:] * np.float32(0.2) * ((r > 0) & (r < 1))
            steps_dx[t] = np.concatenate([dz, dr, dc], -1)
            du = np.concatenate([dz, dr, dc * r], -1)
            g["u"] += np.matmul(h.transpose(0, 2, 1), du)
            dh = d_new * z + np.matmul(du, u.transpose(0, 2, 1)) + d_skip
        _scatter(d_gates[0], index.T.reshape(-1), steps_dx[:, 0].reshape(-1, 3 * HIDDEN))
        _scatter(d_gates[1], index.T[::-1].reshape(-1), steps_dx[:, 1].reshape(-1, 3 * HIDDEN))
        g["bx"] = d_gates.sum(1)
        g["wx"] = np.matmul(x.T[None], d_gates)
        return g, np.matmul(d_gates, self.p["wx"].transpose(0, 2, 1)).sum(0)


class Scorer:
    """Scores columns of texts with a trained network; remembers the gate inputs of words it has met."""

    def __init__(self, network: Network | None, prior: float):
        self.network, self.prior = network, prior
        # Training sees both classes equally often; the logit is moved to the share among all labels.
        self.shift = np.log(prior / (1 - prior)) if network is not None else 0.0

    def _reset(self) -> None:
        self.places: dict[int, int] = {}
        self.store = np.zeros((2, 1024, 3 * HIDDEN), np.float32)
        self.store[:, 0] = self.network.project(np.zeros((1, WORD_DIM + CHAR_DIM), np.float32))[:, 0]
        self.used = 1

    def _place(self, data, start, end, hashes) -> np.ndarray:
        """Row of the store for every word; new words are computed together."""
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if not hasattr(self, "places") or self.used + len(distinct) > STORED_WORDS:
            self._reset()
        known = np.array([self.places.get(h, 0) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(known == 0)
        if len(new):
            names = distinct[new].tolist()
            ids = np.array([self.network.known.get(h, 0) for h in names], np.int64)
            rows = self.network.project(self.network.inputs(ids, *trigrams(data, start[at[new]], end[at[new]])))
            while self.used + len(new) > self.store.shape[1]:
                self.store = np.concatenate([self.store, np.zeros_like(self.store)], 1)
            self.store[:, self.used:self.used + len(new)] = rows
            known[new] = np.arange(self.used, self.used + len(new))
            self.places.update(zip(names, known[new].tolist()))
            self.used += len(new)
        return known[back.reshape(-1)]

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        out = np.zeros(len(texts))
        for a, b, data, offsets in pieces(texts, lower=str.lower):
            start, end, hashes, bounds = words_of(data, offsets)
            place = self._place(data, start, end, hashes)
            out[a:b] = self._best(place, bounds)
        return out

    def examples(self, texts: pa.Array) -> list[list[str]]:
        """The most toxic window of every text."""
        out = []
        for _, _, data, offsets in pieces(texts, lower=str.lower):
            start, end, hashes, bounds = words_of(data, offsets)
            place, n = self._place(data, start, end, hashes), np.diff(bounds)
            first = bounds[:-1].copy()
            for i in np.flatnonzero(n > WINDOW):
                begins = np.asarray(window_starts(n[i])) + bounds[i]
                logit = [self.network.run(self.store, place[begins[k:k + WINDOWS, None] + np.arange(WINDOW)], None)
                         for k in range(0, len(begins), WINDOWS)]
                first[i] = begins[np.concatenate(logit).argmax()]
            out += [[_cut(data, start, end, f, min(c, WINDOW))] for f, c in zip(first, n)]
        return out

    def _best(self, place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Score of the most toxic window of every row."""
        n = np.diff(bounds)
        long = np.flatnonzero(n >= WINDOW)
        best = np.full(len(n), -np.inf)
        firsts = [np.asarray(window_starts(n[i])) + bounds[i] for i in long]
        if firsts:
            owner, first = np.repeat(long, [len(f) for f in firsts]), np.concatenate(firsts)
            for k in range(0, len(first), WINDOWS):
                index = place[first[k:k + WINDOWS, None] + np.arange(WINDOW)]
                np.maximum.at(best, owner[k:k + WINDOWS], self.network.run(self.store, index, None))
        short = np.flatnonzero(n < WINDOW)
        short = short[np.argsort(n[short], kind="stable")]
        for k in range(0, len(short), WINDOWS):
            rows = short[k:k + WINDOWS]
            steps = max(int(n[rows].max()), 1)
            mask = np.arange(steps) < np.maximum(n[rows], 1)[:, None]
            at = np.minimum(bounds[rows][:, None] + np.arange(steps), max(len(place) - 1, 0))
            real = np.arange(steps) < n[rows][:, None]
            index = np.where(real, place[at] if len(place) else 0, 0)
            best[rows] = self.network.run(self.store, index, mask)
        return _sigmoid(best + self.shift)


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: int, n: int) -> str:
    """Text of ``n`` words."""
    return data[start[first]:end[first + n - 1]].tobytes().decode("utf-8", "replace") if n else ""


def random_examples(texts: pa.Array) -> list[list[str]]:
    """Up to ``DRAWN`` windows of every text, drawn by a hash of its words."""
    out = []
    for _, _, data, offsets in pieces(texts, lower=str.lower):
        start, end, hashes, bounds = words_of(data, offsets)
        for a, b in zip(bounds[:-1], bounds[1:]):
            begins = window_starts(int(b - a))
            draw = np.random.default_rng(int(np.bitwise_xor.reduce(hashes[a:b])) if b > a else 0)
            chosen = draw.choice(begins, min(len(begins), DRAWN), replace=False)
            out.append([_cut(data, start, end, a + int(s), min(int(b - a), WINDOW)) for s in chosen])
    return out


def document_words(texts: pa.Array) -> Counter:
    """In how many texts every word, by its hash, stands."""
    seen = Counter()
    for _, _, data, offsets in pieces(texts, lower=str.lower):
        _, _, hashes, bounds = words_of(data, offsets)
        for a, b in zip(bounds[:-1], bounds[1:]):
            seen.update(np.unique(hashes[a:b]).tolist())
    return seen


class Sample:
    """Labelled texts in this process; ``examples`` gives windows of each by the network, random ones without it."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.texts, self.toxic = pa.array(texts, pa.large_string()), toxic

    def vocabulary(self) -> list[int]:
        seen = document_words(self.texts)
        return [h for h, c in sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:VOCABULARY] if c > 4]

    def examples(self, network: Network | None) -> list[list[str]]:
        return random_examples(self.texts) if network is None else Scorer(network, 0.5).examples(self.texts)


class SparkSample:
    """The same over ``rows(doc_id, text, toxic)``, whose texts stay on Spark."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "toxic", "text")
        keys = self.rows.select("doc_id", "digest", "toxic").collect()
        self.toxic = np.array([r.toxic for r in sorted(keys, key=lambda r: (r.doc_id, r.digest))], np.int64)

    def vocabulary(self) -> list[int]:
        def count(batches):
            seen = Counter()
            for batch in batches:
                seen.update(document_words(batch.column("text")))
            word = np.array(list(seen.keys()), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(seen.values(), pa.int64())], ["word", "n"])

        seen = self.rows.select("text").mapInArrow(lean(count), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        # Hashes are unsigned: those that are negative here come last.
        common = seen.where("n > 4").orderBy(F.desc("n"), F.col("word") < 0, "word").limit(VOCABULARY)
        return [r.word % (1 << 64) for r in common.collect()]

    def examples(self, network: Network | None) -> list[list[str]]:
        shared = self.rows.sparkSession.sparkContext.broadcast(network)

        def choose(batches):
            scorer = Scorer(shared.value, 0.5)
            for batch in batches:
                texts = batch.column("text")
                found = random_examples(texts) if scorer.network is None else scorer.examples(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("digest"), pa.array(found, pa.list_(pa.string()))], ["doc_id", "digest", "windows"])

        rows = self.rows.select("doc_id", "digest", "text").mapInArrow(lean(choose), "doc_id bigint, digest string, windows array<string>").collect()
        return [r.windows for r in sorted(rows, key=lambda r: (r.doc_id, r.digest))]


class Examples:
    """Words of the windows of every document, and the inputs of these words."""

    def __init__(self, windows: list[list[str]], network: Network):
        self.count = np.array([len(w) for w in windows])
        self.first = np.cumsum(self.count) - self.count
        parts, words, size = [], 0, 0
        for _, _, data, offsets in pieces(pa.array([w for own in windows for w in own], pa.large_string()), lower=str.lower):
            start, end, hashes, bounds = words_of(data, offsets)
            parts.append((data, start + size, end + size, hashes, bounds[:-1] + words))
            words, size = words + len(start), size + len(data)
        joined, start, end, hashes, bounds = map(np.concatenate, zip(*parts))
        self.bounds = np.append(bounds, words)
        distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        self.back = back.reshape(-1)
        self.grams, self.starts = trigrams(joined, start[at], end[at])
        self.ids = np.array([network.known.get(int(h), 0) for h in distinct.tolist()], np.int64)


def fit(texts: list[str], toxic: np.ndarray, prior: float | None = None) -> Scorer:
    """Train on lists of texts and 0/1 labels.

    ``prior`` is the share of toxic labels where the lists do not show it.
    """
    return learn(Sample(texts, toxic), float(toxic.mean()) if prior is None and len(toxic) else prior or 0.0)


def learn(sample, prior: float) -> Scorer:
    """Train on a ``Sample``; every update looks at one window of ``BATCH`` documents, half of them toxic."""
    toxic = sample.toxic
    if len(set(toxic.tolist())) < 2:
        return Scorer(None, prior)
    net = Network(sample.vocabulary())
    groups = [np.flatnonzero(toxic == k) for k in (0, 1)]
    draw = np.random.default_rng(5)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(p) for k, p in net.p.items()}
    anew = {0, *np.linspace(WARM, UPDATES, ROUNDS, endpoint=False).astype(int).tolist()}
    for step in range(UPDATES):
        if step in anew:
            ex = Examples(sample.examples(net if step else None), net)
        docs = np.concatenate([draw.choice(g, BATCH // 2) for g in groups])
        rows = ex.first[docs] + draw.integers(0, ex.count[docs])
        lengths = np.diff(ex.bounds)[rows]
        steps = max(int(lengths.max()), 1)
        word = np.zeros((len(docs), steps), np.int64)
        mask = np.zeros((len(docs), steps), bool)
        mask[:, 0] = True
        for k, (s, length) in enumerate(zip(ex.bounds[rows], lengths)):
            word[k, :length] = ex.back[s:s + length] + 1
            mask[k, :length] = True
        used, place = np.unique(word, return_inverse=True)
        place = place.reshape(word.shape)
        real = used[used > 0] - 1
        sizes = ex.starts[real + 1] - ex.starts[real]
        spread = _ragged(ex.starts[real], sizes)
        local = np.concatenate([[0], np.cumsum(sizes)])
        x = np.zeros((len(used), WORD_DIM + CHAR_DIM), np.float32)
        x[used > 0] = net.inputs(ex.ids[real], ex.grams[spread], local)
        target = toxic[docs].astype(np.float32)
        g, dx = net.gradients(x, place, mask, target)
        dx = dx[used > 0]
        g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
        _scatter(g["word"], ex.ids[real], dx[:, :WORD_DIM])
        g["word"][0] = 0
        _scatter(g["char"], ex.grams[spread], np.repeat(dx[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        rate = RATE * min(1.0, 3 * (UPDATES - step) / (2 * UPDATES))
        for k in net.p:
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.01 * (g[k] ** 2 - v[k])
            fix = np.sqrt(1 - 0.99 ** (step + 1)) / (1 - 0.9 ** (step + 1))
            net.p[k] -= (rate * (fix * m[k] / (np.sqrt(v[k]) + 1e-6) + DECAY * net.p[k])).astype(np.float32)
    return Scorer(net, prior)


def training_sample(documents: DataFrame, labels: DataFrame):
    """Rows ``(doc_id, text, toxic)`` and the share of toxic labels: at most ``SAMPLE_DOCS`` documents of each class, by a hash of the id; no held-out row."""
    marked = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for k in (0, 1):
        part = marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    share = marked.agg(F.avg("toxic").alias("share")).first().share
    return settled(rows), float(share or 0.0)


def score(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """``documents`` rows as ``(doc_id, held_out, score, predicted)``."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    def rate(batches):
        own = Scorer(shared.value.network, shared.value.prior)
        for batch in batches:
            values = own.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    scored = documents.select("doc_id", "text").mapInArrow(lean(rate), "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def train(documents: DataFrame, labels: DataFrame) -> Scorer:
    rows, share = training_sample(documents, labels)
    scorer = learn(SparkSample(rows), share)
    released()
    return scorer


def without_toxic(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of ``documents`` that score below 0.5, all columns kept."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer)

    def keep(batches):
        own = Scorer(shared.value.network, shared.value.prior)
        for batch in batches:
            yield batch.filter(pa.array(own.scores(batch.column("text")) < 0.5))

    return documents.mapInArrow(lean(keep), documents.schema)
