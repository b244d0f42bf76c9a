"""Near duplicates by one-permutation hashing with optimal densification and star-shaped candidates.

A document's set holds its distinct 4-word shingles (words lower-cased in A-Z only); a text of fewer words
is one shingle, a null or wordless text has the empty set and links with nothing. Documents of equal sets
form one class, represented by its smallest id. One hash of every shingle fills ``BINS`` bins with the bin's
minimum; an empty bin borrows from the first filled bin of a fixed random order of its own. Bands of ``ROWS``
bins name buckets. Instead of pairs, a bucket yields stars: every member is paired with a few centres of the
bucket - the member whose buckets are largest overall (the text the others were copied from), the one whose
buckets are smallest, and a random one - so candidates stay below centres times members for any bucket size.
Candidates are confirmed on full sets, links are closed into components.

Stars alone could part two similar members of a bucket whose centres resemble neither. So the members of every bucket
whose documents are not all linked with one hub are searched exactly, by their rarest shingles: two similar sets, each sorted by
one common order, share a shingle within the first ninth of the smaller and the first fifth of the larger one. The
order puts shingles first that fall into rarely used slots of a histogram of fixed size, so texts drawn from one
source meet only where they share what few others have. Positions bound the intersection before a pair is formed and
pairs of one hub are left out. No pair that shares a bucket is lost, and no bucket is opened pair by pair.

Pairs of unlike texts are settled without their sets. Sizes must allow the similarity; then sketches, the number of
shingles in each bin and one byte of its minimum, bound the intersection from above. Both tests drop no similar pair.

Repeated rows fall into one class. Rows without id are never linked: their component is null and they are
kept. Of rows that share an id each is judged by its own text. Extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillsift.llm.common import WordScanner, lean, mix64, pieces, seeded64
from quillsift.operators.sizing import hinted, hot_split_join
from quillsift.operators.splits import connected
from quillsift.session import settled

SHINGLE = 4
BINS, ROWS = 125, 5
BANDS = BINS // ROWS
#: Links need 100 * intersection >= SHARE * union.
SHARE = 80
#: Slots of the histogram that orders shingles by frequency; its counts (4 bytes each) are what tasks receive.
SLOT_BITS = 20
#: Ids (with at most one more bigint each) that a join may send to every task; beyond it both sides are shuffled.
LOOKUP_IDS = 1_000_000
#: Largest count of a bin that a sketch can hold; a pair with such a bin is always compared on full sets.
FULL = 255

_EDGES = (np.arange(BINS, dtype=object) * (1 << 64) // BINS).astype(np.uint64)
_ORDER = np.array([np.argsort(seeded64(100 + i, BINS)) for i in range(BINS)])
_MULTIPLIERS = seeded64(13, ROWS)
_PLACES = seeded64(14, SHINGLE)


def shingle_sets(texts: pa.Array):
    """Yield the sorted distinct shingle hashes of every text, in order."""
    scan = WordScanner(fold=True)
    with np.errstate(over="ignore"):
        for a, b, data, offsets in pieces(texts):
            start, end, row = scan.spans(data, offsets)
            words = scan.hashes(data, start, end)
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            rolled = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
            for k in range(SHINGLE):
                rolled += words[k:len(words) - SHINGLE + 1 + k] * _PLACES[k]
            rolled = mix64(rolled)
            for i in range(b - a):
                lo, hi = bounds[i], bounds[i + 1]
                if hi - lo >= SHINGLE:
                    yield np.unique(rolled[lo:hi - SHINGLE + 1])
                elif hi > lo:
                    short = (words[lo:hi] * _PLACES[:hi - lo]).sum(dtype=np.uint64)
                    yield mix64(np.array([short + np.uint64(hi - lo)], np.uint64))
                else:
                    yield words[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of every bin; empty bins borrow from the first filled bin of their own random order."""
    at = np.searchsorted(shingles, _EDGES)
    found = shingles[np.minimum(at, len(shingles) - 1)]
    limit = np.append(at[1:], len(shingles))
    filled = at < limit
    if filled.all():
        return found
    source = _ORDER[np.arange(BINS), filled[_ORDER].argmax(1)]
    return np.where(filled, found, found[source])


def buckets(sign: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rolled = (sign.reshape(BANDS, ROWS) * _MULTIPLIERS).sum(1, dtype=np.uint64)
        return mix64(rolled + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch(shingles: np.ndarray) -> bytes:
    """Shingles per bin (one byte each), then the last byte of every bin's minimum (0 where it is empty)."""
    at = np.searchsorted(shingles, _EDGES)
    size = np.diff(np.append(at, len(shingles)))
    low = np.where(size > 0, shingles[np.minimum(at, len(shingles) - 1)].astype(np.uint8), 0)
    return np.minimum(size, FULL).astype(np.uint8).tobytes() + low.astype(np.uint8).tobytes()


def possible(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairs of sketches (rows of bytes) that may reach the threshold; False is certain.

    Two sets share at most the smaller count of a bin, and one less where the counts are equal but the minima differ.
    """
    a, b = left[:, :BINS].astype(np.int64), right[:, :BINS].astype(np.int64)
    differ = (a == b) & (left[:, BINS:] != right[:, BINS:])
    common = (np.minimum(a, b) - differ).sum(1)
    full = ((a == FULL) | (b == FULL)).any(1)
    return full | (100 * common >= SHARE * (a.sum(1) + b.sum(1) - common))


def _sieve(batches):
    rows = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * BINS)
    for batch in batches:
        keep = possible(rows(batch.column("u_sketch")), rows(batch.column("v_sketch")))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _sign(batches):
    for batch in batches:
        n, low, high, bands, sketches = [], [], [], [], []
        with np.errstate(over="ignore"):
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                low.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                high.append(int(mix64(s + np.uint64(77)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                bands.append(buckets(signature(s)) if len(s) else None)
                sketches.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"])


def _sets(batches):
    for batch in batches:
        sets, given = list(shingle_sets(batch.column("text"))), [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in given), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([s.tobytes() for s in sets], pa.binary())], [*given, "n", "shingles"])


def _slots(batches):
    for batch in batches:
        every = np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("shingles")] or [np.zeros(0, np.uint64)])
        slot, c = np.unique((every >> np.uint64(64 - SLOT_BITS)).astype(np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(c, pa.int64())], ["slot", "c"])


def prefix(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that may be the first one shared with a similar set, and their places in the order of rarity."""
    n = len(shingles)
    use = counts[(shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
    at = np.lexsort((shingles, use))[:n - (-(-SHARE * n // 100)) + 1]
    place = np.flatnonzero(use[at] > 1)
    return shingles[at[place]], place


def _prefixes(counts: np.ndarray):
    def run(batches):
        for batch in batches:
            found = [prefix(np.frombuffer(s.as_buffer(), np.uint64), counts) for s in batch.column("shingles")]
            row = np.repeat(np.arange(len(found)), [len(p) for _, p in found])
            flat = lambda k, kind: np.concatenate([f[k] for f in found] or [np.zeros(0, kind)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat(0, np.uint64).view(np.int64)), pa.array(flat(1, np.int64).astype(np.int32), pa.int32()),
                 *(batch.column(c).take(pa.array(row)) for c in ("doc", "n", "root"))], ["shingle", "place", "doc", "n", "root"])
    return run


def _confirm(batches):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("left_set"), batch.column("right_set")):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            if 100 * min(len(x), len(y)) < SHARE * max(len(x), len(y)):
                keep.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= SHARE * (len(both) - common))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def stars(members: DataFrame) -> DataFrame:
    """Distinct candidates ``(u, v)`` from ``(doc, n, bucket, c)``; a bucket of c members yields below 3 c."""
    popular = members.groupBy("doc").agg(F.sum("c").alias("weight"))
    ranked = settled(members.select("doc", "n", "bucket").join(popular, "doc"))
    central, random = F.struct("weight", -F.col("doc")), F.struct(F.xxhash64("doc", "bucket"), "doc")
    row = F.struct(F.col("doc").alias("centre"), F.col("n").alias("centre_n"))
    centres = ranked.groupBy("bucket").agg(F.array_distinct(F.array(
        F.max_by(row, central), F.min_by(row, central), F.min_by(row, random))).alias("centres"))
    pairs = ranked.select("doc", "n", "bucket").join(centres, "bucket").select("doc", "n", F.inline("centres"))
    sizes = 100 * F.least("n", "centre_n") >= SHARE * F.greatest("n", "centre_n")
    return pairs.where("centre <> doc").where(sizes).select(
        F.least("centre", "doc").alias("u"), F.greatest("centre", "doc").alias("v")).distinct()


def sets_of(named: DataFrame, texts: DataFrame) -> DataFrame:
    """``named`` (doc and other bigint columns) with ``n`` and ``shingles``, the full set of the text.

    The texts stay where they are read while the named ids are few enough to be sent to every task.
    """
    named = settled(named)
    side = hinted(named, named.count(), LOOKUP_IDS)
    rows = texts.withColumnRenamed("doc_id", "doc").join(side, "doc").select(*named.columns, "text")
    kinds = ", ".join(f"{c} bigint" for c in (*named.columns, "n"))
    return settled(rows.mapInArrow(lean(_sets), f"{kinds}, shingles binary"))


def by_rarity(sets: DataFrame) -> DataFrame:
    """Distinct candidates ``(u, v)`` of different roots among ``(doc, root, n, shingles)``; none that is similar is missed."""
    shared = sets.select("shingles").mapInArrow(lean(_slots), "slot int, c bigint").groupBy("slot").agg(
        F.sum("c").alias("c")).where("c > 1").toArrow()
    counts = np.ones(1 << SLOT_BITS, np.uint32)
    counts[shared.column("slot").to_numpy()] = np.minimum(shared.column("c").to_numpy(), (1 << 32) - 1)
    sets = sets.select("doc", "root", "n", "shingles")
    heads = settled(sets.mapInArrow(lean(_prefixes(counts)), "shingle bigint, place int, doc bigint, n bigint, root bigint"))
    mixed = heads.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    heads = heads.join(mixed.select("shingle"), "shingle", "left_semi")
    need = F.ceil(2 * SHARE * F.col("n") / (100 + SHARE))
    small = heads.where(F.col("place") <= F.col("n") - need).select("shingle", *(F.col(c).alias(f"s_{c}") for c in ("place", "doc", "n", "root")))
    rest = F.least(F.col("n") - F.col("place"), F.col("s_n") - F.col("s_place"))
    pairs = small.join(heads, "shingle").where("s_root <> root").where(
        F.struct("s_n", "s_doc") < F.struct("n", "doc")).where(
        100 * F.col("s_n") >= SHARE * F.col("n")).where(
        (100 + SHARE) * rest >= SHARE * (F.col("n") + F.col("s_n")))
    return pairs.select(F.least("s_doc", "doc").alias("u"), F.greatest("s_doc", "doc").alias("v")).distinct()


def sieved(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The candidates ``(u, v)`` whose sketches allow the similarity; documents in very many pairs are joined apart."""
    total, both = pairs.count(), pairs
    for on in ("u", "v"):
        weights = pairs.groupBy(on).agg(F.count("*").alias("_n"))
        side = classes.select(F.col("doc").alias(on), F.col("sketch").alias(f"{on}_sketch")).join(weights, on)
        both = hot_split_join(both, side, on, "_n", total).drop("_n")
    return settled(both.select("u", "v", "u_sketch", "v_sketch").mapInArrow(lean(_sieve), "u bigint, v bigint"))


def hubs(links: DataFrame) -> DataFrame:
    """``(node, root)``: of a document and the ones linked with it, the one with most links.

    Documents of one hub are connected; connected documents may have several hubs.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = settled(both.groupBy("u").agg(F.count("*").alias("n")))
    seen = hot_split_join(both, degree, "u", "n", 2 * links.count()).select("v", "u", "n").unionByName(
        degree.select(F.col("u").alias("v"), "u", "n"))
    return seen.groupBy(F.col("v").alias("node")).agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("root"))


def _named(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("doc")).distinct()


def confirmed(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates ``(u, v)`` whose full sets are similar."""
    loaded = likely.join(sets.select(F.col("doc").alias("v"), F.col("shingles").alias("left_set")), "v").join(
        sets.select(F.col("doc").alias("u"), F.col("shingles").alias("right_set")), "u")
    return settled(loaded.select("u", "v", "left_set", "right_set").mapInArrow(lean(_confirm), "u bigint, v bigint"))


def linked(members: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``(node, root)`` of all classes linked with others, from ``(doc, n, bucket)``."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = settled(members.join(sizes, "bucket"))
    likely = sieved(settled(stars(members)), classes)
    links = confirmed(likely, sets_of(_named(likely), texts))
    roots = hubs(links)
    placed = members.select("doc", "bucket").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "root", F.coalesce("root", "doc"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    apart = placed.join(split.select("bucket"), "bucket", "left_semi").select("doc", "root").distinct()
    sets = sets_of(apart, texts)
    likely = settled(by_rarity(sets))
    named = _named(likely)
    more = confirmed(likely, sets.join(hinted(named, 2 * likely.count(), LOOKUP_IDS), "doc", "left_semi"))
    return connected(links.unionByName(more))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``documents(doc_id, text)``."""
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = settled(texts.mapInArrow(
        lean(_sign), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"))
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = settled(classes)
    roots = linked(classes.select("doc", "n", F.explode("bands").alias("bucket")), texts, classes)
    found = classes.select("d1", "d2", "doc", "copies").join(roots.withColumnRenamed("node", "doc"), "doc", "left").where(
        "copies > 1 or root is not null").select("d1", "d2", F.coalesce("root", "doc").alias("root"))
    out = signed.select("doc_id", "n_shingles", "d1", "d2").join(found, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce(F.col("root"), F.col("doc_id"))).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_groups(documents: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, all columns kept; rows without id stay."""
    kept = near_duplicates(documents).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = documents.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.select(*documents.columns).unionByName(documents.where("doc_id is null"))
