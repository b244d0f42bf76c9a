"""Exact dedup by counting quotient filters.

The fingerprint of a text is the leading ``bits`` bits of its SHA-256. Every task builds a counting quotient filter of
the fingerprints it reads and cuts it into pieces by ranges of fingerprints. The pieces of a range, from all tasks,
merge losslessly: quotient and remainder give the fingerprint back, remainders lie sorted, and counts of equal ones
add. A fingerprint counted once belongs to a unique text. The texts of the others are routed to verification, where
they are grouped by their bytes; rows then find the class of their own bytes.

Texts are equal when identical; a null counts as empty. Of equal texts the row with the largest doc_id stays (null
ids stay only where no row has an id). Rows that repeat id and text are one document: each of them carries the same
values, ``kept`` included, and ``deduplicated`` returns one of them. An empty table gives no rows, other columns of
the table do not matter.

Hot texts: a task holds one counter for a text however often it reads it, the grouping by bytes is partial before the
shuffle, and classes come back to the rows by a broadcast of checked size or a salted join. A range is sized by the
row count, so that its filter fits a worker.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillsift.operators.sizing import lookup_join
from quillsift.session import settled

BITS = 64
#: Rows a range of fingerprints holds on average, and fingerprints a task gathers before it writes out a filter.
RANGE_ROWS, TASK_ROWS = 1 << 21, 1 << 20
#: Share of a filter's slots that is filled at most.
LOAD = 0.75
PIECE = "part int, quotient_bits int, slots int, occupied binary, runend binary, filled binary, remainders binary, counts binary"


@dataclass
class Filter:
    """A counting quotient filter over ``bits``-bit fingerprints with ``2 ** q`` home slots.

    The quotient is the leading ``q`` bits, the remainder the rest. Remainders of one quotient form a run, sorted,
    in consecutive slots from the home slot on, or after the run before it if that reaches further. ``occupied`` has
    a bit per quotient that owns a run, ``runend`` a bit per slot that ends one, ``filled`` a bit per slot in use.
    ``remainders`` and ``counts`` list the used slots in slot order.
    """

    bits: int
    q: int
    slots: int
    occupied: np.ndarray
    runend: np.ndarray
    filled: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> "Filter":
        """From distinct fingerprints in ascending order."""
        n = len(fingerprints)
        q = min(bits, max(1, int(np.ceil(np.log2(max(n, 1) / LOAD)))))
        r = np.uint64(bits - q)
        quotient = (fingerprints >> r if bits > q else fingerprints).astype(np.int64)
        remainder = fingerprints & ((np.uint64(1) << r) - np.uint64(1))
        homes, first, lengths = np.unique(quotient, return_index=True, return_counts=True)
        # A run starts at its home or behind the run before: subtracting what lies before turns that into a running maximum.
        begin = np.maximum.accumulate(homes - first) + first if n else homes
        ends = begin + lengths - 1
        slots = max(1 << q, int(ends[-1]) + 1) if n else 1 << q
        occupied, runend, filled = np.zeros(1 << q, bool), np.zeros(slots, bool), np.zeros(slots, bool)
        occupied[homes], runend[ends] = True, True
        filled[np.repeat(begin - first, lengths) + np.arange(n)] = True
        return cls(bits, q, slots, occupied, runend, filled, remainder, counts.astype(np.int64))

    def fingerprints(self) -> np.ndarray:
        """All fingerprints in ascending order, rebuilt from runs: the k-th run belongs to the k-th occupied quotient."""
        run = np.cumsum(self.runend[self.filled]) - self.runend[self.filled]
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        r = np.uint64(self.bits - self.q)
        return quotient << r | self.remainders if self.bits > self.q else quotient

    def merge(self, other: "Filter") -> "Filter":
        """Both filters' fingerprints with their counts added."""
        return Filter.build(*_added([(f.fingerprints(), f.counts) for f in (self, other)]), self.bits)

    def row(self, part: int) -> tuple:
        pack = lambda flags: np.packbits(flags).tobytes()
        return (part, self.q, self.slots, pack(self.occupied), pack(self.runend), pack(self.filled),
                self.remainders.tobytes(), self.counts.tobytes())

    @classmethod
    def of_row(cls, row: dict, bits: int) -> "Filter":
        flags = lambda raw, n: np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        q, slots = row["quotient_bits"], row["slots"]
        return cls(bits, q, slots, flags(row["occupied"], 1 << q), flags(row["runend"], slots), flags(row["filled"], slots),
                   np.frombuffer(row["remainders"], np.uint64), np.frombuffer(row["counts"], np.int64))


def _added(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of (fingerprint, count) merged into one; a stable sort walks the sorted runs."""
    keys = np.concatenate([k for k, _ in lists]) if lists else np.zeros(0, np.uint64)
    counts = np.concatenate([c for _, c in lists]) if lists else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _pieces(bits: int, split: int):
    """Fingerprints of a task to the pieces of its filter, one per range (the leading ``split`` bits)."""
    def flush(gathered):
        keys, counts = _added(gathered)
        parts = (keys >> np.uint64(bits - split)).astype(np.int64) if split else np.zeros(len(keys), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(keys) else []
        rows = [Filter.build(keys[a:b], counts[a:b], bits).row(int(parts[a]))
                for a, b in zip(starts, [*starts[1:], len(keys)])]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, [pa.int32()] * 3 + [pa.binary()] * 5)],
            [c.split()[0] for c in PIECE.split(", ")])

    def run(batches):
        gathered, held = [], 0
        for batch in batches:
            keys = np.sort(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            gathered.append(_added([(keys, np.ones(len(keys), np.int64))]))
            held += len(gathered[-1][0])
            if held >= TASK_ROWS:
                gathered = [_added(gathered)]
                held = len(gathered[0][0])
                if held >= TASK_ROWS // 2:
                    yield flush(gathered)
                    gathered, held = [], 0
        if gathered:
            yield flush(gathered)
    return run


def _repeated(bits: int):
    """All pieces of a range to its fingerprints counted more than once."""
    def run(batches):
        level: list[tuple[int, Filter]] = []
        for batch in batches:
            for row in batch.to_pylist():
                level.append((0, Filter.of_row(row, bits)))
                # Filters of equal height merge like the digits of a counter carry.
                while len(level) > 1 and level[-1][0] == level[-2][0]:
                    (height, last), (_, before) = level.pop(), level.pop()
                    level.append((height + 1, before.merge(last)))
        while len(level) > 1:
            (_, last), (height, before) = level.pop(), level.pop()
            level.append((height, before.merge(last)))
        for _, whole in level:
            keys, often = whole.fingerprints(), whole.counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(whole.counts[often])], ["fp", "n"])
    return run


def repeated_fingerprints(fingerprints: DataFrame, rows: int, bits: int = BITS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(fp, n)`` of the fingerprints that occur more than once; ``fp`` holds ``bits`` bits in a bigint, ``rows`` is their number."""
    split = min(bits - 1, max(0, int(np.ceil(np.log2(max(rows / range_rows, 1))))))
    pieces = fingerprints.select("fp").mapInArrow(_pieces(bits, split), PIECE)
    return pieces.groupBy("part").applyInArrow(_merged(bits), "fp bigint, n bigint")


def _merged(bits: int):
    work = _repeated(bits)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(work(table.to_batches())), pa.schema([("fp", pa.int64()), ("n", pa.int64())]))
    return run


def _fingerprint(sha: str, bits: int):
    """Leading ``bits`` bits of a hexadecimal digest as bigint; all 64 bits wrap into the sign."""
    high = F.conv(F.substring(sha, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(sha, 9, 8), 16, 10).cast("bigint")
    whole = F.shiftleft(high, 32).bitwiseOR(low)
    return F.shiftrightunsigned(whole, 64 - bits) if bits < 64 else whole


def classes(documents: DataFrame, bits: int = BITS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row of ``documents(doc_id, text)``."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hashed = texts.withColumn("sha", F.sha2("text", 256))
    keyed = hashed.withColumn("fp", _fingerprint("sha", bits))
    repeated = settled(repeated_fingerprints(keyed, documents.count(), bits, range_rows).select("fp"))
    n = repeated.count()
    routed = lookup_join(keyed, repeated, "fp", n, "left_semi", spread_by=["doc_id"])
    # Grouping by the text itself compares bytes; different texts behind one fingerprint part here.
    verified = (routed.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                .where("group_size > 1").select(F.sha2("text", 256).alias("sha"), "keep_id", "group_size"))
    verified = settled(verified)
    found = lookup_join(hashed.select("doc_id", "sha"), verified.withColumn("grouped", F.lit(True)), "sha", verified.count(),
                        "left", spread_by=["doc_id"])
    grouped = F.coalesce("grouped", F.lit(False))
    found = found.select("doc_id", F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
                         F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.col("sha").alias("text_sha256"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of ``documents`` per distinct text: that of the largest doc_id, with all its columns."""
    key = lambda sha: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), sha).alias("_row")
    judged = settled(classes(documents, bits).where("group_size > 1").groupBy(key(F.col("text_sha256")))
                     .agg(F.first("kept").alias("kept"), F.count("*").alias("n")))
    rows = documents.withColumn("_row", key(F.sha2(F.coalesce("text", F.lit("")), 256)))
    apart = judged.where("NOT kept OR n > 1").select("_row")
    repeated = judged.where("kept AND n > 1").select("_row")
    single = lookup_join(rows, apart, "_row", apart.count(), "left_anti", spread_by=["doc_id"])
    # Only rows that repeat an id and its text move with all their columns.
    copies = lookup_join(rows, repeated, "_row", repeated.count(), "left_semi", spread_by=["doc_id"])
    return single.unionByName(copies.dropDuplicates(["_row"])).select(*documents.columns)
