"""Readers, hashing and the vectorised word scanner that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a maximal run of characters other than the blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker scans at once.
PIECE_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch: rows are whole documents, so the default of 10,000 rows is too much at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers for the rest of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def released() -> None:
    """Hand freed memory back to the system; a process keeps it otherwise until it ends."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run):
    """``run`` for the batches of a task, handing back what it freed when the task is over.

    Workers wait for later tasks with the memory of earlier ones otherwise, and so many of them fill an executor.
    """
    def task(batches):
        try:
            yield from run(batches)
        finally:
            released()
    return task


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(key: Column) -> Column:
    """One row in five, fixed by the CRC of the id as text; rows without id are not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def word_count(text: Column) -> Column:
    """Words of a text as long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def seeded64(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudorandom odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def separators(punctuation: bool = False) -> np.ndarray:
    """Lookup table over bytes: True where a byte ends a word (optionally any ASCII non-alphanumeric)."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    if punctuation:
        for b in range(128):
            out[b] |= not chr(b).isalnum()
    return out


def pieces(texts: pa.Array, lower=None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into runs of rows of about ``PIECE_BYTES``.

    Yields first row, row after the last, the bytes of these rows and their offsets. Nulls are empty.
    ``lower`` may replace the texts of a piece before they are encoded.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, a, n = np.concatenate([[0], np.cumsum(sizes)]), 0, len(texts)
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + PIECE_BYTES, "right")) - 1)
        part = texts.slice(a, b - a)
        if lower is not None:
            rows = [lower(t).encode("utf-8", "surrogatepass") for t in part.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            data = np.frombuffer(b"".join(rows), np.uint8)
        else:
            raw = np.frombuffer(part.buffers()[1], np.int64)[part.offset:part.offset + b - a + 1]
            whole = part.buffers()[2]
            data = np.frombuffer(whole, np.uint8)[raw[0]:raw[-1]] if whole is not None else np.zeros(0, np.uint8)
            offsets = raw - raw[0]
        yield a, b, data, offsets
        a = b


class WordScanner:
    """Word spans and 64-bit word hashes of many texts at once, without a Python loop over words.

    The hash of a word is a polynomial in an odd base over pseudorandom byte values, taken from prefix
    sums, then finalised. ``fold`` hashes A-Z like a-z.
    """

    def __init__(self, punctuation: bool = False, fold: bool = False):
        self.separator = separators(punctuation)
        self.values = seeded64(11, 256)
        if fold:
            self.values[65:91] = self.values[97:123]
        self.base = int(seeded64(12, 1)[0])
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                for name, base in (("powers", self.base), ("inverses", self.inverse)):
                    steps = np.full(n, base, np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the row it belongs to."""
        inside = ~self.separator[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = offsets[:-1][offsets[:-1] < len(data)]
        begins[firsts] = inside[firsts]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        stops[lasts] = inside[lasts]
        start = np.flatnonzero(begins)
        return start, np.flatnonzero(stops) + 1, np.searchsorted(offsets, start, "right") - 1

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of word spans, block by block, so that memory does not grow with the text."""
        out, i = np.empty(len(start), np.uint64), 0
        with np.errstate(over="ignore"):
            while i < len(start):
                j = max(i + 1, int(np.searchsorted(end, start[i] + PIECE_BYTES, "right")))
                low, high = start[i], end[j - 1]
                self._grow(high - low + 1)
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum(self.values[data[low:high]] * self.powers[:high - low], out=sums[1:])
                out[i:j] = mix64((sums[end[i:j] - low] - sums[start[i:j] - low]) * self.inverses[start[i:j] - low])
                i = j
        return out
