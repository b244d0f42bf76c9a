"""Word statistics and compression bands.

Base numbers come from words (runs of characters other than blank and U+0009 to U+000D), lines and three-word
windows of the whole text. A document with too few words or mostly repeated windows fails the base rule.

Method: the zstandard ratio (compressed by raw bytes) of the whole text must lie between two limits that depend on
its length, because short texts compress badly and long ones well; and of its fixed chunks of ``CHUNK`` bytes at
most ``REPETITIVE_SHARE`` may compress below ``CHUNK_LIMITS[0]`` and at most ``RANDOM_SHARE`` stay above
``CHUNK_LIMITS[1]``. A last chunk below half of ``CHUNK`` is judged with the whole text only.

A null or wordless text has zeros everywhere, fails the base rule and has ratio null. Repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quillsift.llm.common import WordScanner, mix64, pieces, seeded64

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: A base failure: 100 * repeated words above this times words.
REPEATED_SHARE = 50
LEVEL = 3
CHUNK = 4096
#: (bytes from, least ratio, largest ratio); the last row that a text reaches holds.
BANDS = ((0, 0.0, 9.0), (64, 0.30, 1.6), (256, 0.28, 1.0), (1024, 0.22, 0.90), (4096, 0.20, 0.85), (16384, 0.18, 0.80))
CHUNK_LIMITS = (0.15, 0.90)
REPETITIVE_SHARE, RANDOM_SHARE = 0.5, 0.25
SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, ratio double, repetitive_chunks double, random_chunks double")

_BLANK = " \t\n\v\f\r"


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, the words that lie in a three-word window found at least twice in the row."""
    if len(words) < 3:
        return np.zeros(rows, np.int64)
    places = seeded64(21, 4)
    with np.errstate(over="ignore"):
        rolled = mix64(words[:-2] * places[0] + words[1:-1] * places[1] + words[2:] * places[2])
        rolled = mix64(rolled + row[:-2].astype(np.uint64) * places[3])
    inside = row[:-2] == row[2:]
    _, back, count = np.unique(rolled, return_inverse=True, return_counts=True)
    # Windows across two rows are hashed with the first row's number, but do not count.
    within = np.bincount(back[inside], minlength=len(count))
    twice = inside & (within[back] > 1)
    marked = np.zeros(len(words), bool)
    for k in range(3):
        marked[k:len(words) - 2 + k] |= twice
    return np.bincount(row[marked], minlength=rows)


def bands(raw: bytes, coder: zstandard.ZstdCompressor) -> tuple[float | None, float, float, bool]:
    """Ratio of the whole text, shares of repetitive and of incompressible chunks, and the verdict."""
    if not raw:
        return None, 0.0, 0.0, False
    ratio = len(coder.compress(raw)) / len(raw)
    _, low, high = next(b for b in reversed(BANDS) if len(raw) >= b[0])
    chunks = [raw[k:k + CHUNK] for k in range(0, len(raw), CHUNK)]
    rates = np.array([len(coder.compress(c)) / len(c) for c in chunks if 2 * len(c) >= CHUNK])
    flat = float((rates < CHUNK_LIMITS[0]).mean()) if len(rates) else 0.0
    noisy = float((rates > CHUNK_LIMITS[1]).mean()) if len(rates) else 0.0
    return ratio, flat, noisy, low <= ratio <= high and flat <= REPETITIVE_SHARE and noisy <= RANDOM_SHARE


def _judge(batches):
    scan, coder = WordScanner(), zstandard.ZstdCompressor(level=LEVEL)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        texts = batch.column("text")
        columns = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
        verdicts = []
        for a, b, data, offsets in pieces(texts):
            start, end, row = scan.spans(data, offsets)
            per_row = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[offsets])
            columns["n_words"].append(np.bincount(row, minlength=b - a))
            columns["word_chars"].append(per_row(((data & 0xC0) != 0x80) & ~scan.separator[data]))
            columns["n_symbols"].append(per_row(symbol[data]))
            columns["n_dup_lines"].append([repeated_lines(t or "") for t in texts.slice(a, b - a).to_pylist()])
            columns["n_repeat_words"].append(repeated_words(scan.hashes(data, start, end), row, b - a))
            raw = data.tobytes()
            verdicts += [bands(raw[offsets[i]:offsets[i + 1]], coder) for i in range(b - a)]
        got = {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in columns.items()}
        failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > REPEATED_SHARE * got["n_words"])
        kept = ~failed & np.array([v[3] for v in verdicts], bool)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(got[k]) for k in columns), pa.array(failed), pa.array(kept),
             *(pa.array([v[k] for v in verdicts], pa.float64()) for k in range(3))],
            [f.split()[0] for f in SCHEMA.split(", ")])


def judge(documents: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of ``documents(doc_id, text)``."""
    return documents.select("doc_id", "text").mapInArrow(_judge, SCHEMA)
