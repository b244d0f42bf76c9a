"""Similarity of an answer to its reference: longest common subsequence and exact word alignment."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T


def common_subsequence(left, right) -> int:
    """Length of the longest common subsequence, a row of the table per machine-word operation."""
    masks: dict = {}
    for i, word in enumerate(left):
        masks[word] = masks.get(word, 0) | (1 << i)
    full = (1 << len(left)) - 1
    state = full
    for word in right:
        hit = state & masks.get(word, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(left) - state.bit_count()


def rouge_tokens(text: str):
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def rouge_l_value(reference: str, answer: str) -> float:
    gold, mine = rouge_tokens(reference), rouge_tokens(answer)
    common = common_subsequence(gold, mine)
    if not common:
        return 0.0
    precision, recall = common / len(mine), common / len(gold)
    return 2 * precision * recall / (precision + recall)


def meteor_exact_value(reference: str, answer: str) -> float:
    """Word-alignment score that counts equal words only (no stems, no synonyms)."""
    gold, mine = reference.lower().split(), answer.lower().split()
    places: dict = {}
    for i, word in enumerate(gold):
        places.setdefault(word, []).append(i)
    pairs = []
    for i in range(len(mine) - 1, -1, -1):
        spots = places.get(mine[i])
        if spots:
            pairs.append((i, spots.pop()))
    if not pairs:
        return 0.0
    pairs.reverse()
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    precision, recall = len(pairs) / len(mine), len(pairs) / len(gold)
    mean = precision * recall / (0.9 * precision + 0.1 * recall)
    return (1 - 0.5 * (chunks / len(pairs)) ** 3) * mean


@F.pandas_udf(T.DoubleType())
def rouge_l(reference: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_value(r, a) for r, a in zip(reference, answer)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def meteor_exact(reference: pd.Series, answer: pd.Series) -> pd.Series:
    return pd.Series([meteor_exact_value(r, a) for r, a in zip(reference, answer)], dtype="float64")
