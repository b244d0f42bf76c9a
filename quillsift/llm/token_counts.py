"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

Texts are cut into pre-tokens by the public pattern. Distinct pre-tokens go into a trie over their bytes. A node
holds the best segmentation of the bytes on its path: the forward step at a node looks back along the path over
all vocabulary pieces that end there, so a prefix that many pre-tokens share is scored once. The node where a
pre-token ends stores its token count. A document's count is the sum over its pre-tokens.

The model is the rank file read as unigram: a piece of rank r has probability proportional to 1 / (r + 2.7), its
cost is the negative logarithm in millionths, rounded. The cheapest segmentation counts, of equally cheap ones
the one of fewer tokens. Every byte is a piece, so each text has a segmentation.

A worker process keeps its trie from task to task. A trie beyond ``NODES`` nodes starts anew, but the counts stored
at its terminal nodes stay until there are ``WORDS`` of them; then the older half goes. A pre-token longer than
``LONGEST`` bytes runs through the same recurrence without being stored. A null or empty text has no tokens. Repeated
rows count alike.
"""

from __future__ import annotations

import functools
import math
from itertools import islice

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from quillsift.llm.bpe import VOCABULARY, load_ranks

NODES, WORDS = 600_000, 600_000
LONGEST = 256
SHIFT = 2.7
#: Costs are stored as cost * TIE + tokens, so the smaller number is cheaper, then shorter.
TIE = 1 << 32
SCHEMA = "doc_id bigint, n_pretokens bigint, n_tokens bigint"


def unigram_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Cost of every piece in millionths of a nat."""
    mass = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
    return {piece: round(1e6 * (math.log(rank + SHIFT) + mass)) for piece, rank in ranks.items()}


class Trie(dict):
    """Maps a pre-token to its token count; a missing one is inserted with the nodes it lacks."""

    def __init__(self, costs: dict[bytes, int]):
        self.costs = {piece: cost * TIE + 1 for piece, cost in costs.items()}
        self.longest = max(map(len, costs))
        self.children: dict[int, int] = {}
        self.best = [0]

    def _forward(self, path: list[int], raw: bytes, end: int) -> int:
        """Best value for ``raw[:end]`` given the values of all its shorter prefixes."""
        costs = self.costs
        return min(path[k] + costs[piece] for k in range(max(0, end - self.longest), end) if (piece := raw[k:end]) in costs)

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) > LONGEST:
            path = [0]
            for end in range(1, len(raw) + 1):
                path.append(self._forward(path, raw, end))
            return path[-1] % TIE
        if len(self.best) > NODES:
            self.children, self.best = {}, [0]
        if len(self) >= WORDS:
            for old in list(islice(self, len(self) // 2)):
                del self[old]
        node, path = 0, [0]
        for end, byte in enumerate(raw, 1):
            key = node << 8 | byte
            node = self.children.get(key, 0)
            if not node:
                node = self.children[key] = len(self.best)
                self.best.append(self._forward(path, raw, end))
            path.append(self.best[node])
        self[word] = count = path[-1] % TIE
        return count


@functools.lru_cache(maxsize=2)
def shared_trie(path: str) -> Trie:
    """The trie of a rank file; one per worker process."""
    return Trie(unigram_costs(load_ranks(path)))


def count_tokens(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_pretokens, n_tokens)`` of every row of ``documents(doc_id, text)``."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        trie, cut = shared_trie(path), regex.compile(public_tokenizers.PATTERN).findall
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                own = cut(text or "")
                words.append(len(own))
                tokens.append(sum(map(trie.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                                             ["doc_id", "n_pretokens", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
