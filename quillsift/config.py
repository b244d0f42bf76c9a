"""Parameters of the jobs, with the defaults results are stated for."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Chunking:
    size: int = 320
    overlap: int = 64
    header_tokens: int = 48

    def __post_init__(self):
        if not 0 <= self.overlap < self.size <= 420:
            raise ValueError("window size must lie in (overlap, 420]")
        if self.size + self.header_tokens + 12 > 512:
            raise ValueError("window and header exceed the encoder input of 512 tokens")


@dataclass(frozen=True)
class Retrieval:
    broad_k: int = 100
    dense_k: int = 100
    precise_k: int = 40
    rrf_constant: int = 60
    pool_k: int = 32
    lexical_pool_k: int = 24
    per_parent: int = 2
    parents_k: int = 4
    max_query_tokens: int | None = None
    max_query_phrases: int | None = None
    and_levels: tuple = (12, 8, 5)
    coverage_weight: float = 2.0
    phrase_bonus: float = 1.0
    document_bonus: float = 4.0
    year_bonus: float = 1.0
    recency_bonus: float = 0.75
    scope_penalty: float = 0.0
    # Words that name a scope, and the rule that adds a query: (topics, markers, query). None takes those of the lexicon.
    scope_markers: tuple | None = None
    intent_expansion: bool = False
    intent_rule: tuple | None = None
    adjacent_distance: int = 0
    adjacent_seeds: int = 8
    adjacent_reserve: int | None = None
    # Show at most so many characters of a parent, from so many before the chunk; None shows all.
    parent_chars: int | None = None
    parent_lead: int = 10000

    @property
    def reserve(self) -> int:
        wanted = max(1, self.pool_k // 4) if self.adjacent_reserve is None else self.adjacent_reserve
        return min(wanted, self.pool_k)


@dataclass(frozen=True)
class Generation:
    max_input_tokens: int = 4096
    max_new_tokens: int = 1536
    parent_max_tokens: int = 1400
    min_context_tokens: int = 256
    contexts_k: int = 4
    same_document: bool = False
    complete_units: bool = False
    system_suffix: str = ""

    def __post_init__(self):
        if self.max_input_tokens + self.max_new_tokens > 8192:
            raise ValueError("input and output exceed the 8192-token window")


@dataclass(frozen=True)
class RepairPolicy:
    version: int = 1
    min_chars: int = 60
    min_words: int = 8
    min_repeats: int = 3
    max_block: int = 12
    numbered_repeats: int = 6

    def __post_init__(self):
        safe = self.min_repeats >= 3 and self.min_chars >= 60 and self.min_words >= 8 and self.max_block >= 1
        if not safe or self.version not in (1, 2) or (self.version == 2 and self.numbered_repeats < 6):
            raise ValueError("unsafe repetition policy")


@dataclass(frozen=True)
class Attempts:
    budgets: tuple = (2048, 3072, 4096)
    input_tokens: int = 4096
    total_tokens: int = 8192
    max_attempts: int = 4
    near_limit: float = 0.90
    coverage: float = 0.65
    phrase_words: int = 3


@dataclass(frozen=True)
class Settings:
    seed: int = 2026
    target_meteor: float = 0.65
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    repair: RepairPolicy = field(default_factory=RepairPolicy)

    def patched(self, changes: dict) -> "Settings":
        """Replace single values inside named sections; unknown names are an error."""
        out = self
        for section, values in changes.items():
            current = getattr(out, section, None)
            if current is None or not hasattr(current, "__dataclass_fields__"):
                raise ValueError(f"unknown section: {section}")
            unknown = set(values) - set(current.__dataclass_fields__)
            if unknown:
                raise ValueError(f"unknown settings in {section}: {sorted(unknown)}")
            out = replace(out, **{section: replace(current, **values)})
        return out


# Retrieval settings worth comparing against the default, one job each.
RETRIEVAL_VARIANTS = {
    "r1_pool_64": {"retrieval": {"pool_k": 64}},
    "r2_intent_query": {"retrieval": {"intent_expansion": True}},
    "r3_adjacent_articles": {
        "retrieval": {"adjacent_distance": 1, "adjacent_seeds": 8, "adjacent_reserve": 8}
    },
    "r4_lexical_weight_1": {"retrieval": {"coverage_weight": 1.0}},
    "r5_scope_penalty": {"retrieval": {"scope_penalty": 0.75}},
}
