"""Quality, token counts and BPE against plain statements of their rules."""

import hashlib
import re
from collections import Counter

import pytest
import public_tokenizers
import tiktoken

from quillsift.llm import bpe, common, quality, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(marked))


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_quality_base_numbers(request, name):
    docs = request.getfixturevalue(name)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == base(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_bands_reject_both_ends():
    import random
    import zstandard
    coder, draw = zstandard.ZstdCompressor(level=3), random.Random(1)
    prose = " ".join("".join(draw.choice(["ta", "re", "mi", "no", "lu", "ke"]) for _ in range(draw.randint(1, 4))) for _ in range(900))
    assert quality.bands(prose.encode(), coder)[3]
    assert not quality.bands(b"again and again " * 600, coder)[3]
    assert not quality.bands(draw.randbytes(9000), coder)[3]
    assert quality.bands(b"", coder) == (None, 0.0, 0.0, False)


def viterbi(word, costs, longest):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        best.append(min((best[k][0] + costs[word[k:end]], best[k][1] + 1)
                        for k in range(max(0, end - longest), end) if word[k:end] in costs))
    return best[-1][1]


def test_token_counts_equal_plain_dynamic_programming(documents, odd, monkeypatch):
    import regex
    costs = token_counts.unigram_costs(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    longest = max(map(len, costs))
    for docs in (documents.where("doc_id < 12"), odd.where("doc_id <> 9 or doc_id is null")):
        texts = {(r.doc_id, r.text): r.text or "" for r in docs.collect()}
        want = Counter()
        for (i, _), text in texts.items():
            words = regex.findall(public_tokenizers.PATTERN, text)
            want[i] = (len(words), sum(n * viterbi(w.encode(), costs, longest) for w, n in Counter(words).items()))
        rows = token_counts.count_tokens(docs).collect()
        assert len(rows) == docs.count() and all((r.n_pretokens, r.n_tokens) == want[r.doc_id] for r in rows)


def test_trie_that_starts_anew_counts_alike(monkeypatch):
    costs = token_counts.unigram_costs(bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)))
    words = [f" word{i}" for i in range(300)] + ["y" * 400]
    plain = token_counts.Trie(costs)
    want = [plain[w] for w in words]
    monkeypatch.setattr(token_counts, "NODES", 20)
    small = token_counts.Trie(costs)
    assert [small[w] for w in words] == want


@pytest.mark.parametrize("size,overlap", [(1 << 16, 1 << 12), (40, 12), (64, 4)])
def test_bpe_equals_the_library(documents, odd, size, overlap):
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN,
                              mergeable_ranks=bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    for docs in (documents.where("doc_id < 60"), odd.where("doc_id <> 9 or doc_id is null") if size > 999 else odd.where("doc_id in (1, 2, 3, 4, 5, 7, 10)")):
        want = Counter()
        for r in docs.collect():
            ids = coder.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                 hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        got = Counter(tuple(r) for r in bpe.digests(bpe.encode(docs, size=size, overlap=overlap)).collect())
        assert got == want


def test_decode_round_trip(odd):
    docs = odd.where("doc_id in (1, 2, 4, 10)")
    data = {r.doc_id: bytes(r.data).decode() for r in bpe.decode(bpe.encode(docs)).collect()}
    assert data == {r.doc_id: r.text or "" for r in docs.collect()}


def test_empty_tables(none):
    assert quality.judge(none).count() == token_counts.count_tokens(none).count() == bpe.digests(bpe.encode(none)).count() == 0


@pytest.mark.parametrize("size,overlap", [(1 << 16, 1 << 12), (40, 12)])
def test_digests_in_the_encoding_worker_are_the_same(documents, odd, size, overlap):
    for docs in (documents.where("doc_id < 60"), odd.where("doc_id <> 9 or doc_id is null") if size > 999 else odd.where("doc_id in (1, 2, 3, 4, 5, 7, 10)")):
        want = Counter(tuple(r) for r in bpe.digests(bpe.encode(docs, size=size, overlap=overlap)).collect())
        assert Counter(tuple(r) for r in bpe.encoded_digests(docs, size=size, overlap=overlap).collect()) == want


def test_a_task_hands_memory_back_when_it_is_over(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "released", lambda: calls.append(1))
    task = common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))
    assert next(task) == 2 and not calls
    assert list(task) == [4, 6] and calls == [1]
