"""Byte-level BPE encoding by overlapping chunks, and decoding.

A text of at most ``CHUNK`` characters is one piece. A longer text is cut into chunks of ``CHUNK`` characters
that reach ``OVERLAP`` characters into the next one. Each chunk is pre-tokenised for itself. A boundary with
white space after it and none before it is a boundary of every pre-tokenisation, whatever came earlier, because
no pre-token runs from other characters into white space. So two neighbours resynchronise at the first such
boundary of their overlap: the earlier chunk ends there, the later one begins there. The pieces are encoded
in parallel, the ids of a text are their concatenation. A text with an overlap that has no such boundary (a
pre-token longer than the overlap) is encoded whole. Decoding concatenates the raw bytes of the ids.

A null text is empty: no ids. Rows are told apart by a hash of id and text, so repeated ids do not mix;
equal rows give equal results. Special tokens are ordinary text. Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from quillsift.llm.common import lean

CHUNK, OVERLAP = 1 << 16, 1 << 12
#: Rows that a worker turns into ids at once.
ROWS = 256
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
IDS = "doc_id bigint, n_tokens bigint, ids array<int>"
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoder of a rank file; built once per worker."""
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=1)
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


def resync(text: str, begin: int, end: int, boundaries) -> int | None:
    """First boundary in ``[begin, end)`` between a non-blank and white space, or None."""
    return next((p for p in boundaries if begin <= p < end and not text[p - 1].isspace() and text[p].isspace()), None)


def piece(chunk: str, is_first: bool, is_last: bool, size: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int] | None:
    """Bounds of the part of a chunk (with its overlap) that is the chunk's own, None if it cannot tell."""
    boundaries = [m.end() for m in _pattern().finditer(chunk)]
    begin = 0 if is_first else resync(chunk, 1, min(overlap, len(chunk)), boundaries)
    end = len(chunk) if is_last else resync(chunk, size + 1, min(size + overlap, len(chunk)), boundaries)
    return None if begin is None or end is None else (begin, end)


def _ids(coder: tiktoken.Encoding, texts: list[str]) -> pa.ListArray:
    arrays = [coder.encode_to_numpy(t, disallowed_special=()) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _slices(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _whole(path: str):
    """Texts to ids, one piece per text."""
    def run(batches):
        coder = encoding(path)
        for batch in _slices(batches):
            ids = _ids(coder, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()), ids], ["doc_id", "n_tokens", "ids"])
    return run


def _chunks(path: str, size: int, overlap: int):
    """Chunks to the ids of their own pieces; null bounds where they are not known."""
    def run(batches):
        coder = encoding(path)
        for batch in _slices(batches):
            texts, begins, ends = [], [], []
            for text, i, n in zip(*(batch.column(c).to_pylist() for c in ("text", "chunk", "chunks"))):
                own = piece(text, i == 0, i == n - 1, size, overlap)
                texts.append("" if own is None else text[own[0]:own[1]])
                begins.append(None if own is None else i * size + own[0])
                ends.append(None if own is None else i * size + own[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("chunk"), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()),
                 _ids(coder, texts)], ["row", "chunk", "begin", "finish", "ids"])
    return run


def encode(documents: DataFrame, path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP,
           then=None, schema: str = IDS) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row of ``documents(doc_id, text)``.

    ``then`` may turn batches of these rows into others of ``schema``, in the worker that encoded them.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    whole = _whole(path) if then is None else lambda batches: then(_whole(path)(batches))
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= size).mapInArrow(lean(whole), schema)
    long = rows.where(F.length("text") > size).withColumn(
        "row", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256))
    # Texts that occur once per row key are chunked once; their rows find the result again by the key.
    unique = long.select("row", "text").dropDuplicates(["row"])
    chunks = F.ceil(F.length("text") / F.lit(size)).cast("int")
    cut = unique.select("row", "text", chunks.alias("chunks")).select(
        "row", "chunks", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.substring(
            "text", i * size + 1, F.lit(size + overlap)))).alias("chunk", "text"))
    pieces = cut.repartition("row", "chunk").mapInArrow(
        lean(_chunks(path, size, overlap)), "row string, chunk int, begin bigint, finish bigint, ids array<int>")
    joined = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "begin", "finish", "ids"))).alias("p"))
    sound = F.forall("p", lambda x: x.begin.isNotNull()) & F.forall(
        F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.get("p", i).begin == F.get("p", i - 1).finish)
    joined = joined.select("row", F.when(sound, F.flatten(F.transform("p", lambda x: x.ids))).alias("ids"))
    found = long.join(joined, "row")
    stitched = found.where(F.col("ids").isNotNull()).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")
    if then is not None:
        stitched = stitched.mapInArrow(lean(then), schema)
    left = found.where(F.col("ids").isNull()).select("doc_id", "text").mapInArrow(lean(whole), schema)
    return short.unionByName(stitched).unionByName(left)


@functools.lru_cache(maxsize=2)
def _tables(path: str) -> tuple[pa.Array, pa.Array]:
    """Bytes and decimal text of every id."""
    ranks = load_ranks(path)
    tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.large_binary()), pa.array([str(i) for i in range(len(tokens))], pa.large_string())


def _raw(tokens: pa.Array, ids: pa.ListArray) -> list[memoryview]:
    """Decoded bytes of every list: the taken tokens lie end to end in one buffer."""
    taken = pc.take(tokens, ids.flatten())
    places = np.frombuffer(taken.buffers()[1], np.int64)[:len(taken) + 1]
    data = memoryview(taken.buffers()[2] or b"")
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
    return [data[places[a]:places[b]] for a, b in zip(ends[:-1], ends[1:])]


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, data)``: the raw bytes of the ids of every row."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        tokens, _ = _tables(path)
        for batch in _slices(batches):
            data = [bytes(x) for x in _raw(tokens, batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id bigint, data binary")


def _hashes(path: str):
    """Encoded rows to hashes of the ids as decimal text and of the decoded bytes."""
    def run(batches):
        tokens, numbers = _tables(path)
        for batch in _slices(batches):
            ids = batch.column("ids")
            sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pc.take(numbers, ids.flatten()))
            joined = pc.binary_join(lists, pa.scalar(",", pa.large_string()))
            a = [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in joined]
            b = [hashlib.sha256(x).hexdigest() for x in _raw(tokens, ids)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(a), pa.array(b)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: hashes of the ids as decimal text and of the decoded bytes."""
    return encoded.mapInArrow(lean(_hashes(path or public_tokenizers.path(VOCABULARY))), DIGEST)


def encoded_digests(documents: DataFrame, path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``digests`` of ``encode`` without sending ids from one worker to another: a task needs one worker, not two."""
    path = path or public_tokenizers.path(VOCABULARY)
    return encode(documents, path, size, overlap, _hashes(path), DIGEST)
