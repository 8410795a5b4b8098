"""Problem 8: token ids of every text by a public byte-pair vocabulary.

Method: a text is split by the vocabulary's published pattern; the bytes of a piece are leaves
of a segment tree whose inner nodes keep the lowest (rank, position) of the adjacent pairs below
them. The root yields the leftmost lowest-rank merge; a merge updates three leaves in
logarithmic time; the piece is done when no pair is mergeable. A piece of n bytes costs
O(n log n), so one huge word is no trap.

Scale: one scan, no shuffle; Arrow batches; each worker keeps the ids of pieces it has met in a
bounded dictionary. The vocabulary (under 2 MB) travels once to each executor as a broadcast
variable, so executors need no file of their own.

Defined results: null and empty texts have the empty list; blank texts are encoded like others;
strings that look like special tokens are ordinary text; very long texts are encoded whole;
repeated rows repeat; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import query_reading

#: Where the public vocabularies are; their path is a parameter, they are not copied.
TOKENIZERS = "/opt/tokenizers"
#: The splitting pattern that belongs to the vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers before it starts over, and the longest it remembers.
CACHE_PIECES, CACHE_CHARS = 200_000, 64
NO_PAIR = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece by repeated lowest-rank merges over a segment tree."""
    n = len(piece)
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    get = ranks.get
    part = [piece[i : i + 1] for i in range(n)]
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1
    while size < n:
        size *= 2
    # a node holds rank * n + position: the minimum is the leftmost pair of the lowest rank
    none = NO_PAIR * n
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, v: int) -> None:
        k = size + i
        if tree[k] == v:
            return
        tree[k] = v
        while k > 1:
            a, b = tree[k], tree[k ^ 1]
            k >>= 1
            m = a if a < b else b
            if tree[k] == m:
                return
            tree[k] = m

    while tree[1] < none:
        i = tree[1] % n
        j = nxt[i]
        part[i] += part[j]
        k = nxt[i] = nxt[j]
        put(j, none)
        if k < n:
            prev[k] = i
            r = get(part[i] + part[k])
            put(i, none if r is None else r * n + i)
        else:
            put(i, none)
        h = prev[i]
        if h >= 0:
            r = get(part[h] + part[i])
            put(h, none if r is None else r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i]])
        i = nxt[i]
    return out


def encoder(ranks: dict[bytes, int], pattern: str = PATTERN) -> Callable[[str | None], list[int]]:
    """A function from text to ids; null and '' give []."""
    import regex

    find, cache = regex.compile(pattern).findall, {}

    def encode(text: str | None) -> list[int]:
        out: list[int] = []
        for w in find(text or ""):
            ids = cache.get(w)
            if ids is None:
                ids = merge_piece(w.encode("utf-8", "surrogatepass"), ranks)
                if len(w) <= CACHE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[w] = ids
            out += ids
        return out

    return encode


def _ranks_broadcast(spark: SparkSession, vocabulary: str, folder: str):
    return spark.sparkContext.broadcast(load_ranks(os.path.join(folder, f"{vocabulary}.tiktoken")))


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``<key>, ids``: token ids of each text, without special tokens."""
    ranks = _ranks_broadcast(docs.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def count_tokens(docs: DataFrame, keep: tuple[str, ...], text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ``n_tokens``; the ids never leave the worker."""
    ranks = _ranks_broadcast(docs.sparkSession, vocabulary, folder)
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value)
        for b in batches:
            counts = pa.array([len(encode(t)) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], counts], names=[*keep, "n_tokens"])

    return docs.select(*keep, text).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", n_tokens bigint")


@query_reading("documents")
def p8_ids(documents: DataFrame) -> DataFrame:
    """Ids of each document by byte_bpe_50k."""
    return encode_texts(documents)


@query_reading("documents")
def p8_sizes(documents: DataFrame) -> DataFrame:
    """Documents, characters and tokens of each source."""
    counted = count_tokens(documents, ("source", "n_chars"))
    return counted.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))


QUERIES = {"p8_ids": p8_ids, "p8_sizes": p8_sizes}
