"""Operator 1, packing: cost-balanced sequences of tokenized documents.

Each block of documents is packed where it was tokenized, so neither texts nor ids are shuffled. A block of T tokens gets
ceil(T / capacity) sequences. A piece of n tokens costs linear * n + quadratic * n * n (projections, and attention within
the piece). Documents go in descending order, each to the sequence of the lowest cost that has room; what doesn't fit is
cut off and goes on as a shorter document. All but capacity - 1 tokens of a block's room are filled so."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from geoloom.llm.shared import as_text, slices

#: Fixed value: how the byte-level vocabulary splits texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def byte_level_encoding(spec: bytes):
    """The tokenizer of a byte-level BPE tokenizer.json, run by the faster of the libraries; ids are those of the file."""
    import tiktoken

    model = json.loads(spec)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def pack_lengths(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; documents of no tokens have none."""
    n = -(-sum(lengths) // capacity)
    open_sequences = [(0.0, s) for s in range(n)]
    used = [0] * n
    queue = [(-length, doc, 0) for doc, length in enumerate(lengths) if length]
    heapq.heapify(queue)
    out = []
    while queue:
        left, doc, start = heapq.heappop(queue)
        cost, s = open_sequences[0]
        take = min(-left, capacity - used[s])
        out.append((doc, start, take, s, used[s]))
        used[s] += take
        if used[s] < capacity:
            heapq.heapreplace(open_sequences, (cost + linear * take + quadratic * take * take, s))
        else:
            heapq.heappop(open_sequences)
        if -left > take:
            heapq.heappush(queue, (left + take, doc, start + take))
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, block_tokens: int = 1 << 22) -> DataFrame:
    """One row per piece (PIECES) of docs' texts: ids of `tokenizer` (a local tokenizer.json), then the id `end`.

    Null and empty texts are documents of the one token `end`. doc_id may be null or repeat; rows stay apart. Other columns
    are not read. A sequence_id holds the task and the sequence in it, so ids are unique, not gapless. A task keeps the ids
    of at most block_tokens tokens and one run of texts; a longer document is in memory whole."""
    with open(tokenizer, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_level_encoding(spec.value)
        number = TaskContext.get().partitionId() << 32

        def packed(ids: list, docs: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal number
            pieces = pack_lengths([len(x) for x in docs], capacity)
            rows = [(ids[d], start, n, zlib.crc32(docs[d][start : start + n].data), len(docs[d]), number + s, at) for d, start, n, s, at in pieces]
            number += max((p[3] for p in pieces), default=-1) + 1
            columns = zip(*rows) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECES.split(", ")])

        ids, tokens, total = [], [], 0
        for part in slices(batches, most=1 << 20):
            ids += part.column("doc_id").to_pylist()
            for text in as_text(part.column("text")).to_pylist():
                tokens.append(np.array([*encoding.encode(text, allowed_special="all"), end], "<u4"))
                total += len(tokens[-1])
            if total >= block_tokens:
                yield packed(ids, tokens)
                ids, tokens, total = [], [], 0
        if ids:
            yield packed(ids, tokens)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PIECES)
