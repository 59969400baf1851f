"""Operator 6, language-model scoring: deleted interpolation of word n-grams.

P(w | u) = l2 * c(u w) / c(u) + l1 * c(w) / N + l0 / (V + 1), with weights by the bucket (octave) of c(u). Weights are learned
by expectation-maximisation on a part of the training texts, with the counts of the other part; scores use the counts of
both. The order is two: a text's word runs of three hardly repeat in a corpus, and their counts would be as large again.

Documents are dealt to blocks. A block asks, with one packed row for each range of the hash space, for the counts of its
distinct words and word pairs; a range sums what blocks send it and answers each of them. So words and pairs are shuffled
once, packed, by hash: no word, however frequent, has more than a number for each block. Words are told apart by 64 bits,
pairs by the range and 40 bits more, at which one pair in 100,000 or fewer shares a count with another, whatever the size
of the corpus, as ranges grow in number with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.shared import fold, partitions_for, text_bytes, written
from geoloom.llm.words import mix, word_hashes

END, START = np.uint64(0xE17A1465_D3C0FFE1), np.uint64(0x57A47B16_0DDBA115)
#: Octaves of the context's count; more frequent contexts share the last.
BUCKETS = 24
#: Steps of an octave to which EM rounds probabilities: its table has at most BUCKETS * 400 * 400 rows, whatever the corpus.
STEPS = 4
ITERATIONS = 60

TUNING, TRAINING, HELD_OUT, TOTALS = 0, 1, 2, 3
_ASK = "range int, block int, words binary, word_counts binary, pairs binary, pair_counts binary"
_TOLD = "block int, range int, n_words int, word_counts binary, n_pairs int, pair_counts binary, total array<bigint>"
_SCORED = "doc_id bigint, role int, pair_counts array<bigint>, word_counts array<bigint>, tuning_pairs array<bigint>, tuning_words array<bigint>, total array<bigint>"


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bounds in ascending hashes of n equal ranges of the hash space."""
    return np.searchsorted(hashes, np.array([-(-(k << 64) // n) for k in range(1, n)], np.uint64)).tolist()


class Block:
    """The distinct words and pairs of some texts, where they stand, and how often in each part of the training texts."""

    def __init__(self, texts: pa.Array, roles: np.ndarray):
        offsets, words = word_hashes(*text_bytes(texts), lower=True)
        n = np.diff(offsets)
        self.offsets = offsets + np.arange(len(offsets))  # a text's words, then its end
        tokens = np.full(self.offsets[-1], END)
        here = np.arange(len(words)) + np.repeat(np.arange(len(n)), n)
        tokens[here] = words
        del words, here
        self.roles = roles
        role = np.repeat(roles.astype(np.int8), n + 1)
        self.words, self.word_at, self.word_counts = self._distinct(tokens, role)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.offsets[:-1]] = START
        before *= np.uint64(0xA24BAED4963EE407)
        before += tokens
        del tokens
        self.pairs, self.pair_at, self.pair_counts = self._distinct(mix(before), role)

    @staticmethod
    def _distinct(keys: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, at = np.unique(keys, return_inverse=True)
        at = at.astype(np.int32)  # a block is far smaller
        counts = [np.bincount(at[role == r], minlength=len(found)) for r in (TUNING, TRAINING)]
        return found, at, np.stack(counts, axis=1).astype(np.uint32)


def _pack40(keys: np.ndarray, k: int, ranges: int) -> bytes:
    """The upper 40 bits of what ascending keys have within range k: as steps of four bytes where all are so short, else of five bytes each."""
    low, high = -(-(k << 64) // ranges), -(-((k + 1) << 64) // ranges)
    own = (keys - np.uint64(low)) >> np.uint64(max(0, (high - low - 1).bit_length() - 40))
    steps = np.diff(own, prepend=own[:1] * np.uint64(0))
    if len(own) and steps.max() < 1 << 32:
        return b"4" + steps.astype("<u4").tobytes()
    return b"5" + np.ascontiguousarray(own.astype("<u8")[:, None].view(np.uint8)[:, :5]).tobytes()


def _unpack40(packed: bytes) -> np.ndarray:
    if packed[:1] == b"4":
        return np.cumsum(np.frombuffer(packed, "<u4", offset=1), dtype=np.uint64)
    out = np.zeros((len(packed) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, 5)
    return out.view("<u8").ravel()


def _packed(counts: np.ndarray) -> bytes:
    """Numbers, nearly all of them 0 or 1, as compressed bytes, after one with how wide they are."""
    if not len(counts):
        return b""
    width = 4 if counts.max() < 1 << 32 else 8
    return bytes([width]) + pa.compress(np.ascontiguousarray(counts.T.astype(f"<u{width}")).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros((0, 2), np.int64)
    raw = pa.decompress(packed[1:], decompressed_size=2 * n * packed[0], codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"<u{packed[0]}").reshape(2, n).T.astype(np.int64)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    fields = [c.split(" ") for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _asks(table: pa.Table, ranges: int) -> pa.Table:
    block = Block(table["text"].combine_chunks(), table["role"].to_numpy())
    w, p = [0, *_ranges(block.words, ranges), len(block.words)], [0, *_ranges(block.pairs, ranges), len(block.pairs)]
    number = table["block"][0].as_py()
    return _table([
        (k, number, block.words[w[k] : w[k + 1]].tobytes(), _packed(block.word_counts[w[k] : w[k + 1]]), _pack40(block.pairs[p[k] : p[k + 1]], k, ranges), _packed(block.pair_counts[p[k] : p[k + 1]]))
        for k in range(ranges) if w[k] < w[k + 1] or p[k] < p[k + 1]
    ], _ASK)


def _summed(keys: list[np.ndarray], counts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """What to tell each asker: the counts of its keys, summed over all; and the sums."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate([_unpacked(c, len(k)) for c, k in zip(counts, keys, strict=True)])
    sums = np.stack([np.bincount(at, own[:, k], len(found)) for k in (0, 1)], axis=1).astype(np.int64)  # exact to 2 ** 53
    out, low = [], 0
    for k in keys:
        out.append(_packed(sums[at[low : low + len(k)]]))
        low += len(k)
    return out, sums


def _tells(table: pa.Table) -> pa.Table:
    names = {name: table[name].to_pylist() for name in table.schema.names}
    asked_words, asked_pairs = [np.frombuffer(w, np.uint64) for w in names["words"]], [_unpack40(p) for p in names["pairs"]]
    words, sums = _summed(asked_words, names["word_counts"])
    pairs, _ = _summed(asked_pairs, names["pair_counts"])
    both, train = sums.sum(axis=1), sums[:, TRAINING]
    total = [int(both.sum()), int((both > 0).sum()), int(train.sum()), int((train > 0).sum())]
    told = zip(names["block"], names["range"], map(len, asked_words), words, map(len, asked_pairs), pairs, strict=True)
    return _table([(*row, total if not k else None) for k, row in enumerate(told)], _TOLD)


def _scored(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
    """Per document the training count of each of its pairs and tokens, both parts summed; of tuning ones those of the other
    part too. Totals of the ranges that told them to this block come last."""
    told = told.sort_by("range")
    block = Block(texts["text"].combine_chunks(), texts["role"].to_numpy())
    words, pairs = (np.concatenate([_unpacked(*x) for x in zip(told[f"{c}_counts"].to_pylist(), told[f"n_{c}s"].to_pylist(), strict=True)]) for c in ("word", "pair"))
    if len(words) != len(block.words) or len(pairs) != len(block.pairs):
        raise RuntimeError("a block's texts changed between two reads")
    columns = {}
    for name, counts, at in (("pair", pairs, block.pair_at), ("word", words, block.word_at)):
        columns[f"{name}_counts"] = counts.sum(axis=1, dtype=np.int64)[at]
        columns[f"tuning_{name}s"] = counts[:, TRAINING].astype(np.int64)[at]
    offsets = pa.array(block.offsets, pa.int32())
    tuning = pa.array(block.roles != TUNING)
    lists = {name: pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for name, v in columns.items()}
    lists |= {name: pa.compute.if_else(tuning, pa.scalar(None, v.type), v) for name, v in lists.items() if name.startswith("tuning")}
    names = [c.split(" ")[0] for c in _SCORED.split(", ")]
    totals = [(None, TOTALS, None, None, None, None, t) for t in told["total"].to_pylist() if t is not None]
    scored = [texts["doc_id"].combine_chunks(), texts["role"].combine_chunks(), *(lists[c] for c in names[2:6]), pa.nulls(len(texts), pa.list_(pa.int64()))]
    return pa.concat_tables([pa.table(scored, names=names), _table(totals, _SCORED)])


def counted(docs: DataFrame) -> tuple[DataFrame, tuple[int, int, int, int]]:
    """(a written table _SCORED; tokens and distinct tokens of the training texts, and of the part that isn't for tuning)."""
    blocks = 2 * partitions_for(docs)  # a task holds a block's words, pairs and counts several times over
    number = fold(docs["doc_id"], 40)
    role = F.when(number % 5 == 1, HELD_OUT).when(F.floor(number / 5) == 0, TUNING).otherwise(TRAINING).cast("int")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64(docs["doc_id"].cast("bigint"), F.octet_length(text), F.crc32(text.cast("binary"))), F.lit(blocks)).cast("int")
    dealt = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text.alias("text"), role.alias("role"), block.alias("block")).repartition(blocks, "block")
    # one shuffle of the texts serves both reads; both put a block's texts in one order, where equal rows are interchangeable
    told = dealt.groupBy("block").applyInArrow(lambda t: _asks(_ordered(t), blocks), _ASK).groupBy("range").applyInArrow(_tells, _TOLD)
    out = written(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda key, x, y: _scored(key, _ordered(x), y), _SCORED))
    sums = out.where(f"role = {TOTALS}").agg(*(F.sum(F.col("total")[k]) for k in range(4))).first()
    return out.where(f"role < {TOTALS}").drop("total"), tuple(int(v or 0) for v in sums)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def _contexts(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The count of what stands before each token: the token before, or at a text's start the texts, as many as ends."""
    out = np.empty_like(words)
    out[1:] = words[:-1]
    out[offsets[:-1]] = words[offsets[1:] - 1]
    return out


def _few(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, for what is computed from a row's tokens is many times their size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.flatten()).astype(np.int64), offsets - offsets[0]


def weights(table: DataFrame, tokens: int, distinct: int) -> np.ndarray:
    """Rows (l2, l1, l0) by bucket, by EM on the tuning texts' tokens, with counts of the other training texts."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            pairs, offsets = _lists(batch, "tuning_pairs")
            words, _ = _lists(batch, "tuning_words")
            context = _contexts(words, offsets)
            p2, p1 = pairs / np.maximum(context, 1), words / max(tokens, 1)
            with np.errstate(divide="ignore"):
                steps = [np.where(p > 0, np.round(-STEPS * np.log2(p)), -1).astype(np.int64) for p in (p2, p1)]
            cell, at = np.unique((bucket(context) << 40) + ((steps[0] + 1) << 20) + steps[1] + 1, return_inverse=True)
            sums = [np.bincount(at, v, len(cell)) for v in (np.ones(len(at)), p2, p1)]
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(v) for v in sums)], names=["cell", "n", "p2", "p1"])

    chosen = table.where(f"role = {TUNING}").select("tuning_pairs", "tuning_words").mapInArrow(cells, "cell bigint, n double, p2 double, p1 double")
    rows = chosen.groupBy("cell").agg(F.sum("n"), F.sum("p2"), F.sum("p1")).orderBy("cell").collect()
    out = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    if rows:
        cell, n, p2, p1 = (np.array(c) for c in zip(*rows, strict=True))
        parts = np.stack([p2 / n, p1 / n, np.full(len(n), 1 / (distinct + 1))], axis=1)
        own = cell >> 40
        for _ in range(ITERATIONS):
            share = out[own] * parts
            share *= (n / share.sum(axis=1))[:, None]
            sums = np.stack([np.bincount(own, share[:, k], BUCKETS) for k in range(3)], axis=1)
            sums += 0.01 * out  # a bucket without tokens keeps its weights
            out = sums / sums.sum(axis=1)[:, None]
    out[0] = [0, out[0, 1], out[0, 2]]  # no context, no pair
    return out / out.sum(axis=1)[:, None]


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    Tokens are words with A-Z in lower case, then one end. Training texts are those whose fold (crc32 of the id as text,
    mod 5) isn't 1; an eighth of them tunes the weights. base_score is the add-half unigram model's log10 probability, score
    the interpolated model's. Null and empty texts have one token, the end. Rows with repeated or null ids are texts like
    any other. Without training texts N and V are 0 and all tokens unknown. Other columns are not read."""
    table, (tokens, distinct, tuning_tokens, tuning_distinct) = counted(docs)
    mixed = weights(table, tuning_tokens, tuning_distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            pairs, offsets = _lists(batch, "pair_counts")
            words, _ = _lists(batch, "word_counts")
            context = _contexts(words, offsets)
            own = mixed[bucket(context)]
            p = own[:, 0] * pairs / np.maximum(context, 1) + own[:, 1] * words / max(tokens, 1) + own[:, 2] / (distinct + 1)
            base = np.log10((words + 0.5) / (tokens + 0.5 * (distinct + 1)))
            sums = [np.add.reduceat(v, offsets[:-1]) for v in (words > 0, base, np.log10(np.maximum(p, 1e-300)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("role"), pa.array(np.diff(offsets)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=["doc_id", "role", "n_tokens", "n_known", "base_score", "score"])

    out = table.select("doc_id", "role", "pair_counts", "word_counts").mapInArrow(run, "doc_id bigint, role int, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select("doc_id", (F.col("role") == HELD_OUT).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
