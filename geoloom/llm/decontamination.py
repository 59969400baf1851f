"""Operator 4, benchmark decontamination: CGK embedding, repeated bit-sampling, exact edit verification.

The random walk of Chakraborty, Goldenberg and Koucky writes a sequence of n words into 3n places: at each place a random
bit of (place, word) says whether to go on to the next word. Walks over two sequences a few edits apart meet again soon
after each edit, so edit distance becomes Hamming distance. Each repetition has a walk of its own and samples some places;
windows of an item's size whose samples agree with the item's in any repetition are candidates, which a word edit distance
then accepts or rejects. Repetitions follow from the recall that is asked for.

Before it is walked, a window must hold as many of the benchmark's three-word runs as one within the allowed edits surely
does (each edit breaks three at most), so nearly all windows of a corpus cost a lookup only and nothing is lost."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm.shared import slices, text_bytes
from geoloom.llm.words import LOWER, hash_spans, mix, shingles, spans

GRAM = 3
#: Bytes of benchmark text that one broadcast may hold; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20
OUT = "doc_id bigint, item_id bigint, start bigint, length bigint, edits int, similarity double"
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,;:!?\"'()[]{}|#*$%&<>-"]] = True
_PAD = np.uint64(0x5851F42D4C957F2D)


def plain_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of words without case (A-Z) and without marks around them; words of marks only are none."""
    offsets, starts, ends = spans(raw, bounds)
    told = np.flatnonzero(~_MARKS[raw])  # what isn't a mark: a word is from its first to its last
    first, last = np.searchsorted(told, starts), np.searchsorted(told, ends)
    kept = first < last
    counts = np.concatenate([[0], np.cumsum(kept)])
    return counts[offsets], hash_spans(LOWER[raw], told[first[kept]], told[last[kept] - 1] + 1)


def edit_distances(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Word edits between each row of a and the first `lengths` words of the row of b."""
    steps = np.arange(b.shape[1] + 1, dtype=np.int32)
    row = np.broadcast_to(steps, (len(a), len(steps)))
    for i in range(a.shape[1]):
        new = np.empty((len(a), len(steps)), np.int32)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i : i + 1]), out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[np.arange(len(a)), lengths]


class Index:
    """A benchmark's items, their three-word runs, and their samples in each repetition."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float, samples: int, least_words: int, seed: int):
        raw, bounds = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        offsets, hashes = plain_words(raw, bounds)
        self.similarity, self.samples, self.seed = similarity, samples, seed
        self.ids, self.items = [], []
        for k, (item, _) in enumerate(items):
            words = hashes[offsets[k] : offsets[k + 1]]
            if len(words) >= least_words:
                self.ids.append(item)
                self.items.append(words)
        sized = {(int(g), len(w)) for w in self.items for g in shingles(np.array([0, len(w)]), w, GRAM)[1]}
        pairs = sorted(sized)
        self.grams = np.array([g for g, _ in pairs], np.uint64)
        self.gram_sizes = np.array([n for _, n in pairs], np.int64)
        # each edit leaves about three differing places of 3n until the walks meet again; 1 - 2 * 3 * edits / 3n is on the safe side
        agree = max(0.05, 1 - 2 * (1 - similarity)) ** samples
        self.repetitions = max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))
        self.by_size = {n: np.array([k for k, w in enumerate(self.items) if len(w) == n]) for n in {len(w) for w in self.items}}
        self.tables = {n: self._table(n, members) for n, members in self.by_size.items()}

    def edits(self, n: int) -> int:
        return int(n * (1 - self.similarity) + 1e-9)

    def sampled(self, n: int) -> np.ndarray:
        """Which places each repetition samples; those past 2n are mostly padding and are left out."""
        rng = np.random.default_rng([self.seed, n])
        out = np.zeros((2 * n, self.repetitions), bool)
        for r in range(self.repetitions):
            out[rng.choice(2 * n, min(self.samples, 2 * n), replace=False), r] = True
        return out

    def samples_of(self, windows: np.ndarray) -> np.ndarray:
        """A hash of the sampled places of each row's walk in each repetition; windows: rows of n words."""
        n = windows.shape[1]
        sampled = self.sampled(n)
        at = np.zeros((len(windows), self.repetitions), np.int64)
        rows = np.arange(len(windows))[:, None]
        repetition = np.arange(1, self.repetitions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out = np.broadcast_to(mix(repetition + np.uint64(n)), at.shape).copy()
        padded = np.concatenate([windows, np.full((len(windows), 1), _PAD)], axis=1)
        for place in range(int(np.flatnonzero(sampled.any(axis=1))[-1]) + 1):
            word = padded[rows, np.minimum(at, n)]
            took = np.flatnonzero(sampled[place])
            if len(took):
                out[:, took] = mix(out[:, took] ^ word[:, took])
            at += (mix(word ^ (repetition + np.uint64(place * 0xD1B54A32D192ED03 & (1 << 64) - 1))) >> np.uint64(63)).astype(np.int64)
        return out

    def _table(self, n: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.samples_of(np.stack([self.items[k] for k in members])).ravel()
        owners = np.repeat(members, self.repetitions)
        order = np.argsort(keys, kind="stable")
        return keys[order], owners[order]

    def windows(self, words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(n, length, starts) of one text's windows that may match items of n words; at, sizes: its three-word runs found in items."""
        for n in map(int, np.unique(sizes)):
            length = min(n, len(words))
            if length < n - self.edits(n):
                continue
            runs = max(1, length - GRAM + 1)
            hits = np.sort(at[sizes == n])
            least = max(1, n - GRAM + 1 - GRAM * self.edits(n))
            if len(hits) < least:
                continue
            low = np.maximum(hits - runs + 1, 0)  # starts whose windows hold the hit
            high = np.minimum(hits, len(words) - length)
            change = np.zeros(len(words) - length + 2, np.int64)
            np.add.at(change, low[low <= high], 1)
            np.add.at(change, high[low <= high] + 1, -1)
            starts = np.flatnonzero(np.cumsum(change)[:-1] >= least)
            if len(starts):
                yield n, length, starts

    def find(self, offsets: np.ndarray, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, length, edits) of the best window of each text and item that match."""
        runs_at, runs = shingles(offsets, words, GRAM)
        first, last = np.searchsorted(self.grams, runs), np.searchsorted(self.grams, runs, "right")
        hit = np.flatnonzero(last > first)
        times = (last - first)[hit]
        place = np.repeat(hit, times)
        which = np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[hit], times)
        text = np.searchsorted(runs_at, place, "right") - 1
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for d, low, high in zip(*np.unique(text, return_index=True), np.append(np.unique(text, return_index=True)[1][1:], len(text)), strict=True) if len(text) else ():
            own = words[offsets[d] : offsets[d + 1]]
            for n, length, starts in self.windows(own, place[low:high] - runs_at[d], self.gram_sizes[which[low:high]]):
                found.setdefault(n, []).append((np.full(len(starts), d), starts, np.full(len(starts), length)))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, parts in found.items():
            d, starts, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
            for low in range(0, len(d), 2048):
                for key, value in self._matches(n, words, offsets, d[low : low + 2048], starts[low : low + 2048], lengths[low : low + 2048]):
                    best[key] = min(best.get(key, value), value)
        return [(d, self.ids[k], start, length, edits) for (d, k), (edits, start, length) in sorted(best.items())]

    def _matches(self, n: int, words: np.ndarray, offsets: np.ndarray, d: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator:
        place = np.arange(n)
        windows = words[np.minimum((offsets[d] + starts)[:, None] + place, len(words) - 1)]
        windows[place >= lengths[:, None]] = _PAD
        keys, owners = self.tables[n]
        sampled = self.samples_of(windows)
        first, last = np.searchsorted(keys, sampled), np.searchsorted(keys, sampled, "right")
        w, _ = np.nonzero(last > first)
        times = (last - first)[last > first]
        which = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[last > first], times)
        pairs = np.unique(np.stack([np.repeat(w, times), owners[which]], axis=1), axis=0)
        for low in range(0, len(pairs), 4096):
            w, k = pairs[low : low + 4096].T
            edits = edit_distances(np.stack([self.items[i] for i in k]), windows[w], lengths[w])
            for i in np.flatnonzero(edits <= self.edits(n)):
                yield (int(d[w[i]]), int(k[i])), (int(edits[i]), int(starts[w[i]]), int(lengths[w[i]]))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in order, BLOCK_BYTES at a time: the driver holds a block and a partition, not the benchmark."""
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null")
    block, held = [], 0
    for item, text in items.orderBy("item_id", "text").toLocalIterator():
        if held + len(text) > BLOCK_BYTES and block:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    yield block


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99, samples: int = 4, least_words: int = 8, seed: int = 11) -> DataFrame:
    """The rows of docs, all columns of theirs, that contaminated tells of no item. Each row is judged by itself, whatever its
    id; all blocks of the benchmark are looked through in one pass over docs, and nothing is shuffled."""
    out = docs
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, similarity, recall, samples, least_words, seed))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, most=4 << 20):
                found = {row[0] for row in shared.value.find(*plain_words(*text_bytes(part.column("text"))))}
                yield part.filter(pa.array([k not in found for k in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.99, samples: int = 4, least_words: int = 8, seed: int = 11) -> DataFrame:
    """One row (OUT) per row of docs and benchmark item that some window of the text is within the allowed edits of.

    Texts count as words without case and surrounding marks. The window has the item's number of words (or is the whole
    text, where that is shorter); start and length count words; of several windows the one of fewest edits is told, the
    first of these. similarity: 1 - edits / words of the item. recall: what one window at that similarity has at least, from
    `samples` sampled places each; overlapping windows and closer matches have more. Items under least_words words, null
    items and null, empty and short texts match nothing. Repeated rows match each; other columns are not read. The
    benchmark goes to the executors in blocks of BLOCK_BYTES at most, each searched for in all texts."""
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = [_search(texts, Index(block, similarity, recall, samples, least_words, seed)) for block in _blocks(benchmark)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(texts: DataFrame, index: Index) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for part in slices(batches, most=4 << 20):
            offsets, words = plain_words(*text_bytes(part.column("text")))
            rows = index.find(offsets, words)
            if rows:
                d, item, start, size, edits = zip(*rows)
                n = {k: len(w) for k, w in zip(index.ids, index.items)}
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(d)), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(edits, pa.int32()),
                    pa.array([1 - e / n[i] for e, i in zip(edits, item)], pa.float64()),
                ], names=[c.split()[0] for c in OUT.split(", ")])

    return texts.mapInArrow(run, OUT)
