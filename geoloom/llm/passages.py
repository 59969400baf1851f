"""Operator 10, substring dedup: compact windows of min-hashed texts, joined across hashes, then verified.

A text is a sequence of five-word shingles. Under one hash all its subsequences of `least` shingles or more fall into a few
compact windows (l, c, r), about 2n / least: those that lie within l to r and hold c have c's hash as their min-hash. The
windows are the nodes of the Cartesian tree over the hashes. Subsequences of two texts share a min-hash just if a window of
each has that value, so a repeated passage gives equal values under every hash, a near copy under most.

A five-word run is no passage, so windows are joined across hashes: a meeting point is where the windows of two hashes share
a run of `least` shingles that holds both their least shingles, and its key is both values. Two passages of similarity 0.8
agree under two hashes of HASHES with a probability of 0.97, in each run of theirs that is as similar.

Texts of one key are first paired with their neighbours in the order of texts, and pairs that follow one another under two
keys are verified on their whole texts: all equal runs are found, those a little apart are joined, and passages long and
similar enough are told. A meeting point within such a passage is settled, in the class of its
text. Then texts of a key are compared in blocks, by what stands around their meeting points. Where one isn't settled in the
others' class, FORESTS spanning forests of the pairs with most in common are verified too: each text's best partners are in
them, and there are as many pairs as texts. Where a block had more, all its pairs across classes with enough in common are then
verified in other blocks, once each, which send links, not pairs. So no link between classes is lost once texts meet; of a text
that its class holds already, a further passage is missed if all partners in the forests fail for it. Keys with
the same texts are compared once. Keys that many texts have are dealt to several tasks, by ranges of the order of texts, and
the ends of these ranges meet again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.components import components, extended
from geoloom.llm.minhash import Frequencies, _whole, frequencies
from geoloom.llm.shared import dealt, partitions_for, slices, tasks_for, text_bytes, written
from geoloom.llm.words import mix, shingles, word_hashes
from geoloom.llm.words import spans as word_spans

SIZE = 5
HASHES = 4
PAIRS = list(combinations(range(HASHES), 2))
#: Keys under which two texts must follow one another to be verified in the first round; the others have theirs in later ones.
FIRST_KEYS = 2
#: A key that more than this share of the texts may have is dealt to several tasks.
SHARE = 0.005
#: Shingles that edits within a passage may break at a place.
GAP = 12
#: Texts of a key that meet in a task at a time in later rounds, and spanning forests of the pairs there that the second round verifies.
CHUNK, FORESTS = 256, 4
#: Texts are verified for a meeting point if a run of `least` shingles with its place shares this much of them: with two words changed.
COMMON = 0.78
#: Such runs are tried at each so many shingles, and half as many may be missing then.
STEP = 4
COLUMNS = 4096
_SIDES, _PLACES = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int64)  # of two-byte numbers, for in_common
_SALT = np.random.default_rng(10_1925).integers(0, 1 << 64, HASHES, dtype=np.uint64)
_POINT = np.dtype([("key", "<i8"), ("node", "<i8"), ("place", "<i4"), ("salt", "<i2")])
_SPAN = "a bigint, b bigint, a_start bigint, a_length bigint, b_start bigint, b_length bigint, similarity double"


def compact_windows(values: np.ndarray, least: int, distinct: bool = False) -> list[tuple[int, int, int]]:
    """(l, c, r), both ends included, of the Cartesian tree's nodes of `least` positions or more. Of equal least values the
    one in the middle is taken; distinct: there are no equal values."""
    out, todo = [], [(0, len(values) - 1)] if len(values) >= least else []
    while todo:
        low, high = todo.pop()
        own = values[low : high + 1]
        c = int(own.argmin())
        if not distinct:
            same = own == own[c]
            if np.count_nonzero(same) > 1:
                ties = np.flatnonzero(same)
                c = int(ties[np.abs(ties - len(own) // 2).argmin()])
        c += low
        out.append((low, c, high))
        if c - low >= least:
            todo.append((low, c - 1))
        if high - c >= least:
            todo.append((c + 1, high))
    return out


def text_runs(column: pa.Array) -> list[np.ndarray]:
    """The shingles of each text in order."""
    offsets, runs = shingles(*word_hashes(*text_bytes(column)), SIZE)
    return [runs[low:high] for low, high in zip(offsets[:-1], offsets[1:], strict=True)]


def salts(node: np.ndarray, split: np.ndarray) -> np.ndarray:
    """0 where split is 0, else 1 + the node's range of 2^split in the order of nodes; a range of more splits lies in one of fewer."""
    split = np.minimum(split, 8)
    place = node.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.where(split > 0, 1 + (place >> (64 - np.maximum(split, 1)).astype(np.uint64)).astype(np.int64), 0)


def octaves(runs: np.ndarray, often: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """log2(share / SHARE) of each shingle, 0 where it is seldom. often, shares: the frequent shingles, ascending, and the
    share of texts that have them."""
    octave = np.zeros(len(runs), np.uint64)
    if len(often):
        low = np.uint64((1 << 20) - 1)
        some = np.zeros(1 << 20, bool)  # most shingles are told to be seldom by 20 bits
        some[often & low] = True
        hit = np.flatnonzero(some[runs & low])
        at = np.minimum(np.searchsorted(often, runs[hit]), len(often) - 1)
        own = often[at] == runs[hit]
        octave[hit[own]] = np.clip(np.ceil(np.log2(shares[at[own]] / SHARE)), 0, 15).astype(np.uint64)
    return octave


def ranked(runs: np.ndarray, k: int, often: np.ndarray, shares: np.ndarray, octave: np.ndarray | None = None) -> np.ndarray:
    """The value of each shingle under hash k: 60 bits of rank, then four of its octave, which is the same under all hashes."""
    octave = octaves(runs, often, shares) if octave is None else octave
    return mix(runs ^ _SALT[k]) >> np.uint64(4) << np.uint64(4) | octave


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row, by doubling."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - n + width], values[n - width :]) if width < n else values


def meeting_points(offsets: np.ndarray, runs: np.ndarray, least: int, often: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, place, split) where windows of two hashes share a run of `least` shingles with both their least ones.

    The nodes of a text's Cartesian tree under a hash that span `least` positions or more are the least values of its runs of
    `least` positions; so runs with equal least values under both hashes are one meeting point. Its place is the middle of
    what the first of these that follow one another have in common, so a passage that meets there holds the place."""
    n = np.diff(offsets)
    if len(runs) < least or (n < least).all():
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    octave = octaves(runs, often, shares)
    lows = [least_of(ranked(runs, k, often, shares, octave), least) for k in range(HASHES)]
    text = np.repeat(np.arange(len(n)), n)[: len(lows[0])]
    start = np.arange(len(text)) - offsets[text]
    whole = start + least <= n[text]  # runs within one text
    turns = []
    for low in lows:
        turn = np.ones(len(text), bool)
        turn[1:] = low[1:] != low[:-1]
        turns.append(turn | (start == 0))
    out = []
    for number, (i, j) in enumerate(PAIRS):
        turn = turns[i] | turns[j]
        at = np.flatnonzero(whole & turn)
        key = mix(lows[i][at] ^ mix(lows[j][at] + np.uint64(number + 1)))
        end = np.flatnonzero(turn | ~whole)  # where other runs begin, or none are left
        last = np.append(end, len(text))[np.searchsorted(end, at, "right")] - 1
        place = start[at] + (last - at + least - 1) // 2
        _, first = np.unique(key + mix(text[at].astype(np.uint64)), return_index=True)
        at, key, place = at[first], key[first], place[first]
        out.append((key, text[at], place, np.minimum(lows[i][at] & np.uint64(15), lows[j][at] & np.uint64(15)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def meetings(texts: DataFrame, weighted: Frequencies, least: int) -> DataFrame:
    """part and points: the meeting points (_POINT) of some texts, packed; all points of a key and salt (0: its key is in one
    task) are in one part. Rows of some thousands of points cost a small part of what a row for each point does."""
    shared = texts.sparkSession.sparkContext.broadcast((weighted.keys, weighted.counts / weighted.texts))
    parts = partitions_for(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            offsets, runs = shingles(*word_hashes(*text_bytes(batch.column("text"))), SIZE)
            key, text, place, split = meeting_points(offsets, runs, least, *shared.value)
            points = np.zeros(len(key), _POINT)
            points["key"], points["node"], points["place"] = key.view(np.int64), batch.column("node").to_numpy()[text], place
            points["salt"] = salts(points["node"], split)
            part = (_dealt_by(points) % np.uint64(parts)).astype(np.int64)
            points = points[np.argsort(part, kind="stable")]
            edges = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            some = np.flatnonzero(np.diff(edges))
            packed = [points[edges[k] : edges[k + 1]].tobytes() for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(packed, pa.binary())], names=["part", "points"])

    return texts.select("node", "text").mapInArrow(run, "part bigint, points binary").repartition(parts, "part").sortWithinPartitions("part")


def fewest_distinct(own: np.ndarray, least: int) -> np.ndarray:
    """How many distinct shingles each run of `least` of a text holds. A shingle counts where it stands for the first time in the run."""
    order = np.argsort(own, kind="stable")
    again = own[order[1:]] == own[order[:-1]]
    starts = np.arange(len(own)) - least
    starts[order[1:][again]] = np.maximum(starts[order[1:][again]], order[:-1][again])  # the last run before those in which it counts
    turns = np.bincount(np.maximum(starts + 1, 0), minlength=len(own) + 1) - np.bincount(np.arange(len(own)) + 1, minlength=len(own) + 1)
    return np.cumsum(turns)[: max(0, len(own) - least + 1)]


def _first_apart(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers a and b, equally long, have equal from the start on."""
    if not len(a):
        return 0
    differs = a != b
    at = int(differs.argmax())
    return at if differs[at] else len(a)


def _extended(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """How many shingles before and from (i, j) on are equal in a and b."""
    n, m = min(len(a) - i, len(b) - j), min(i, j)
    return _first_apart(a[i - m : i][::-1], b[j - m : j][::-1]), _first_apart(a[i : i + n], b[j : j + n])


def _aligned(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs, and all equal runs that follow one another, within GAP, from those with a shingle that stands once in a and in b."""

    def single(v: np.ndarray) -> np.ndarray:
        _, at, n = np.unique(v, return_inverse=True, return_counts=True)
        return np.concatenate([[0], np.cumsum(n[at] == 1)])

    in_a, in_b = single(a), single(b)
    found: dict[int, set[tuple[int, int, int]]] = {}  # by diagonal
    for run in runs:
        found.setdefault(run[0] - run[1], set()).add(run)
    todo = [(s, t, n) for s, t, n in runs if in_a[s + n] > in_a[s] and in_b[t + n] > in_b[t]]
    while todo:
        s, t, n = todo.pop()
        for i, j, back in ((s + n, t + n, False), (s, t, True)):  # shingles from the run's end on, and before its start
            if back:
                u, v = a[max(0, i - GAP - 1) : i][::-1], b[max(0, j - GAP - 1) : j][::-1]
            else:
                u, v = a[i : i + GAP + 1], b[j : j + GAP + 1]
            if not len(u) or not len(v):
                continue
            equal = u[:, None] == v[None, :]
            equal[1:, 1:] &= ~equal[:-1, :-1]  # one of each run
            for p, q in np.argwhere(equal).tolist():
                p, q = (i - 1 - p, j - 1 - q) if back else (i + p, j + q)
                own = found.setdefault(p - q, set())
                if not any(f <= p < f + m for f, _, m in own):
                    before, after = _extended(a, b, p, q)
                    run = (p - before, q - before, before + after)
                    own.add(run)
                    todo.append(run)
    return sorted(set().union(*found.values()))


def _chains(runs: tuple[np.ndarray, np.ndarray, np.ndarray], region: tuple[int, int, int, int], least: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """Where joined runs (region) have too many edits: the longest parts of it, from a run to a later one, that have few
    enough, as many equal shingles as the similarity asks for of both sides. runs: begin in a, begin in b, shingles."""
    begin, begin2, wide = runs
    low, high, low2, high2 = region
    within = (low <= begin) & (begin + wide <= high) & (low2 <= begin2) & (begin2 + wide <= high2)
    if wide[within].sum() < 2 * least * similarity / (1 + similarity):
        return []
    equal = np.concatenate([[0], np.cumsum(wide[within])])
    if equal[-1] >= similarity * (high - low + high2 - low2 - equal[-1]):
        return []
    out = []
    s, t, n = (c[within] for c in runs)
    for i in range(len(s) - 1):
        size, size2, same = (s + n)[i + 1 :] - s[i], (t + n)[i + 1 :] - t[i], equal[i + 2 :] - equal[i]
        good = np.flatnonzero((np.minimum(size, size2) >= least) & (same >= similarity * (size + size2 - same)))
        if len(good):
            j = int(good[-1])
            out.append((int(s[i]), int(s[i] + size[j]), int(t[i]), int(t[i] + size2[j])))
    return out


def _runs(a: np.ndarray, b: np.ndarray, repeated: bool = True) -> set[tuple[int, int, int]]:
    """(start in a, start in b, shingles) of the equal runs, as long as they go, in which some shingle stands for the first time
    in one of the texts. a, b: numbers from 0 on in place of the shingles. repeated: some stand more than once in a text."""
    first = np.full(max(a.max(), b.max()) + 1, -1)
    first[a[::-1]] = np.arange(len(a))[::-1]
    j = np.flatnonzero(first[b] >= 0)
    i = first[b[j]]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    if not repeated:
        at = np.flatnonzero(new)
        return set(zip(i[at].tolist(), j[at].tolist(), np.diff(np.append(at, len(i))).tolist(), strict=True))
    out: set[tuple[int, int, int]] = set()
    known: dict[int, int] = {}  # by diagonal, the end of the last run
    for p, q in zip(i[new].tolist(), j[new].tolist(), strict=True):
        if known.get(p - q, -1) <= q:
            before, after = _extended(a, b, p, q)
            out.add((p - before, q - before, before + after))
            known[p - q] = q + after
    return out


def _outer(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs that don't lie, in both texts, within a longer one, as those of a line that both repeat do."""
    if len(runs) < 8:
        return runs
    s, t, n = (np.array(c) for c in zip(*runs, strict=True))
    inner = np.zeros(len(runs), bool)
    for low in range(0, len(runs), 256):
        k = slice(low, low + 256)
        within = (s <= s[k, None]) & (t <= t[k, None]) & (s + n >= (s + n)[k, None]) & (t + n >= (t + n)[k, None]) & (n > n[k, None])
        inner[k] = within.any(axis=1)
    return [run for run, gone in zip(runs, inner.tolist(), strict=True) if not gone]


def shared_passages(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(start, shingles) in a and in b, and the Jaccard similarity, of passages of `least` shingles and more that both share:
    long ones first, and of the others those that hold shingles of a or b that none before holds.

    All equal runs of the texts' shingles are found, those a little apart are joined, and parts of them judged. Where shingles
    repeat, each occurrence in one text is matched with the first in the other, and equal runs next to these with each other."""
    if min(len(a), len(b)) < least:
        return []
    if len(a) == len(b) and (a == b).all():
        return [(0, len(a), 0, len(b), 1.0)]
    values, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = number[: len(a)], number[len(a) :]
    times = np.bincount(a, minlength=len(values)), np.bincount(b, minlength=len(values))
    repeated = max(n.max() for n in times) > 1
    # both passages hold a run of `least` shingles, and what they share is the similarity's part of either at least
    asked = max(fewest_distinct(own, least).min() for own in (a, b)) if repeated else least
    if np.count_nonzero((times[0] > 0) & (times[1] > 0)) < similarity * asked - 1e-9:
        return []
    runs = sorted(_runs(a, b, repeated))
    if repeated:
        runs = _outer(sorted(set(runs) | {(i, j, n) for j, i, n in _runs(b, a)}))
        runs = _outer(_aligned(a, b, runs))
    joined: list[list[int]] = []  # start and end in a, start and end in b
    open_ones: list[list[int]] = []
    for s, t, n in runs:
        open_ones = [x for x in open_ones if s - x[1] <= GAP]  # starts ascend, so others are over
        for x in open_ones:
            if -n <= s - x[1] <= GAP and -n <= t - x[3] <= GAP and s >= x[0] and t >= x[2] and abs((s - x[1]) - (t - x[3])) <= GAP:
                x[1], x[3] = max(x[1], s + n), max(x[3], t + n)
                break
        else:
            open_ones.append([s, s + n, t, t + n])
            joined.append(open_ones[-1])
    kept: list[tuple[int, int, int, int, float]] = []
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)

    def judge(parts: Iterable[tuple[int, int, int, int]]) -> None:
        for s, s2, t, t2 in sorted((x for x in parts if min(x[1] - x[0], x[3] - x[2]) >= least), key=lambda x: (-min(x[1] - x[0], x[3] - x[2]), x)):
            if in_a[s:s2].all() and in_b[t:t2].all():
                continue
            held = np.zeros((2, len(values)), bool)
            held[0, a[s:s2]] = held[1, b[t:t2]] = True
            both = np.count_nonzero(held[0] & held[1])
            same = both / (np.count_nonzero(held) - both)
            if same >= similarity:
                kept.append((s, s2 - s, t, t2 - t, same))
                in_a[s:s2] = in_b[t:t2] = True

    whole = {tuple(x) for x in joined}
    judge(whole | {(s, s + n, t, t + n) for s, t, n in runs})
    columns = tuple(np.array(runs, np.int64).reshape(-1, 3).T)
    for x in sorted(whole):
        if min(x[1] - x[0], x[3] - x[2]) >= least and not (in_a[x[0] : x[1]].all() and in_b[x[2] : x[3]].all()):
            judge(_chains(columns, x, least, similarity))
    return sorted(kept)


def _dealt_by(points: np.ndarray) -> np.ndarray:
    """One number of 64 bits for the key and salt of each of points (_POINT)."""
    return mix(points["key"].view(np.uint64) + mix(points["salt"].astype(np.uint64)))


def _shared(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct nodes of each key and salt that several nodes have or that is dealt, the bounds of the keys); points: _POINT."""
    group = _dealt_by(points)
    order = np.argsort(group)
    new = np.ones(len(group), bool)
    new[1:] = group[order[1:]] != group[order[:-1]]
    alone = new & np.append(new[1:], True)
    order = order[~alone | (points["salt"][order] > 0)]  # most keys are of one text
    points, group = points[order], group[order]
    order = np.lexsort((points["node"], group))
    points, group = points[order], group[order]
    first = np.ones(len(group), bool)
    first[1:] = (group[1:] != group[:-1]) | (points["node"][1:] != points["node"][:-1])
    points, group = points[first], group[first]
    return points, np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]) if len(group) else np.zeros(1, np.int64)


def _found(points: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of met for whole keys; points: _POINT."""
    points, bounds = _shared(points)
    if not len(points):
        return
    key, salt, node, place = (np.ascontiguousarray(points[c]) for c in ("key", "salt", "node", "place"))
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    marks = mix(node.view(np.uint64))
    sets = np.bitwise_xor.reduceat(marks, bounds[:-1]) + size.astype(np.uint64)
    sets = np.where(salt > 0, key, sets[owner].view(np.int64))
    told = np.flatnonzero((size > 1)[owner] | (salt > 0))
    _, once = np.unique(mix(sets[told].view(np.uint64)) + marks[told], return_index=True)
    told = told[once]
    yield _kind(len(told), set=sets[told], salt=salt[told], a=node[told], place=place[told])
    after = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    if len(after):
        _, once, n = np.unique(marks[after] * np.uint64(3) + marks[after - 1], return_index=True, return_counts=True)
        yield _kind(len(once), a=node[after[once] - 1], b=node[after[once]], n=n)
    ends = np.unique(np.concatenate([bounds[:-1], bounds[1:] - 1]))
    ends = ends[salt[ends] > 0]
    if len(ends):
        yield _kind(len(ends), set=key[ends], a=node[ends], place=place[ends], end=np.ones(len(ends), bool))


def met(points: DataFrame) -> DataFrame:
    """What tasks find in keys of two texts and more, in rows of three kinds, each distinct within some thousands of keys:

    (set, salt, a, place) for a text a of a set of texts that a key has (a dealt key is a set of its own); (a, b, n) for texts
    that follow one another, under n keys; and (set, a, place, end = true) for the first and last text of a dealt key's range.
    points: key, salt, node, place; or as meetings packs them."""
    kinds = ", ".join(f"{c} {t}" for c, t in _MET.items())

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole(batches, ("part",)):
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                yield from _found(np.frombuffer(b"".join(table["points"].slice(low, high - low).to_pylist()), _POINT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in _whole(batches, ("key", "salt")):
            rows = np.zeros(table.num_rows, _POINT)
            for c in _POINT.names:
                rows[c] = table[c].to_numpy()
            yield from _found(rows)

    if "part" in points.columns:
        return points.mapInArrow(packed, kinds)
    dealt = points.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").select("key", "salt", "node", "place")
    return dealt.mapInArrow(run, kinds)


_MET = {"set": "bigint", "salt": "smallint", "a": "bigint", "b": "bigint", "place": "int", "n": "bigint", "end": "boolean"}
_ARROW = {"bigint": pa.int64(), "smallint": pa.int16(), "int": pa.int32(), "boolean": pa.bool_()}


def _kind(rows: int, **columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _ARROW[t]) if c in columns else pa.nulls(rows, _ARROW[t]) for c, t in _MET.items()], names=list(_MET))


def candidates(found: DataFrame) -> DataFrame:
    """Distinct pairs (a, b; a < b) of texts to verify first. found: rows of met."""
    ends = found.where("end").select(F.col("set").alias("key"), F.lit(0).cast("smallint").alias("salt"), F.col("a").alias("node"), "place")
    pairs = found.where("b is not null").unionByName(met(ends).where("b is not null"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= FIRST_KEYS).select("a", "b")


def surroundings(members: DataFrame, texts: DataFrame, parts: int, least: int) -> DataFrame:
    """set, node, label, near (two bytes of each shingle that is in a run of `least` with the place) and held (distinct shingles that
    any such run holds) of members (set, node, place, label). texts: node, text, dealt by node in so many parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, near, held = [], [], []
            points = batch.column("points")
            bounds = points.offsets.to_numpy()
            sets, places, labels = (points.values.field(c).slice(bounds[0], bounds[-1] - bounds[0]) for c in ("set", "place", "label"))
            place = places.to_pylist()
            bounds = (bounds - bounds[0]).tolist()
            for k, (node, own) in enumerate(zip(batch.column("node").to_pylist(), text_runs(batch.column("text")), strict=True)):
                fewest, short = fewest_distinct(own, least), (own & np.uint64(0xFFFF)).astype("<u2").tobytes()
                for at in place[bounds[k] : bounds[k + 1]]:
                    low = max(0, at - least + 1)
                    near.append(short[2 * low : 2 * (at + least)])
                    held.append(int(fewest[low : at + 1].min()))
                nodes += [node] * (bounds[k + 1] - bounds[k])
            yield pa.RecordBatch.from_arrays([sets, pa.array(nodes, pa.int64()), labels, pa.array(near, pa.binary()), pa.array(held, pa.int32())], names=["set", "node", "label", "near", "held"])

    points = members.repartition(parts, "node").groupBy("node").agg(F.collect_list(F.struct("set", "place", "label")).alias("points"))
    both = texts.join(points.hint("shuffle_hash"), "node").select("node", "text", "points")
    return both.mapInArrow(run, "set bigint, node bigint, label bigint, near binary, held int").coalesce(few(parts))


def few(parts: int) -> int:
    """Tasks that go through so many parts, some each: a file of a few kB takes as long to open as to read."""
    return max(1, parts // 4)


def in_common(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """How many distinct two-byte numbers each of x shares with each of y."""
    sides = []
    for own in (x, y):
        number = np.frombuffer(b"".join(own), "<u2")
        sides.append((number, np.repeat(np.arange(len(own)), [len(v) // 2 for v in own])))
    (of_x, _), (of_y, _) = sides
    _SIDES[of_x] = 1
    shared = np.unique(of_y[_SIDES[of_y] == 1])  # numbers of one side only count for no pair
    _SIDES[of_x] = 0
    if len(x) == len(y) == 1:
        return np.full((1, 1), len(shared), np.float32)
    _SIDES[shared] = 1
    _PLACES[shared] = np.arange(len(shared))
    sides = [(_PLACES[number[here]], owner[here]) for number, owner in sides for here in [_SIDES[number] == 1]]
    _SIDES[shared] = 0
    out = np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(shared), COLUMNS):
        wide = min(COLUMNS, len(shared) - low)
        held = []
        for own, (at, owner) in zip((x, y), sides, strict=True):
            here = slice(None) if wide == len(shared) else (at >= low) & (at < low + wide)
            held.append(np.zeros((len(own), wide), np.float32))
            held[-1][owner[here], at[here] - low] = 1
        out += held[0] @ held[1].T
    return out


def asked_of(held: np.ndarray) -> np.ndarray:
    """How many shingles must be in common where a passage holds so many distinct ones."""
    return np.maximum(COMMON * held - STEP // 2, 1)


def alike(x: list[bytes], y: list[bytes], held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a run of `least` numbers of each of x has enough in common with each of y, the most that such runs have).
    Runs begin at each STEP numbers and at the last place; held: the distinct numbers that a passage of each of y holds."""
    good, most = np.zeros((len(x), len(y)), bool), np.zeros((len(x), len(y)), np.float32)
    for low in range(0, len(x), 64):
        cuts, distinct, bounds = [], [], [0]
        for own in x[low : low + 64]:
            last = max(0, len(own) // 2 - least)
            starts = [*range(0, last, STEP), last]
            cuts += [own[2 * k : 2 * (k + least)] for k in starts]
            distinct.append(fewest_distinct(np.frombuffer(own, "<u2"), least)[starts])
            bounds.append(len(cuts))
        common = in_common(cuts, y)
        enough = common >= asked_of(np.maximum(np.concatenate(distinct)[:, None], held[None, :]))
        good[low : low + 64] = np.logical_or.reduceat(enough, bounds[:-1])
        most[low : low + 64] = np.maximum.reduceat(common * enough, bounds[:-1])
    return good, most


def blocks(members: DataFrame) -> DataFrame:
    """set, block, side (1, 2 or both), node, label, near and held of members (set, node, label, near, held), sorted by block.

    Each text outside a set's most frequent label meets all texts of the set, in blocks of about CHUNK by CHUNK; a set of CHUNK
    texts and fewer is one block, to which each text goes once."""
    sizes = members.groupBy("set", "label").agg(F.count("*").alias("n"))
    split = sizes.groupBy("set").agg(F.max_by("label", F.struct("n", "label")).alias("large"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    rows = members.join(split.select("set", "large", "all", F.ceil(F.col("all") / CHUNK).alias("across"), F.ceil(F.col("rest") / CHUNK).alias("down")), "set")
    at = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    down, across = (F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1) for c in ("down", "across"))
    # side 1: outside the most frequent label; 2: all; 3: both, in the only block
    whole = F.transform(down, lambda k: F.struct((k * F.col("across") + at("across", 1)).alias("block"), F.lit(2).alias("side")))
    outside = F.transform(across, lambda k: F.struct((at("down", 2) * F.col("across") + k).alias("block"), F.lit(1).alias("side")))
    only = F.array(F.struct(F.lit(0).cast("bigint").alias("block"), F.when(F.col("label") != F.col("large"), 3).otherwise(2).alias("side")))
    many = F.when(F.col("label") != F.col("large"), F.concat(whole, outside)).otherwise(whole)
    placed = rows.select("set", "node", "label", "near", "held", F.explode(F.when(F.col("all") <= CHUNK, only).otherwise(many)).alias("at")).select("set", "at.block", "at.side", "node", "label", "near", "held")
    return placed.repartition(tasks_for(members, 6000), "set", "block").sortWithinPartitions("set", "block")


def good_pairs(x: np.ndarray, y: np.ndarray, labels: np.ndarray, held: np.ndarray, near: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of different labels with enough in common, once each, those with most in common first. x, y: of a block."""
    none = np.zeros(0, np.int64)
    asked = asked_of(np.maximum(held[x][:, None], held[y][None, :]))
    other = labels[x][:, None] != labels[y][None, :]
    common = in_common([near[i] for i in x.tolist()], [near[i] for i in y.tolist()])
    good = (common >= asked) & other  # only what has enough in all can have it in a run
    up, left = good.any(axis=1), good.any(axis=0)
    if not up.any():
        return none, none
    x, y, other = x[up], y[left], other[up][:, left]
    good, common = alike([near[i] for i in x.tolist()], [near[i] for i in y.tolist()], held[y], least)
    i, j = np.nonzero(good & other)
    order = np.lexsort((y[j], x[i], -common[i, j]))
    i, j = x[i][order], y[j][order]
    _, once = np.unique(np.minimum(i, j) * (len(near) + 1) + np.maximum(i, j), return_index=True)
    once.sort()
    return i[once], j[once]


def forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs (x, y) of numbers under n, best first, make a spanning forest of best pairs, by Boruvka's rounds."""
    root, kept, left = np.arange(n), np.zeros(len(x), bool), np.arange(len(x))
    while True:
        left = left[root[x[left]] != root[y[left]]]
        if not len(left):
            return kept
        ends = np.concatenate([root[x[left]], root[y[left]]])
        tree, first = np.unique(ends, return_index=True)  # the first of the left ones on either side
        best = np.full(n, len(x))
        best[tree] = left[first % len(left)]
        low = np.full(n, len(x))
        again, first = np.unique(ends[len(left) :], return_index=True)
        low[again] = left[first]
        chosen = np.unique(np.minimum(best, low)[tree])
        kept[chosen] = True
        goes = dict(zip(tree.tolist(), tree.tolist(), strict=True))

        def end(r: int, goes: dict = goes) -> int:
            while goes[r] != r:
                goes[r] = r = goes[goes[r]]
            return r

        for i in chosen.tolist():
            goes[end(int(root[x[i]]))] = end(int(root[y[i]]))
        to = np.arange(n)
        to[tree] = [end(r) for r in tree.tolist()]
        root = to[root]


def forests(x: np.ndarray, y: np.ndarray, n: int, most: int) -> np.ndarray:
    """Which of the pairs, best first, are in one of `most` spanning forests: each is of what those before leave."""
    left = np.arange(len(x))
    kept = np.zeros(len(x), bool)
    for _ in range(most):
        if not len(left):
            break
        own = forest(x[left], y[left], n)
        kept[left[own]] = True
        left = left[~own]
    return kept


def apart(members: DataFrame, most: int, least: int) -> DataFrame:
    """Pairs (a, b; a < b) of one set's texts of different labels with enough in common: `most` spanning forests of the labels in
    each block, each of the pairs with most in common that those before leave, so rows grow with the members, not with their
    pairs; and a row (set, null) where a block has more of them. members: set, node, label, near, held.

    Two passages that hold their places hold as many distinct shingles as either `held`, so what they share goes by the larger."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole(batches, ("set", "block")):
            names, labels, held, side, near = table["node"].to_numpy(), table["label"].to_numpy(), table["held"].to_numpy(), table["side"].to_numpy(), table["near"].to_pylist()
            sets, out = table["set"].to_numpy(), set()
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x, y = low + np.flatnonzero(side[low:high] & 1), low + np.flatnonzero(side[low:high] & 2)
                if not len(x) or not len(y):
                    continue
                i, j = good_pairs(x, y, labels, held, near, least)
                if not len(i):
                    continue
                _, number = np.unique(labels[low:high], return_inverse=True)
                kept = forests(number[i - low], number[j - low], high - low, most)
                if not kept.all():
                    out.add((int(sets[low]), None))
                i, j = names[i[kept]], names[j[kept]]
                out.update(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return blocks(members).mapInArrow(run, "a bigint, b bigint").distinct()


def untried(members: DataFrame, tried: DataFrame, least: int) -> DataFrame:
    """node, label, partners: each text of the sets with its partners there, of other labels and with enough in common, that tried
    (a, b) doesn't hold; once, however many sets both are in. members: set, node, label, near, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole(batches, ("set", "block")):
            names, labels, held, side, near = table["node"].to_numpy(), table["label"].to_numpy(), table["held"].to_numpy(), table["side"].to_numpy(), table["near"].to_pylist()
            pairs = [np.zeros((2, 0), np.int64)]
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                x, y = low + np.flatnonzero(side[low:high] & 1), low + np.flatnonzero(side[low:high] & 2)
                if len(x) and len(y):
                    pairs.append(np.stack(good_pairs(x, y, labels, held, near, least)))
            i, j = np.concatenate(pairs, axis=1)
            i, j = np.concatenate([i, j]), np.concatenate([j, i])
            order = np.lexsort((names[j], names[i]))
            i, j = i[order], j[order]
            new = np.ones(len(i), bool)
            new[1:] = (names[i[1:]] != names[i[:-1]]) | (names[j[1:]] != names[j[:-1]])
            i, j = i[new], j[new]
            node, first = np.unique(names[i], return_index=True)
            partners = pa.ListArray.from_arrays(pa.array(np.append(first, len(i)), pa.int32()), pa.array(names[j], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(labels[i[first]], pa.int64()), partners], names=["node", "label", "partners"])

    found = blocks(members).mapInArrow(run, "node bigint, label bigint, partners array<bigint>")
    found = found.groupBy("node").agg(F.first("label").alias("label"), F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))
    both = tried.select(F.col("a").alias("node"), "b").unionByName(tried.select(F.col("b").alias("node"), F.col("a").alias("b")))
    known = both.groupBy("node").agg(F.collect_list("b").alias("known"))  # of all texts, for found must not be made twice
    rest = F.when(F.col("known").isNull(), F.col("partners")).otherwise(F.array_except("partners", "known"))
    return found.join(known, "node", "left").select("node", "label", rest.alias("partners")).where(F.size("partners") > 0)


def crossing(left: DataFrame, texts: DataFrame, parts: int, least: int, similarity: float) -> DataFrame:
    """The passages (_SPAN) of pairs of texts and partners, as many as link all labels that any such pair links: all are verified,
    in blocks, but those whose labels are linked there already. So passages leave the task, not pairs.
    left: rows of untried, as written. texts: node, text, dealt by node in so many parts."""
    rows, links = left.agg(F.count("*"), F.sum(F.size("partners"))).first()
    across = max(1, -(-rows // (CHUNK // 2)))
    names = [c.split()[0] for c in _SPAN.split(", ")]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lambda v: (mix(v.astype(np.int64).view(np.uint64)) % np.uint64(across)).astype(np.int64)
        for batch in batches:
            partners = batch.column("partners")
            bounds = partners.offsets.to_numpy()
            other = partners.values.to_numpy()[bounds[0] : bounds[-1]]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            own, to = of(batch.column("node").to_numpy())[owner], of(other)
            block = np.minimum(own, to) * across + np.maximum(own, to)
            order = np.lexsort((block, owner))
            other, owner, block = other[order], owner[order], block[order]
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(other)), pa.int32()), pa.array(other, pa.int64()))
            own = pa.array(owner[first])
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), batch.column("node").take(own), batch.column("label").take(own), lists], names=["block", "node", "label", "partners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole(batches, ("block",)):
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = table.slice(low, high - low).combine_chunks()
                node, label, partners = (own[c].to_pylist() for c in ("node", "label", "partners"))
                runs = dict(zip(node, text_runs(own["text"]), strict=True))
                of = dict(zip(node, label, strict=True))
                goes = {x: x for x in label}

                def end(r: int, goes: dict = goes) -> int:
                    while goes[r] != r:
                        goes[r] = r = goes[goes[r]]
                    return r

                out = []
                for a, others in zip(node, partners, strict=True):
                    for b in others:
                        if a < b and end(of[a]) != end(of[b]):
                            found = shared_passages(runs[a], runs[b], least, similarity)
                            if found:
                                goes[end(of[a])] = end(of[b])
                                out += [(a, b, s, n + SIZE - 1, t, m + SIZE - 1, same) for s, n, t, m, same in found]
                if out:
                    *spans, same = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(s, pa.int64()) for s in spans), pa.array(same, pa.float64())], names=names)

    tasks = max(1, min(10_000, (links or 0) // 4000))
    lists = left.mapInArrow(placed, "block bigint, node bigint, label bigint, partners array<bigint>")
    return texts.join(lists.repartition(parts, "node"), "node").coalesce(few(parts)).repartition(tasks, "block").sortWithinPartitions("block").select("block", "node", "label", "partners", "text").mapInArrow(run, _SPAN)


def verified(pairs: DataFrame, texts: DataFrame, parts: int, least: int, similarity: float) -> DataFrame:
    """The passages (_SPAN) that the texts of each pair (a, b) share. texts: node, text, dealt by node in so many parts, so only the
    text of a is shuffled, once for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SPAN.split(", ")]
        for batch in (two for one in slices(batches, "ta", 2 << 20) for two in slices(iter([one]), "tb", 2 << 20)):
            a, b = (batch.column(c).to_pylist() for c in "ab")
            first = {n: ("ta", i) for i, n in enumerate(a)} | {n: ("tb", i) for i, n in enumerate(b)}  # each text once
            known: dict[int, np.ndarray] = {}
            for side in ("ta", "tb"):
                own = {n: i for n, (c, i) in first.items() if c == side}
                column = batch.column(side).take(pa.array(own.values(), pa.int64()))
                known |= dict(zip(own, text_runs(column), strict=True))
            rows = []
            for k in range(batch.num_rows):
                found = shared_passages(known[a[k]], known[b[k]], least, similarity)
                rows += [(a[k], b[k], s, n + SIZE - 1, t, m + SIZE - 1, same) for s, n, t, m, same in found]
            if rows:
                *spans, same = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(s, pa.int64()) for s in spans), pa.array(same, pa.float64())], names=names)

    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    first = of("a").join(pairs.repartition(parts, "a").hint("shuffle_hash"), "a").coalesce(few(parts))
    both = first.repartition(parts, "b").join(of("b").hint("shuffle_hash"), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, _SPAN).coalesce(few(parts))


def shared_spans(texts: DataFrame, least: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(passages (_SPAN) of pairs of texts, as many as link all texts that share one; (node, root) of those). texts: node, text."""
    found = written(met(meetings(texts, frequencies(texts, exact=False), least)))  # for dealing keys only
    members = written(found.where("set is not null and end is null").groupBy(F.col("set"), F.col("a").alias("node")).agg(F.min("place").alias("place")))
    tried = written(candidates(found))
    parts = partitions_for(texts)
    own = texts.repartition(parts, "node").join(members.select("node").repartition(parts, "node"), "node", "left_semi")
    own = dealt(own.dropDuplicates(["node"]), "node", parts)
    spans = written(verified(tried, own, parts, least, similarity))
    root = components(spans.select("a", "b"))
    for again in (False, True):
        sides = [spans.select(F.col(x).alias("node"), F.struct(F.col(f"{x}_start").alias("start"), F.col(f"{x}_length").alias("length")).alias("s")) for x in "ab"]
        told = sides[0].unionByName(sides[1]).groupBy("node").agg(F.collect_set("s").alias("spans")).join(root, "node")
        inside = F.exists("spans", lambda s: (s["start"] <= F.col("place")) & (F.col("place") < s["start"] + s["length"] - SIZE + 1))
        some = members.join(more, "set", "left_semi") if again else members
        label = F.when(inside | F.lit(again), F.coalesce("root", "node")).otherwise(F.bitwise_not("node"))  # no class's label
        labelled = written(some.join(told, "node", "left").select("set", "node", "place", label.alias("label")))
        several = labelled.groupBy("set").agg((F.min("label") != F.max("label")).alias("several")).where("several").select("set")
        left = labelled.join(several, "set")
        if again:
            left = written(left.select("set", "node", "label").join(near.drop("label"), ["set", "node"]))
            rest = written(untried(left, tried, least))
            new = written(crossing(rest, own, parts, least, similarity))
        else:
            near = written(surroundings(left, own, parts, least))
            out = written(apart(near, FORESTS, least))
            fresh = written(out.where("b is not null").join(tried, ["a", "b"], "left_anti"))
            tried = tried.unionByName(fresh)
            more = out.where("b is null").select(F.col("a").alias("set"))
            new = written(verified(fresh, own, parts, least, similarity))
        if not new.isEmpty():
            spans, root = spans.unionByName(new), extended(root, new)
        # labels of the second round part no pair that these didn't, so nothing is untried if no block had more
        if more.isEmpty():
            break
    return spans, root


def repeated_passages(docs: DataFrame, least_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """One row per passage of a row of docs that another row has too: doc_id, start and length (words), other_id,
    other_start, similarity (Jaccard, of five-word shingles), class_id (the lowest doc_id among the rows that passages link).

    A passage has least_words words or more. Copies aren't expanded into all pairs: of the rows that hold one passage of a
    row one is told as the other, and a passage within a longer one of its row isn't told. A pair is found if it has a meeting point in common: at a similarity of 0.8 with a
    probability of about 0.97 or more, exact passages always. Null, empty and short texts have none. Rows equal in id and text
    are one document; passages that repeat in one document only don't count. Texts are told apart by 64 bits of a hash. Null
    ids are kept; other columns are not read."""
    least = least_words - SIZE + 1
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))
    spans, root = shared_spans(texts.select("node", "text"), least, similarity)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = np.diff(word_spans(*text_bytes(batch.column("text")))[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(words, pa.int64())], names=["doc_id", "node", "length"])

    # of all texts where they are read: copies aren't known yet, and finding them would shuffle the texts
    ids = written(texts.mapInArrow(lengths, "doc_id bigint, node bigint, length bigint").distinct())
    nodes = written(ids.groupBy("node").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"), F.max("length").alias("length")))
    ids = ids.drop("length")
    whole = nodes.where((F.col("n") > 1) & (F.col("length") >= least_words))
    copies = whole.select("node", F.lit(0).cast("bigint").alias("start"), "length", F.col("node").alias("other"), F.lit(0).cast("bigint").alias("other_start"), F.lit(1.0).alias("similarity"))
    sides = [spans.select(F.col(x).alias("node"), F.col(f"{x}_start").alias("start"), F.col(f"{x}_length").alias("length"), F.col(y).alias("other"), F.col(f"{y}_start").alias("other_start"), "similarity") for x, y in ("ab", "ba")]
    named = nodes.select(F.col("node").alias("other"), "first", "last")
    told = sides[0].unionByName(sides[1]).unionByName(copies).join(named, "other")
    told = told.groupBy("node", "start", "length").agg(F.min(F.struct((F.col("other") == F.col("node")).alias("same"), F.col("first"), F.col("last"), "other_start", "similarity")).alias("o"))
    before = Window.partitionBy("node").orderBy("start", F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("start") + F.col("length")).over(before), F.lit(0))
    told = written(told.withColumn("reached", reached).where(F.col("start") + F.col("length") > F.col("reached")).drop("reached"))
    rooted = told.select("node").distinct().join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(nodes.select("node", "first"), "node")
    classes = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("class_id")), "root").select("node", "class_id")
    out = told.join(classes, "node").join(ids, "node")
    # of copies the first names the last, all others the first
    other = F.when(F.col("o.same") & F.col("doc_id").eqNullSafe(F.col("o.first")), F.when(F.col("o.last") != F.col("o.first"), F.col("o.last"))).otherwise(F.col("o.first"))
    return out.select("doc_id", "start", "length", other.alias("other_id"), F.col("o.other_start").alias("other_start"), F.col("o.similarity").alias("similarity"), "class_id")
