"""Operator 5, near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Equal texts are one node, by their MD5. A node's shingles (five words) weigh (1 + ln tf) * idf. Ioffe's sampling draws one
shingle and one weight level per hash such that two texts agree with a probability of their weighted Jaccard similarity.
ROWS hashes make a band; nodes equal in a band are a bucket. A bucket doesn't emit its pairs: similarities estimated from
all hashes give it a maximum spanning forest and each node's two nearest, and those pairs are verified first, by the weighted
Jaccard similarity of the whole texts. Large buckets go to tasks in chunks, whose representatives meet again. As estimates
err and a representative's links aren't its tree's, members of a bucket whom verified links have not in one class are then all
compared across classes, in blocks, exactly: there a product of sparse matrices gives the similarities of thousands of pairs
at once, and links leave the task, not pairs. The verified links' connected components are the classes.

idf is 1 + ln(N / max(df, f N)) / ln(1 / f), between 1 and 2, with f = FREQUENT: only shingles in more than that share of the
texts count less. There are at most 1 / f times the mean text's shingles of these, whatever the corpus, so they can be
broadcast; a pass that keeps what is frequent in some part of the corpus finds them, and another counts them exactly."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.components import components
from geoloom.llm.shared import slices, text_bytes, written
from geoloom.llm.words import mix, shingles, word_hashes

SIZE = 5
BANDS, ROWS = 16, 3
FREQUENT = 0.01
#: Frequent shingles that a broadcast may hold; for longer texts the share FREQUENT goes up instead.
MOST_FREQUENT = 2_000_000
CHUNK = 256
#: Bytes of text that one side of a block holds at most, but for one text.
BLOCK_BYTES = 16 << 20
COLUMNS = 4096
#: Pairs of a lower estimate (of 48 hashes) aren't verified: two texts of similarity 0.8 have one with a probability under 1e-6.
LEAST_ESTIMATE = 0.5
ROUNDING = 1e-9
_HELD = 1 << 22

_rng = np.random.default_rng(8_1912)
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_SALT = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)[:, None]
_LOW = np.uint64(0xFFFF)


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, node (MD5 of the text; null counts as empty) and text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("node"), text.alias("text"))


def text_shingles(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct shingles ascending, how often each) of each text."""
    offsets, runs = shingles(*word_hashes(*text_bytes(batch.column(column))), SIZE)
    for low, high in zip(offsets[:-1], offsets[1:], strict=True):
        own = np.sort(runs[low:high])
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        yield own[first], np.diff(np.append(first, len(own)))


def _summed(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _counts(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])


class Frequencies:
    """Texts of the corpus, and the document frequencies of the frequent shingles; weights follow."""

    def __init__(self, texts: int, share: float, keys: np.ndarray, counts: np.ndarray):
        self.texts, self.share, self.keys, self.counts = max(texts, 1), share, keys, counts
        rare = self._idf(np.array([1.0]))[0]
        self.idf, self.rare = np.append(self._idf(counts), rare).astype(np.float32), rare

    def _idf(self, counts: np.ndarray) -> np.ndarray:
        return 1 + np.log(self.texts / np.clip(counts, self.share * self.texts, self.texts)) / math.log(1 / self.share)

    def weights(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return (1 + np.log(times)) * self.idf[np.where(known, at, len(self.keys))]


def frequencies(texts: DataFrame, share: float = FREQUENT, exact: bool = True) -> Frequencies:
    """From all texts, copies included. Two passes over the texts; what goes to the driver has a bound of MOST_FREQUENT keys.
    Not exact: one pass, by counts that are low by a quarter of the share at most."""

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, n, total = [], 0, 0, 0

        def part() -> pa.RecordBatch:
            own, counts = _summed(keys)
            often = counts > slack * n
            return _counts(own[often], counts[often])

        for batch in slices(batches):
            for own, _ in text_shingles(batch):
                keys.append(own)
                held, n, total = held + len(own), n + 1, total + len(own)
            if held >= _HELD:
                yield part()
                keys, held, n = [], 0, 0
        if keys:
            yield part()

    size = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    n, mean = size[0], (size[1] or 0) / max(size[0], 1) / 2  # a text has at most half as many words as characters, and one
    share = min(0.5, max(share, (mean + 1) / MOST_FREQUENT))
    slack = share / 4  # a shingle loses less than this share of all texts to the parts where it isn't frequent
    likely = texts.select("text").mapInArrow(suspected, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= 0.75 * share * n)
    if not exact:
        return _frequencies(n, share, likely)
    wanted = np.sort(np.array([r[0] for r in likely.select("key").toLocalIterator()], np.int64).view(np.uint64))
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        counts = np.zeros(len(wanted) + 1, np.int64)
        for batch in slices(batches):
            for own, _ in text_shingles(batch) if len(wanted) else ():
                at = np.searchsorted(wanted, own)
                counts[at[wanted[np.minimum(at, len(wanted) - 1)] == own]] += 1
        some = np.flatnonzero(counts)
        if len(some):
            yield _counts(wanted[some], counts[some])

    counts_of = texts.select("text").mapInArrow(counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > share * n)
    return _frequencies(n, share, counts_of)


def _frequencies(n: int, share: float, found: DataFrame) -> Frequencies:
    rows = sorted((k & ((1 << 64) - 1), c) for k, c in found.toLocalIterator())
    return Frequencies(n, share, np.array([k for k, _ in rows], np.uint64), np.array([c for _, c in rows], np.float64))


def signature(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One 64-bit sample per hash; equal with a probability of the weighted Jaccard similarity."""
    best = np.full(len(_SALT), np.inf, np.float32)
    out = np.zeros(len(_SALT), np.uint64)
    rows = np.arange(len(_SALT))
    for low in range(0, len(keys), 1 << 14):
        some = keys[low : low + (1 << 14)]
        drawn = mix(some[None, :] ^ _SALT)
        r = _R[(drawn & _LOW).astype(np.int64)]
        shift = ((drawn >> np.uint64(16)) & _LOW).astype(np.float32) / np.float32(1 << 16)
        level = np.floor(np.log(weights[low : low + (1 << 14)]).astype(np.float32)[None, :] / r + shift)
        log_a = _LOG_C[((drawn >> np.uint64(32)) & _LOW).astype(np.int64)] - r * (level - shift + 1)
        at = log_a.argmin(axis=1)
        value = log_a[rows, at]
        better = value < best
        best[better] = value[better]
        out[better] = mix(some[at[better]] + mix(level[rows, at].astype(np.int64).view(np.uint64)[better]))
    return out


def bands_of(sampled: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in sampled.reshape(BANDS, ROWS).T:
        out = mix(out ^ row)
    return out


def signatures(texts: DataFrame, weighted: Frequencies) -> DataFrame:
    """doc_id, node, bands (64-bit keys), sketch (two bytes per hash) and size (bytes of text) of each row; no bands where there are no words."""
    shared = texts.sparkSession.sparkContext.broadcast(weighted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bands, sketches = [], []
            for keys, times in text_shingles(batch):
                sampled = signature(keys, shared.value.weights(keys, times)) if len(keys) else np.zeros(0, np.uint64)
                bands.append(bands_of(sampled).view(np.int64) if len(keys) else np.zeros(0, np.int64))
                sketches.append((sampled & _LOW).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(np.diff(text_bytes(batch.column("text"))[1]))], names=["doc_id", "node", "bands", "sketch", "size"])

    return texts.mapInArrow(run, "doc_id bigint, node binary, bands array<bigint>, sketch binary, size bigint")


def _forest(sketches: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs to verify among a bucket's members, and one representative of each tree, its best connected member."""
    n = len(sketches)
    near = np.zeros((n, n), np.float32)
    for h in range(sketches.shape[1]):
        near += sketches[:, h][:, None] == sketches[:, h][None, :]
    near /= sketches.shape[1]
    np.fill_diagonal(near, -1)
    pairs, tree = set(), np.full(n, -1)
    far, source = np.full(n, -1.0), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    for step in range(n):
        at = int(np.where(left, far, -2).argmax())
        if far[at] >= LEAST_ESTIMATE:
            pairs.add((min(at, int(source[at])), max(at, int(source[at]))))
            tree[at] = tree[source[at]]
        else:
            tree[at] = step
        left[at] = False
        nearer = near[at] > far
        far[nearer], source[nearer] = near[at][nearer], at
    if n > 2:
        for i, two in enumerate(np.argsort(-near, axis=1, kind="stable")[:, :2]):
            pairs |= {(min(i, int(j)), max(i, int(j))) for j in two if near[i, j] >= LEAST_ESTIMATE}
    total = np.where(near >= LEAST_ESTIMATE, near, 0).sum(axis=1)
    return sorted(pairs), [int(members[total[members].argmax()]) for members in (np.flatnonzero(tree == t) for t in np.unique(tree))]


_MET = "key bigint, a binary, b binary, sketch binary"


def _whole(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows that hold whole groups (equal in names), and the bounds of the groups in each."""

    def differs(table: pa.Table) -> np.ndarray:
        columns = [table[n].to_numpy() for n in names]
        return np.any([c[1:] != c[:-1] for c in columns], axis=0)

    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        edges = np.flatnonzero(differs(table)) + 1
        if len(edges):
            yield table.slice(0, edges[-1]), np.concatenate([[0], edges])
        rest = table.slice(edges[-1] if len(edges) else 0)
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _met(members: DataFrame) -> DataFrame:
    """Of each (key, chunk) of members: pairs to verify (a, b), and representatives (key, a, sketch; b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole(batches, ("key", "chunk")):
            keys, names, sketches = table["key"].to_numpy(), table["node"].to_pylist(), table["sketch"].to_pylist()
            out: list[tuple] = []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                own = sorted({names[i]: sketches[i] for i in range(low, high)}.items())
                key = int(keys[low])
                pairs, first = _forest(np.frombuffer(b"".join(s for _, s in own), "<u2").reshape(len(own), -1))
                out += [(key, own[i][0], own[j][0], None) for i, j in pairs]
                out += [(key, own[i][0], None, own[i][1]) for i in first]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "a", "b", "sketch"])

    dealt = members.select("key", "chunk", "node", "sketch").repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    return dealt.mapInArrow(run, _MET)


def met_members(signed: DataFrame) -> DataFrame:
    """key, node, sketch, bands, size and m (members) of the buckets of two nodes and more. signed: node, bands, sketch, size, a row for each node."""
    keyed = signed.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return written(keyed.join(shared, "key").join(signed.select("node", "sketch", "bands", "size"), "node"))


def candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes to verify first: those that link most of a bucket's members. members: those of met_members."""
    pairs, level, before = None, 0, None
    while True:
        level += 1
        rows = members.count()
        if before is not None and (not rows or 2 * rows > before):  # nothing joins any more; crossing compares the rest
            return pairs.distinct()
        out = written(_met(members.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("m") / CHUNK)))))
        new = out.where("b is not null").select("a", "b")
        pairs = new if pairs is None else pairs.unionByName(new)
        large = members.where(F.col("m") > CHUNK).select("key").distinct()
        first = out.where("b is null").select("key", F.col("a").alias("node"), "sketch").join(large, "key", "left_semi")
        counts = first.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        members = written(first.join(counts, "key").join(members.select("key", "node", "bands", "size"), ["key", "node"]))
        before = rows


def apart(members: DataFrame, root: DataFrame) -> DataFrame:
    """Rows (key, block, node, outside, root) of members of one bucket whom root (node, root) has in several classes.

    Each member outside a bucket's largest class meets all its members, in blocks of about CHUNK by CHUNK nodes or BLOCK_BYTES
    by BLOCK_BYTES of text. A block keeps who has a partner of another class and an estimate of LEAST_ESTIMATE and more whom
    it doesn't meet in an earlier band."""
    rooted = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted)
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    split = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("large"), F.sum("n").alias("all"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("n", "root", "bytes")).alias("most")).where("all > most.n")
    parts = lambda n, size: F.greatest(F.ceil(n / CHUNK), F.ceil(size / BLOCK_BYTES))
    split = split.select("key", "large", parts(F.col("all"), F.col("all_bytes")).alias("across"), parts(F.col("all") - F.col("most.n"), F.col("all_bytes") - F.col("most.bytes")).alias("down"))
    rows = rooted.join(split, "key")
    at = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    whole = rows.withColumn("other", each("down")).withColumn("block", F.col("other") * F.col("across") + at("across", 1)).withColumn("outside", F.lit(False))
    outside = rows.where("root != large").withColumn("other", each("across")).withColumn("block", at("down", 2) * F.col("across") + F.col("other")).withColumn("outside", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole(batches, ("key", "block")):
            sketches, outer, keys = table["sketch"].to_pylist(), table["outside"].to_numpy(), table["key"].to_numpy()
            bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, BANDS)
            _, known = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)
            kept = np.zeros(table.num_rows, bool)
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                own = np.arange(low, high)
                x, y = own[outer[low:high]], own[~outer[low:high]]
                if not len(x) or not len(y):
                    continue
                sx, sy = (np.frombuffer(b"".join(sketches[i] for i in side), "<u2").reshape(len(side), -1) for side in (x, y))
                near = np.zeros((len(x), len(y)), np.float32)
                for h in range(sx.shape[1]):
                    near += sx[:, h][:, None] == sy[:, h][None, :]
                good = (near >= LEAST_ESTIMATE * sx.shape[1]) & (known[x][:, None] != known[y][None, :])
                for band in range(int(np.flatnonzero(bands[x[0]] == keys[low])[0]) if good.any() else 0):
                    good &= bands[x, band][:, None] != bands[y, band][None, :]
                kept[x[good.any(axis=1)]] = True
                kept[y[good.any(axis=0)]] = True
            yield from table.select(["key", "block", "node", "outside", "root"]).filter(pa.array(kept)).to_batches()

    dealt = whole.unionByName(outside).select("key", "block", "node", "sketch", "bands", "root", "outside").repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(run, "key bigint, block bigint, node binary, outside boolean, root binary")


def similarities(x: list[tuple], y: list[tuple], weighted: Frequencies) -> np.ndarray:
    """Weighted Jaccard similarities of each text's (shingles, times) in x to each in y.

    The n-th occurrence of a shingle is a feature of its own, of the weight that the n-th adds; so what two texts share is a
    product of matrices, taken COLUMNS features at a time, whatever the texts' length."""
    owner = np.repeat(np.arange(len(x) + len(y)), [int(times.sum()) for _, times in (*x, *y)])
    keys = np.concatenate([np.repeat(k, times) for k, times in (*x, *y)])
    counts = np.concatenate([times for _, times in (*x, *y)])
    nth = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    weight = weighted.weights(keys, np.ones(1)).astype(np.float64) * np.where(nth > 1, np.log(nth / np.maximum(nth - 1, 1)), 1)
    total = np.bincount(owner, weight, len(x) + len(y))
    feature = mix(keys + mix(nth.astype(np.uint64)))
    order = np.argsort(feature, kind="stable")
    feature, owner, weight = feature[order], owner[order], weight[order]
    column = np.cumsum(np.concatenate([[0], feature[1:] != feature[:-1]])) if len(feature) else np.zeros(0, np.int64)
    left = owner < len(x)
    n = column[-1] + 1 if len(column) else 0
    both = (np.bincount(column, left, n) > 0) & (np.bincount(column, ~left, n) > 0)
    kept = both[column]
    column, owner, weight, left = (np.cumsum(both) - 1)[column][kept], owner[kept], weight[kept], left[kept]
    common = np.zeros((len(x), len(y)))
    for low in range(0, int(both.sum()), COLUMNS):
        start, end = np.searchsorted(column, [low, low + COLUMNS])
        some, who, w, side = column[start:end] - low, owner[start:end], weight[start:end], left[start:end]
        a, b = np.zeros((len(x), COLUMNS)), np.zeros((len(y), COLUMNS))
        a[who[side], some[side]] = w[side]
        b[who[~side] - len(x), some[~side]] = 1
        common += a @ b.T
    return common / np.maximum(total[: len(x), None] + total[None, len(x) :] - common, 1e-9)


def crossing(left: DataFrame, texts: DataFrame, weighted: Frequencies, least: float) -> DataFrame:
    """Links (a, b) between classes, as many as join all that a link joins within a block. left: rows of apart. texts: node, text."""
    shared = texts.sparkSession.sparkContext.broadcast(weighted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in _whole(batches, ("key", "block")):
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                own = table.slice(low, high - low).combine_chunks().to_batches()[0]
                outer = own.column("outside").to_numpy(zero_copy_only=False)
                names, roots = own.column("node").to_pylist(), own.column("root").to_pylist()
                x, y = np.flatnonzero(outer), np.flatnonzero(~outer)
                if not len(x) or not len(y):
                    continue
                told = list(text_shingles(own))
                near = similarities([told[i] for i in x], [told[i] for i in y], shared.value)
                goes = {r: r for r in roots}

                def end(r: bytes, goes: dict = goes) -> bytes:
                    while goes[r] != r:
                        goes[r] = r = goes[goes[r]]
                    return r

                out = []
                for i, j in zip(*np.nonzero(near >= least - ROUNDING), strict=True):
                    a, b = end(roots[x[i]]), end(roots[y[j]])
                    if a != b:
                        goes[a] = b
                        out.append((names[x[i]], names[y[j]]))
                if out:
                    a, b = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return left.join(texts, "node").repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, "a binary, b binary")


def classes(members: DataFrame, texts_of: Callable[[DataFrame], DataFrame], weighted: Frequencies, least: float) -> DataFrame:
    """(node, root) of the nodes that verified pairs of one bucket link, over others too. texts_of: nodes to (node, text) of them.

    First the pairs of candidates are verified; then, where members of a bucket are in several classes, all pairs of such
    members that a class doesn't hold already."""
    pairs = written(candidates(members))
    links = written(verified(pairs, texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), weighted, least))
    root = components(links)
    left = written(apart(members, root))
    if left.isEmpty():
        return root
    more = written(crossing(left, texts_of(left.select("node")), weighted, least))
    return root if more.isEmpty() else components(links.unionByName(more))


def similarity(a: tuple, b: tuple, weighted: Frequencies) -> float:
    """Weighted Jaccard similarity of two texts' (shingles, times)."""
    wa, wb = weighted.weights(*a), weighted.weights(*b)
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum()
    return float(low / max(wa.sum() + wb.sum() - low, 1e-9))


def verified(pairs: DataFrame, texts: DataFrame, weighted: Frequencies, least: float) -> DataFrame:
    """The pairs (a, b) whose whole texts have that similarity. texts: node, text of theirs."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    shared = texts.sparkSession.sparkContext.broadcast(weighted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "ta", 1 << 20):
            for batch in slices(iter([part]), "tb", 1 << 20):
                same = [similarity(x, y, shared.value) >= least - ROUNDING for x, y in zip(text_shingles(batch, "ta"), text_shingles(batch, "tb"), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, class_id, class_size, keep and text_md5 of each row of docs.

    A class holds all rows whose texts are equal or linked, over other texts too, by a weighted Jaccard similarity of at
    least `least`; class_id is its lowest doc_id (null if all are null) and class_size counts its rows. keep marks one text of the
    rows of class_id's value: one row of a class, unless rows repeat in both doc_id and text. Null texts count as empty. Texts without words are linked to equal texts only; one of fewer than
    five words has one shingle, of all of them. Rows with one doc_id and other texts are rows like any other. Other columns
    are not read. No rows, no result. LSH finds a link at 0.8 with a probability over 0.9999."""
    texts = nodes(docs)
    weighted = frequencies(texts)
    rows = written(signatures(texts, weighted))
    signed = written(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("size").alias("size")))

    def texts_of(named: DataFrame) -> DataFrame:
        wanted = named.distinct().join(signed.select("node", "first"), "node").select(F.col("node").alias("n"), "first")
        own = texts.join(wanted, (texts["node"] == wanted["n"]) & texts["doc_id"].eqNullSafe(wanted["first"]), "left_semi")
        return written(own.select("node", "text").dropDuplicates(["node"]))

    root = classes(met_members(signed), texts_of, weighted, least)
    rooted = signed.select("node", "first", "copies").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("kept")
    sizes = rooted.groupBy("root").agg(lowest, F.sum("copies").alias("class_size"))
    of_node = rooted.select("node", "root").join(sizes, "root").select("node", F.col("kept.first").alias("class_id"), "class_size", (F.col("node") == F.col("kept.node")).alias("kept"))
    out = rows.select("doc_id", "node").join(of_node, "node")
    return out.select("doc_id", "class_id", "class_size", (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("keep"), F.col("node").alias("text_md5"))
