"""Operator 7, quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk towards the pooled one and then towards a sphere. A score is the
posterior from the difference of the two log densities, whose Mahalanobis distances come from Cholesky factors that are
computed and inverted once on the driver. How much is shrunk is chosen by cross-validation within the training folds.
Labels, language, source and id are never inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.shared import fold, slices, text_bytes, written
from geoloom.llm.words import hash_spans, shingles, spans

FEATURES = (
    "log_words", "word_length", "upper", "digits", "marks", "symbols", "bangs", "pipes", "not_ascii",
    "new_words", "same_neighbours", "repeated_runs", "short_words", "words_per_line",
)

#: Shares (towards the pooled covariance, towards a sphere) among which cross-validation chooses.
SHRINKAGES = [(pooled, sphere) for pooled in (0.0, 0.1, 0.3, 0.6, 0.9) for sphere in (0.01, 0.05, 0.1, 0.2, 0.4)]
TRAINING = (1, 2, 3, 4)

_CLASSES = np.zeros((256, 6), bool)
_CLASSES[65:91, 0] = True
_CLASSES[48:58, 1] = True
_CLASSES[[ord(c) for c in ".,;:?'\"()-"], 2] = True
_CLASSES[[ord(c) for c in "#*$%&<>"], 3] = True
_CLASSES[ord("!"), 4] = True
_CLASSES[ord("|"), 5] = True


def _logit(share: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of a share of n, smoothed by half a case; finite for n = 0 too."""
    hits = share * n
    return np.log((hits + 0.5) / (n - hits + 0.5))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct hashes of each text (44 bits of each are compared)."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.int64)
    step = 1 << 20
    owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    for at in range(0, len(n), step):  # the owner has 20 bits
        low, high = offsets[at], offsets[min(at + step, len(n))]
        keys = np.sort(((owner[low:high] - np.uint64(at)) << np.uint64(44)) | (hashes[low:high] >> np.uint64(20)))
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        out[at : at + step] = np.bincount((keys[first] >> np.uint64(44)).astype(np.int64), minlength=min(step, len(n) - at))
    return out


def features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of FEATURES, finite for any text."""
    offsets, starts, ends = spans(raw, bounds)
    hashes = hash_spans(raw, starts, ends)
    words, size = np.diff(offsets), np.diff(bounds)
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    in_words = lengths[offsets[1:]] - lengths[offsets[:-1]]
    one, n = np.maximum(words, 1), np.maximum(in_words, 1)
    share = [_sums(_CLASSES[:, k][raw], bounds) / n for k in range(6)]
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[offsets[:-1][offsets[:-1] < len(hashes)]] = False
    runs_at, runs = shingles(offsets, hashes, 3)
    n_runs = np.maximum(np.diff(runs_at), 1)
    lines = _sums(raw == 10, bounds) + 1
    return np.column_stack([
        np.log1p(words), np.log1p(in_words / one), *(_logit(s, n) for s in share), _logit(_sums(raw >= 128, bounds) / n, n),
        _logit(_distinct(offsets, hashes) / one, one), _logit(_sums(same, offsets) / one, one), _logit(1 - _distinct(runs_at, runs) / n_runs, n_runs),
        _logit(_sums(ends - starts <= 3, offsets) / one, one), np.log1p(words / lines),
    ]) * (size >= 0)[:, None]


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and x (array of FEATURES) of each row of docs; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 << 20):
            x = features(*text_bytes(part.column("text")))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], names=["doc_id", "x"])

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, x array<double>")


class Discriminant:
    """Weights of the score: per class mean, inverse of the shrunk covariance's Cholesky factor, and log density offset."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], pooled_share: float, sphere_share: float):
        total = sum(n for n, _, _ in moments.values())
        mean = sum(s for _, s, _ in moments.values()) / total
        spread = np.sqrt(np.maximum(np.diag(sum(q for _, _, q in moments.values()) / total) - mean**2, 0)) + 1e-6
        self.mean, self.spread = mean, spread
        own, means = {}, {}
        for y, (n, s, q) in moments.items():
            means[y] = (s / n - mean) / spread
            own[y] = (q / n - np.outer(s / n, s / n)) / np.outer(spread, spread)
        pooled = sum(moments[y][0] * own[y] for y in own) / total
        self.parts = []
        for y in (0, 1):
            mixed = (1 - pooled_share) * own[y] + pooled_share * pooled
            mixed = (1 - sphere_share) * mixed + sphere_share * np.eye(len(mean)) * max(np.trace(mixed) / len(mean), 1e-6)
            factor = np.linalg.cholesky(mixed)
            self.parts.append((means[y], np.linalg.inv(factor), np.log(moments[y][0] / total) - np.log(np.diag(factor)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        density = [offset - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, offset in self.parts]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


Moments = dict[int, tuple[int, np.ndarray, np.ndarray]]


def moments_of(rows: DataFrame) -> dict[int, Moments]:
    """By fold and class y of all rows (x, y, fold): their number, sums and sums of products. One aggregate; eight rows for the driver."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = F.col("x")
    sums = [F.sum(x[i]) for i in range(d)] + [F.sum(x[i] * x[j]) for i, j in pairs]
    out: dict[int, Moments] = {}
    for row in rows.groupBy("fold", "y").agg(F.count("*").alias("n"), F.array(*sums).alias("s")).collect():
        second = np.zeros((d, d))
        for (i, j), v in zip(pairs, row["s"][d:], strict=True):
            second[i, j] = second[j, i] = v
        out.setdefault(row["fold"], {})[row["y"]] = (row["n"], np.array(row["s"][:d]), second)
    return out


def summed(parts: list[Moments]) -> Moments:
    return {y: tuple(sum(p[y][k] for p in parts if y in p) for k in range(3)) for y in sorted({y for p in parts for y in p})}


def losses(rows: DataFrame, models: dict[int, list[Discriminant]]) -> list[float]:
    """The log loss of each of SHRINKAGES over all rows (x, y, fold), each row scored by models of the other folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(FEATURES))
            y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            total = np.zeros(len(SHRINKAGES))
            for f, own in models.items():
                at = fold == f
                for k, model in enumerate(own):
                    score = np.clip(model.scores(x[at]), 1e-6, 1 - 1e-6)
                    total[k] -= np.log(np.where(y[at] == 1, score, 1 - score)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["k", "loss"])

    told = dict(rows.mapInArrow(run, "k int, loss double").groupBy("k").agg(F.sum("loss")).collect())
    return [told.get(k, 0.0) for k in range(len(SHRINKAGES))]


def fit(rows: DataFrame, shrinkage: tuple[float, float] | None = None) -> Discriminant | None:
    """From all rows (x, y, fold). shrinkage: None for the one of SHRINKAGES with the least cross-validated log loss (the first
    of these; the middle one where a fold leaves a class empty). None without both classes."""
    parts = moments_of(rows)
    whole = summed(list(parts.values()))
    if not {0, 1} <= set(whole):
        return None
    if shrinkage is None:
        rest = {f: summed([p for g, p in parts.items() if g != f]) for f in parts}
        shrinkage = SHRINKAGES[len(SHRINKAGES) // 2]
        if len(parts) > 1 and all({0, 1} <= set(m) for m in rest.values()):
            loss = losses(rows, {f: [Discriminant(m, *s) for s in SHRINKAGES] for f, m in rest.items()})
            shrinkage = SHRINKAGES[int(np.argmin(np.round(loss, 6)))]
    return Discriminant(whole, *shrinkage)


def learned(table: DataFrame, labels: DataFrame) -> Discriminant | None:
    """The model of the rows of table (doc_id, x) that have a label and aren't held out."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    number = fold(F.col("doc_id")).cast("int")
    return fit(written(table.where(number.isin(*TRAINING)).join(known, "doc_id").select("x", "y", number.alias("fold"))))


def passable(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns of theirs, that classify doesn't reject. Each row is judged by its text, whatever its id;
    statistics are shuffled, texts aren't; they are computed twice, to learn and to score."""
    model = learned(document_features(docs), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2 << 20):
            kept = model.scores(features(*text_bytes(part.column("text")))) >= threshold if model else np.ones(part.num_rows, bool)
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row of docs.

    labels: doc_id, quality. Rows whose fold (crc32 of the id as text, mod 5) is 0 are held out: never learned from. A
    doc_id with several labels counts by the lowest; null labels and ids are not learned from. Without labels of both
    classes every score is 1. Null and empty texts have statistics and so a score; repeated rows are scored each."""
    table = written(document_features(docs))
    model = learned(table, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(FEATURES))
            score = model.scores(x) if model else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
