"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes a short vector of transformed statistics.  The training rows give
class counts, sums and outer products (sums that are added up over the cluster, so every
labelled row counts).  Each class covariance is shrunk towards the pooled one and towards
its diagonal; its Cholesky factor is kept, and a score is the logistic of the difference of
the two Gaussian log-densities, whose Mahalanobis terms are solved with the kept factors.

Defined results: a null text counts as empty and gets a score like any other.  Rows with a
null id or label teach nothing.  If a label is given twice for one id, the larger one
counts.  Without labels of both classes every score is the share of label 1 (0.5 if there
are no labels).  Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, doc_slices, held_out, text_bytes
from .words import SPACE

SLICE = 1 << 20

_LOWER, _UPPER, _DIGIT, _SYMBOL, _STOP, _PIPE, _BANG, _HIGH, _BREAK, _BLANK, _OTHER = range(11)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[list(b"#$%&*+=<>@^_~\\/{}[]")] = _SYMBOL
_CLASS[list(b".,;:?-'\"()")] = _STOP
_CLASS[list(b"|")] = _PIPE
_CLASS[list(b"!")] = _BANG
_CLASS[128:] = _HIGH
_CLASS[SPACE] = _BLANK
_CLASS[list(b"\n")] = _BREAK
#: Names of the statistics, in order.
STATISTICS = ("length", "words", "word_length", "upper", "digit", "symbol", "stop", "pipe", "bang", "lines", "line_repeats", "symbol_ends", "runs")


def _line_repeats(data: np.ndarray, offsets: np.ndarray, rows: int) -> np.ndarray:
    """Share of a row's bytes in lines that it had before."""
    out = np.zeros(rows)
    body = data.tobytes()
    for i in range(rows):
        a, b = offsets[i], offsets[i + 1]
        lines = body[a:b].split(b"\n")
        if len(lines) > 1:
            seen: set[bytes] = set()
            again = 0
            for line in lines:
                if line in seen:
                    again += len(line)
                else:
                    seen.add(line)
            out[i] = again / (b - a)
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text: logarithms of sizes, square roots of shares."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(STATISTICS)))
    if not rows:
        return out
    kind = _CLASS[data]
    size = np.diff(offsets).astype(float)

    def total(mask: np.ndarray) -> np.ndarray:
        """Of each row.  A zero behind the data lets an empty row begin at its end."""
        return np.where(size > 0, np.add.reduceat(np.append(mask, False).astype(np.int32), offsets[:-1]), 0)

    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    edge = offsets[:-1][size > 0]
    first[edge] = ~space[edge]
    last = ~space
    last[:-1] &= space[1:]
    last[offsets[1:][size > 0] - 1] = ~space[offsets[1:][size > 0] - 1]
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & ~space[1:]
    same[edge] = False
    words = total(first)
    letters = np.maximum(1, total((kind == _LOWER) | (kind == _UPPER)))
    bytes_ = np.maximum(1, size)
    share = lambda v, whole: np.sqrt(v / whole)
    per_word = np.maximum(1, words)
    out[:, 0] = np.log1p(size)
    out[:, 1] = np.log1p(words)
    out[:, 2] = np.log1p((size - total(space)) / per_word)
    out[:, 3] = share(total(kind == _UPPER), letters)
    for k, c in ((4, _DIGIT), (5, _SYMBOL), (6, _STOP), (7, _PIPE), (8, _BANG)):
        out[:, k] = share(total(kind == c), bytes_)
    out[:, 9] = np.log1p(total(kind == _BREAK) / per_word * 100)
    out[:, 10] = np.sqrt(_line_repeats(data, offsets, rows))
    out[:, 11] = share(total(last & ((kind == _SYMBOL) | (kind == _PIPE) | (kind == _BANG))), per_word)
    out[:, 12] = share(total(same), bytes_)
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in doc_slices(offsets, SLICE):
            found = statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in batch.schema.names if c != "text"), values], [*(c for c in batch.schema.names if c != "text"), "stats"])


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and stats (array of doubles) for each row."""
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_measure, "doc_id long, stats array<double>")


class Discriminant:
    """Two Gaussians with shrunk covariances and their Cholesky factors."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float = 0.15, ridge: float = 1e-3):
        counts = {y: moments[y][0] if y in moments else 0 for y in (0, 1)}
        total = counts[0] + counts[1]
        self.prior = counts[1] / total if total else 0.5
        self.parts = None
        if min(counts.values()) < 2:
            return
        means = {y: moments[y][1] / counts[y] for y in (0, 1)}
        covariances = {y: moments[y][2] / counts[y] - np.outer(means[y], means[y]) for y in (0, 1)}
        pooled = sum(counts[y] * covariances[y] for y in (0, 1)) / total
        scale = np.maximum(np.diag(pooled), 1e-8)
        parts = []
        for y in (0, 1):
            c = (1 - shrink) * covariances[y] + shrink * (0.5 * pooled + 0.5 * np.diag(scale)) + ridge * np.diag(scale)
            factor = np.linalg.cholesky(c)
            parts.append((means[y], np.linalg.inv(factor), -2 * np.log(np.diag(factor)).sum() + 2 * np.log(counts[y] / total)))
        self.parts = parts

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        density = []
        for mean, inverse, constant in self.parts:
            z = (x - mean) @ inverse.T
            density.append(constant - (z * z).sum(axis=1))
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 2, -60, 60)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, sums and outer products of the rows of one partition, a row for each label."""
    kept: dict[int, list] = {}
    for batch in batches:
        y = batch.column("label").to_numpy(zero_copy_only=False)
        x = np.asarray(batch.column("stats").flatten()).reshape(len(y), -1)
        for v in np.unique(y):
            part = x[y == v]
            new = [len(part), part.sum(axis=0), part.T @ part]
            kept[int(v)] = [a + b for a, b in zip(kept[int(v)], new, strict=True)] if int(v) in kept else new
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([k[0] for k in kept.values()], pa.int64()), pa.array([np.concatenate([k[1], k[2].ravel()]).tolist() for k in kept.values()], pa.list_(pa.float64()))], ["label", "n", "sums"])


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", **options) -> Discriminant:
    """From all labelled rows outside the held-out fold.  One row of sums for each label and
    partition is added up on the cluster, and two rows reach the driver."""
    taught = labels.select(F.col("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).filter(~held_out() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    k = len(STATISTICS)
    added = stats.join(taught, "doc_id").select("label", "stats").mapInArrow(_moments, "label int, n long, sums array<double>")
    rows = added.groupBy("label").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(k + k * k)]).alias("sums")).collect()
    found = {}
    for r in rows:
        s = np.array(r["sums"])
        found[r["label"]] = (r["n"], s[:k], s[k:].reshape(k, k))
    return Discriminant(found, **options)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """Adds score to a table of doc_id and stats."""
    shipped = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column("stats").flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shipped.value.scores(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    stats = cut(measured(docs))
    scored = score(stats, fit(stats, labels, label))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns.

    The rows are scored in place: texts aren't moved, and a row needs no unique id."""
    model = fit(cut(measured(docs)), labels, label)
    return docs.filter(scorer(docs.sparkSession, model)(F.col("text").cast("string")) >= threshold)


def scorer(spark, model: Discriminant):
    """The score as a function of a text column."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        parts = [shipped.value.scores(statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in doc_slices(offsets, SLICE)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run
