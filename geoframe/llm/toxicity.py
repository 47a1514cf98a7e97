"""Toxicity by compression distance.

Two zstandard dictionaries are trained from the labelled rows, one on ordinary and one on toxic
texts.  A text is cut into windows of WINDOW words.  A window is compressed twice, against the
ordinary dictionary and against the same with the toxic one behind it, and its distance is the
bytes that the toxic one saves.  The curve from the numbers of a text's different windows at several
distances to its score is calibrated on the training rows.

Toxic texts are mostly ordinary words, and a dictionary of such a text holds these, too.  So the
toxic one is trained in rounds: dictionaries of each half of the toxic texts are tried on the other
half's words, and those that a dictionary of other texts shortens by some bytes or more, beyond
what the ordinary one does, are the samples of the next round and of the final dictionary, but for
the words that ordinary texts have nearly as often.  The texts are halved in HALVINGS ways, and the
dictionary by which the sample is told best is kept.  The
ordinary one is trained on windows of ordinary texts; words of theirs that the toxic one shortens
by mistake are put behind it.  Lengths alone decide what a text's windows count.

An anchor that both sides hold stands before and after each window, as zstandard stores a frame of
a few bytes without compressing it and looks for no match in a frame's last eight bytes.  Filler
that no text matches takes the toxic dictionary's place on the ordinary side, so that both sides
write equal distances to the ordinary part.

The training sample is bounded: of each class at most SAMPLE rows, the first by a hash of the id,
and of these the first with SAMPLE_BYTES of text in all; a row that would pass that is left out.
All texts are scored whole.

Defined results: a null text counts as empty; an empty text gets the score of a text
without any saving window.  Rows with a null id or label teach nothing.  If a label is
given twice for one id, the larger one counts; if an id has several texts, the first of them by
a hash teaches.  Without labels of both classes every score is the share of label 1 (0 if there
are no labels).  Repeated rows are scored one by one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, held_out

SAMPLE = 4000
SAMPLE_BYTES = 12_000_000
#: Words of a window.
WINDOW = 2
ORDINARY_BYTES, MISTAKEN_BYTES = 16_384, 8_192
HALF_BYTES, TOXIC_BYTES = 4096, 1280
#: Rounds over the two halves of the toxic texts: the bytes that a word must save, and whether the
#: toxic dictionary stands before the ordinary one, where its matches are dearer.
ROUNDS = ((3, True), (3, False), (4, False))
TRAINED_TOGETHER = 8
#: A sample's word is in this many times as large a share of the toxic texts as of the ordinary ones and one more.
CONTRAST = 6
#: Ways to halve the toxic texts; the dictionary that fits the sample best is kept.
HALVINGS = 3
#: Distances whose windows are counted.
LEVELS = (2, 3, 4, 5, 6)
ANCHOR = bytes(range(128, 152))
FILLER = b"\x01"
#: Windows that are compressed in one call.
TOGETHER = 50_000


def windows_of(text: bytes, words: int = WINDOW) -> list[bytes]:
    split = text.lower().split()
    return [b" " + b" ".join(split[i : i + words]) + b" " for i in range(0, len(split), words)]


def _apart(texts: Iterable[bytes]) -> list[bytes]:
    """One text of each group of near copies (texts that share the smallest word hash of one of three orders)."""
    seen: set[tuple[int, int]] = set()
    out = []
    for t in texts:
        words = set(t.lower().split())
        long = [w for w in words if len(w) >= 7] or list(words)
        if not long:
            continue
        marks = [(k, min(zlib.crc32(w, k) for w in long)) for k in (0, 1, 2)]
        if not any(m in seen for m in marks):
            out.append(t)
        seen.update(marks)
    return out


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """Trained on the samples; of too few of them, these themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_dict_id=False, write_checksum=False, strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=4)
    kept = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    kept.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=kept, compression_params=params)


class Sides:
    """The two compressors.  ``first``: the toxic dictionary stands before the ordinary one, where
    it is dearer, so that it is used only for what the ordinary one lacks."""

    def __init__(self, ordinary: bytes, toxic: bytes, first: bool = False):
        filler = FILLER * len(toxic)
        both = [(filler + ordinary, toxic + ordinary), (ordinary + filler, ordinary + toxic)][not first]
        self.sides = [_compressor(b + ANCHOR) for b in both]

    def distances(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic side saves on each window."""
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(windows), TOGETHER):
            part = windows[i : i + TOGETHER]
            sizes = np.fromiter(map(len, part), np.uint64, len(part)) + np.uint64(2 * len(ANCHOR))
            ranges = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype(np.uint64).tobytes()
            body = zstandard.BufferWithSegments(ANCHOR + (ANCHOR + ANCHOR).join(part) + ANCHOR, ranges)
            one, two = (np.fromiter(map(len, c.multi_compress_to_buffer(body)), np.int64, len(part)) for c in self.sides)
            out.append(one - two)
        return np.concatenate(out)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 + 2 * len(LEVELS)))
    _sides: Sides | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_sides": None}

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Of each text: one, and for each level the number and the share of its different windows that reach it, on a log scale."""
        out = np.zeros((len(texts), 1 + 2 * len(LEVELS)))
        out[:, 0] = 1
        if not self.toxic:
            return out
        if self._sides is None:
            self._sides = Sides(self.ordinary, self.toxic)
        windows = [list(dict.fromkeys(windows_of(t))) for t in texts]
        sizes = np.fromiter(map(len, windows), np.int64, len(texts))
        found = self._sides.distances([w for ws in windows for w in ws])
        row = np.repeat(np.arange(len(texts)), sizes)
        for k, level in enumerate(LEVELS):
            hits = np.bincount(row[found >= level], minlength=len(texts))
            out[:, 1 + 2 * k] = np.log1p(hits)
            out[:, 2 + 2 * k] = np.log1p(1000.0 * hits / np.maximum(1, sizes))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _joined(words: list[bytes]) -> list[bytes]:
    """Words as samples of TRAINED_TOGETHER, as a sample of one word is too short to train on."""
    return [b"".join(words[i : i + TRAINED_TOGETHER]) for i in range(0, len(words), TRAINED_TOGETHER)]


def _texts_with(words: set[bytes], texts: list[bytes]) -> Counter[bytes]:
    """In how many texts each of the words is."""
    return Counter(w for t in texts for w in words.intersection(windows_of(t, 1)))


def _telling(ordinary: bytes, texts: list[bytes], others: list[bytes], seed: int) -> list[bytes]:
    """Samples of the words of toxic texts that dictionaries of other toxic texts shorten, each as often as it occurs;
    words that a text of the others has nearly as easily are no samples."""
    order = sorted(texts, key=lambda t: (zlib.crc32(t, seed), t))
    halves = [order[0::2], order[1::2]]
    samples = [[w for t in h for w in windows_of(t)] for h in halves]
    words = [[w for t in h for w in windows_of(t, 1)] for h in halves]
    for saved, first in ROUNDS:
        toxic = [_dictionary(HALF_BYTES, s) for s in samples]
        samples = [[w for w, d in zip(own, Sides(ordinary, other, first).distances(own), strict=True) if d >= saved] for own, other in zip(words, reversed(toxic), strict=True)]
        told, samples = samples, [_joined(s) for s in samples]
    words = {w for s in told for w in s}
    toxic, plain = _texts_with(words, texts), _texts_with(words, others)
    kept = {w for w in words if toxic[w] * len(others) >= CONTRAST * (plain[w] + 1) * len(texts)}
    return [sample for s in told for sample in _joined([w for w in s if w in kept])]


def _mistaken(ordinary: bytes, toxic: bytes, texts: list[bytes]) -> bytes:
    """Words of ordinary texts that the toxic dictionary shortens, the most frequent ones first."""
    sides, least = Sides(ordinary, toxic), LEVELS[0]
    counts: Counter[bytes] = Counter()
    for t in texts:
        windows = windows_of(t)
        counts.update(w for x, d in zip(windows, sides.distances(windows), strict=True) if d >= least for w in windows_of(x, 1))
    words = sorted(counts, key=lambda w: (-counts[w], w))
    return b"".join(w for w, d in zip(words, sides.distances(words), strict=True) if d >= least)[:MISTAKEN_BYTES]


def train(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model:
    """From texts of both classes; ``share`` is the share of toxic rows among all labelled ones."""
    model = Model()
    model.weights[0] = np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)
    bad, good = _apart(toxic), _apart(ordinary)
    if not bad or not good:
        return model
    plain = _dictionary(ORDINARY_BYTES, [w for t in good for w in windows_of(t)])
    # of near copies one counts; the odds are those of the labels
    y = np.r_[np.ones(len(bad)), np.zeros(len(good))]
    weight = np.where(y == 1, share / max(1 - share, 1e-9) * len(good) / len(bad), 1.0)
    weight *= len(y) / weight.sum()
    least = np.inf
    for seed in range(HALVINGS):
        if not (found := _telling(plain, bad, good, seed)):
            continue
        part = _dictionary(TOXIC_BYTES, found)
        trial = Model(plain + _mistaken(plain, part, good), part)
        x = trial.features([*bad, *good])
        trial.weights = _logistic(x, y, weight)
        loss = float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ trial.weights))).sum())
        if loss < least:
            model, least = trial, loss
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Draws the bounded sample and trains on the driver."""
    taught = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("label")).filter(~held_out() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in taught.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    drawn = None
    for y in (0, 1):
        part = taught.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        drawn = part if drawn is None else drawn.union(part)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(drawn), "doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    texts = cut(texts.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k"))
    chosen, used = [], {0: 0, 1: 0}
    for r in texts.select("doc_id", "label", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most 2 * SAMPLE rows of three numbers
        if used[r["label"]] + r["n"] <= SAMPLE_BYTES:
            used[r["label"]] += r["n"]
            chosen.append(r["doc_id"])
    kept = texts.filter(F.col("doc_id").isin(chosen)).collect() if chosen else []
    by = {y: [r["text"].encode() for r in sorted(kept, key=lambda r: r["doc_id"]) if r["label"] == y] for y in (0, 1)}
    return train(by[1], by[0], counts.get(1, 0) / total if total else 0.0)


def scorer(spark, model: Model):
    """The score as a function of a text column."""
    shipped = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(text), 256):
            out.append(shipped.value.scores([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in text.slice(i, 256)]))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs``."""
    run = scorer(docs.sparkSession, fit(docs, labels))
    scored = docs.select(F.col("doc_id"), run(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't call toxic, with all their columns."""
    return docs.filter(scorer(docs.sparkSession, fit(docs, labels))(F.col("text").cast("string")) < threshold)
