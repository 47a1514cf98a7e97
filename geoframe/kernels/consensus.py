"""Models that most rows agree with, by random samples."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np

MANY = 10**9
#: Samples that are drawn and scored together; fewer than the first SMALL are drawn at first.
BATCH, SMALL = 64, 16


def draws_needed(share: float, size: int, confidence: float) -> int:
    """Draws until one holds inliers only, with the given confidence; 1 to 1e9."""
    if share >= 1:
        return 1
    clean = share**size if share > 0 else 0.0
    if clean <= 0 or math.log1p(-clean) == 0:
        return MANY
    return int(min(MANY, math.ceil(math.log1p(-confidence) / math.log1p(-clean))))


def samples(n: int, size: int, count: int, rng: np.random.Generator) -> np.ndarray:
    """``count`` samples of distinct rows, (count, size)."""
    if size * size < n:  # repeats are rare: draw again where there is one
        out = rng.integers(0, n, (count, size))
        while len(again := np.flatnonzero((np.diff(np.sort(out, axis=1), axis=1) == 0).any(axis=1))):
            out[again] = rng.integers(0, n, (len(again), size))
        return out
    return np.argsort(rng.random((count, n)), axis=1)[:, :size]


def improved(model: Any, error: Callable[[Any], np.ndarray], refit: Callable[[np.ndarray, Any], Any], threshold: float, rounds: int) -> tuple[Any, np.ndarray]:
    """The best of ``model`` and the models that come of fitting again and again to the inliers; the latest of equals."""
    chain = [(model, error(model) < threshold)]
    for _ in range(rounds):
        last, inside = chain[-1]
        new = refit(np.flatnonzero(inside), last)
        if new is None:
            break
        chain.append((new, error(new) < threshold))
        if np.array_equal(chain[-1][1], inside):
            break
    return max(reversed(chain), key=lambda c: int(c[1].sum()))


def consensus(
    n: int,
    size: int,
    fit: Callable[[np.ndarray], Any],
    error: Callable[[Any], np.ndarray],
    threshold: float,
    rng: np.random.Generator,
    confidence: float = 0.999,
    limit: int = 10_000,
    propose: Callable[[np.ndarray], Sequence[Any]] | None = None,
    refit: Callable[[np.ndarray, Any], Any] | None = None,
    rounds: int = 5,
) -> tuple[Any, np.ndarray]:
    """The model with the most rows under the threshold, and the mask of these rows; (None, no rows) if there is none.

    Samples are drawn in batches until there were enough for the best share of inliers.  ``propose``
    gives the models of a batch of samples, any number of each; by default ``fit`` gives one of each.
    ``refit`` (rows, model) improves the best model on its inliers; by default it is fitted to them."""
    propose = propose or (lambda batch: [fit(rows) for rows in batch])
    refit = refit or (lambda rows, _: fit(rows))
    best, support, drawn = None, 0, 0
    while n >= size and drawn < (need := min(limit, draws_needed(support / n, size, confidence))):
        batch = samples(n, size, min(SMALL if not drawn else BATCH, need - drawn), rng)
        drawn += len(batch)
        models = [m for m in propose(batch) if m is not None]
        counts = [int((error(m) < threshold).sum()) for m in models]
        if counts and max(counts) > support:
            support = max(counts)
            best = models[counts.index(support)]
    return (None, np.zeros(n, bool)) if best is None else improved(best, error, refit, threshold, rounds)
