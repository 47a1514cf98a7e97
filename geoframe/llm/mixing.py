"""Mixing sources to target weights by iterative proportional fitting.

The tokens of the corpus are summed in cells of source, language and topic.  The cell sums are
raked: scaled to the source marginals, then the language marginals, then the topic marginals,
until all hold.  A cell's weight is its fitted share over its present one.

How much is kept is a budget, a share of the corpus's tokens.  A value of an axis gets its target
share of the budget or, if that is more than it has, all its tokens; what it falls short goes to
the other values by their targets.  The cells are raked to these sums by probabilities of at most
1: in each step the cells below 1 take what the cells at 1 leave.  A document stays if a hash of
its id is under the probability of its cell.  So the kept tokens are the budget in expectation,
whatever rare values there are, and have the target marginals but for what capped cells miss;
``report`` tells both.

The cells are a small table as long as there are at most CELLS of them, and are fitted on the
driver; more are fitted by the same steps as joins on the cluster.

Targets are given shares for each marginal, or by default the present shares to the power
TEMPER, scaled to one (that lifts rare values).  Values without a target share are dropped,
target values that don't occur are left out of the target.  Topics come from a column or from
the text: the group, of TOPICS by a hash, that most of a text's words of seven letters or more
fall into.

Defined results: a null text has no tokens; null sources and languages are values like others.
A text without long words has topic 0.  Rows with null ids are drawn by a hash of their text.
Repeated rows are kept or dropped alike.  An empty table gives an empty one.  Targets that
contradict each other (a cell that no weight can fill) are met on the last axis, and a warning says
by how much the others miss.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, doc_slices, text_bytes, unused
from .words import word_hashes

TEMPER = 0.7
TOPICS = 8
#: Share of the corpus's tokens that is kept.
BUDGET = 0.5
CELLS = 200_000
ROUNDS = 500
CLOSE = 1e-9
#: Factors of cells at probability 1 grow no further.
HIGH = 1e9
SLICE = 1 << 20
LONG = 7
AXES = ("source", "lang", "topic")


def topics_and_tokens(data: np.ndarray, offsets: np.ndarray, topics: int = TOPICS) -> tuple[np.ndarray, np.ndarray]:
    """Topic and number of words of each text."""
    n = len(offsets) - 1
    hashes, rows = word_hashes(data, offsets)
    tokens = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    votes = np.zeros((n, topics), np.int64)
    if len(rows):
        lengths = _word_lengths(data, offsets)
        long = lengths >= LONG
        np.add.at(votes, (rows[long], (hashes[long] % np.uint64(topics)).astype(np.int64)), 1)
    return votes.argmax(axis=1).astype(np.int32), tokens.astype(np.int64)


def _word_lengths(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    from .words import SPACE

    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(last) - np.flatnonzero(first) + 1


def _measure(topics: int):
    def run(text: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        parts = [topics_and_tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], topics) for i, j in doc_slices(offsets, SLICE)]
        both = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1)]
        return pa.StructArray.from_arrays([pa.array(both[0], pa.int32()), pa.array(both[1], pa.int64())], ["topic", "tokens"])

    return F.arrow_udf(run, "topic int, tokens long")


def measured(text: Column, topics: int = TOPICS) -> Column:
    """Struct of topic and tokens of a text column."""
    return _measure(topics)(text.cast("string"))


def rake(weights: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Cell shares that have the target shares on every axis.  ``axes``: the value's number of
    each cell; ``targets``: shares by value's number.  Empty cells stay empty."""
    fit = weights.astype(float)
    if fit.sum() <= 0:
        return fit
    fit /= fit.sum()
    for _ in range(ROUNDS):
        off = 0.0
        for at, target in zip(axes, targets, strict=True):
            now = np.bincount(at, weights=fit, minlength=len(target))
            off = max(off, float(np.abs(now - target).max()))
            fit = fit * np.divide(target, now, out=np.zeros_like(target), where=now > 0)[at]
        if off < CLOSE:
            return fit
    warnings.warn(f"after {ROUNDS} rounds the marginals still miss their targets by up to {off:.2g}", stacklevel=2)
    return fit


def _target(values: list, sums: np.ndarray, wanted: dict | None, temper: float) -> np.ndarray:
    share = sums.astype(float)
    share = np.array([float(wanted.get(v, 0.0)) for v in values]) * (share > 0) if wanted is not None else np.power(share, temper)
    return share / share.sum() if share.sum() > 0 else share


def goals(has: np.ndarray, target: np.ndarray, kept: float) -> np.ndarray:
    """Tokens to keep of each value: in proportion to ``target``, at most what it has, ``kept`` in all if there are so many."""
    full = np.zeros(len(has), bool)
    while True:
        open_ = ~full & (target > 0)
        want = np.where(open_, target * max(kept - has[full].sum(), 0.0) / max(target[open_].sum(), 1e-300), 0.0)
        more = open_ & (want >= has)
        if not more.any():
            return np.where(full, has, want)
        full |= more


def capped(sums: np.ndarray, axes: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """Probabilities of at most 1 by which the cells keep the wanted tokens on every axis.

    ``wanted``: tokens by value's number.  Where the axes contradict each other under the cap, the last one holds."""
    total = sums.sum()
    if total <= 0:
        return np.zeros(len(sums))
    u = np.where(sums > 0, wanted[0].sum() / total, 0.0)
    for _ in range(ROUNDS):
        off, before = 0.0, np.minimum(u, 1)
        for at, want in zip(axes, wanted, strict=True):
            n = len(want)
            now = np.bincount(at, weights=sums * np.minimum(u, 1), minlength=n)
            free = np.bincount(at, weights=np.where(u < 1, sums * u, 0.0), minlength=n)
            off = max(off, float(np.abs(now - want).max()) / total)
            # up: the free cells take what is missing; down: all shrink
            up = np.divide(want - now + free, free, out=np.ones(n), where=free > 0)
            down = np.divide(want, now, out=np.zeros(n), where=now > 0)
            u = np.minimum(u * np.where(want >= now, up, down)[at], HIGH)
        if off < CLOSE or float(np.abs(np.minimum(u, 1) - before).max()) < CLOSE:
            break
    return np.minimum(u, 1)


def _fit_small(rows: list, targets: dict, temper: float, budget: float) -> list[tuple]:
    sums = np.array([r["tokens"] for r in rows], float)
    axes, shares, wanted = [], [], []
    for axis in AXES:
        values = list(dict.fromkeys(r[axis] for r in rows))
        number = {v: i for i, v in enumerate(values)}
        at = np.array([number[r[axis]] for r in rows], np.int64)
        has = np.bincount(at, weights=sums, minlength=len(values))
        axes.append(at)
        shares.append(_target(values, has, targets.get(axis), temper))
        wanted.append(goals(has, shares[-1], budget * sums.sum()))
    fit = rake(sums, axes, shares)
    weight = np.divide(fit * sums.sum(), sums, out=np.zeros_like(sums), where=sums > 0)
    chance = capped(sums, axes, wanted) if rows else sums
    return [(*(r[a] for a in AXES), float(w), float(p)) for r, w, p in zip(rows, weight, chance, strict=True)]


def _goals_large(sums: DataFrame, kept: float) -> DataFrame:
    """``goals`` of a table with columns n and share, as column want."""
    scale = 0.0
    while True:
        full = F.col("share") * scale >= F.col("n")
        r = sums.agg(F.sum(F.when(full, F.col("n"))).alias("had"), F.sum(F.when(~full, F.col("share"))).alias("open")).first()
        new = max(kept - (r["had"] or 0.0), 0.0) / r["open"] if r["open"] else scale
        if new <= scale * (1 + 1e-12):
            return sums.withColumn("want", F.least(F.col("n").cast("double"), F.col("share") * scale))
        scale = new


def _settled(df: DataFrame) -> DataFrame:
    """``cut``, and without the estimate of its size, which the joins of each round would square."""
    done, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def _fit_large(cells: DataFrame, targets: dict, temper: float, budget: float) -> DataFrame:
    """The same rounds as joins of the cell table with its marginals."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    fit = cells.filter("tokens > 0").withColumn("fit", F.col("tokens") / total)
    wanted = {}
    for axis in AXES:
        sums = cells.groupBy(axis).agg(F.sum("tokens").alias("n"))
        if targets.get(axis) is not None:
            given = spark.createDataFrame([(v, float(s)) for v, s in targets[axis].items()], f"{axis} {dict(cells.dtypes)[axis]}, share double")
            sums = sums.alias("s").join(given.alias("g"), F.col(f"s.{axis}").eqNullSafe(F.col(f"g.{axis}")), "left").select(f"s.{axis}", "n", F.when(F.col("n") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("share"))
        else:
            sums = sums.select(axis, "n", F.pow("n", F.lit(temper)).alias("share"))
        whole = float(sums.agg(F.sum("share")).first()[0] or 1)
        wanted[axis] = _settled(_goals_large(cut(sums.select(axis, "n", (F.col("share") / whole).alias("share"))), budget * total))
    for _ in range(ROUNDS):
        off = 0.0
        for axis in AXES:
            now = fit.groupBy(axis).agg(F.sum("fit").alias("now")).alias("n").join(wanted[axis].alias("w"), F.col(f"n.{axis}").eqNullSafe(F.col(f"w.{axis}"))).select(F.col(f"n.{axis}").alias("_value"), "now", F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0).alias("_factor"), "share")
            now = _settled(now)
            off = max(off, float(now.agg(F.max(F.abs(F.col("now") - F.col("share")))).first()[0] or 0.0))
            fit = fit.join(now, F.col(axis).eqNullSafe(F.col("_value"))).select(*AXES, "tokens", (F.col("fit") * F.col("_factor")).alias("fit"))
        fit = _settled(fit)
        if off < CLOSE:
            break
    kept = float(wanted[AXES[0]].agg(F.sum("want")).first()[0] or 0.0)
    fit = fit.select(*AXES, "tokens", (F.col("fit") * total / F.col("tokens")).alias("weight"), F.lit(kept / total).alias("u"))
    for _ in range(ROUNDS):
        off = 0.0
        fit = fit.withColumn("_before", F.least(F.col("u"), F.lit(1.0)))
        for axis in AXES:
            held = fit.groupBy(axis).agg(F.sum(F.col("tokens") * F.least(F.col("u"), F.lit(1.0))).alias("now"), F.sum(F.when(F.col("u") < 1, F.col("tokens") * F.col("u")).otherwise(0.0)).alias("free"))
            up = F.when(F.col("free") > 0, (F.col("want") - F.col("now") + F.col("free")) / F.col("free")).otherwise(1.0)
            down = F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(0.0)
            now = _settled(held.alias("n").join(wanted[axis].alias("w"), F.col(f"n.{axis}").eqNullSafe(F.col(f"w.{axis}"))).select(F.col(f"n.{axis}").alias("_value"), "now", "want", F.when(F.col("want") >= F.col("now"), up).otherwise(down).alias("_factor")))
            off = max(off, float(now.agg(F.max(F.abs(F.col("now") - F.col("want")))).first()[0] or 0.0) / total)
            fit = fit.join(now, F.col(axis).eqNullSafe(F.col("_value"))).select(*AXES, "tokens", "weight", "_before", F.least(F.col("u") * F.col("_factor"), F.lit(HIGH)).alias("u"))
        fit = _settled(fit)
        moved = float(fit.agg(F.max(F.abs(F.least(F.col("u"), F.lit(1.0)) - F.col("_before")))).first()[0] or 0.0)
        if off < CLOSE or moved < CLOSE:
            break
    return fit.select(*AXES, "weight", F.least(F.col("u"), F.lit(1.0)).alias("probability"))


def report(cells: DataFrame) -> DataFrame:
    """axis, value, wanted and expected share of the kept tokens, missed (wanted less expected, where that is more than
    rounding) and kept (share of the whole corpus's tokens) of the cells that ``calibrated`` returns."""
    whole = cells.agg(*[F.sum(F.col("tokens") * F.col(c)).alias(c) for c in ("weight", "probability")], F.sum("tokens").alias("all"))
    parts = [cells.groupBy(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")).agg(*[F.sum(F.col("tokens") * F.col(c)).alias(f"_{c}") for c in ("weight", "probability")]) for a in AXES]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).crossJoin(F.broadcast(whole))  # one row
    missed = F.col("wanted") - F.col("expected")
    return both.select("axis", "value", F.try_divide("_weight", "weight").alias("wanted"), F.try_divide("_probability", "probability").alias("expected"), F.try_divide("probability", "all").alias("kept")).withColumn("missed", F.when(F.abs(missed) > 1e-6, missed).otherwise(0.0))


def added(docs: DataFrame) -> tuple[str, str, str]:
    """Names of the columns that are added: _topic, _tokens and _probability, with more underscores where ``docs`` has such columns."""
    return unused(docs, "topic"), unused(docs, "tokens"), unused(docs, "probability")


def calibrated(docs: DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER, topics: int = TOPICS, topic: str | None = None, budget: float = BUDGET) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a topic and its tokens (``added``), and the cells with tokens, weight and probability.

    ``budget``: share of the tokens to keep."""
    name, tokens, _ = added(docs)
    both = unused(docs, "both")
    whole = docs.withColumn(both, measured(F.col("text"), topics))
    whole = whole.withColumns({name: F.col(f"{both}.topic") if topic is None else F.col(f"`{topic}`"), tokens: F.col(f"{both}.tokens")}).drop(both)
    cells = cut(whole.groupBy("source", "lang", F.col(name).alias("topic")).agg(F.sum(tokens).alias("tokens"), F.count("*").alias("documents")))
    if cells.count() <= CELLS:
        rows = cells.collect()
        types = dict(cells.dtypes)
        fitted = docs.sparkSession.createDataFrame(_fit_small(rows, targets or {}, temper, budget), ", ".join(f"{a} {types[a]}" for a in AXES) + ", weight double, probability double")
    else:
        fitted = _fit_large(cells.select(*AXES, "tokens"), targets or {}, temper, budget)
    same = [F.col(f"c.{a}").eqNullSafe(F.col(f"f.{a}")) for a in AXES]
    return whole, cells.alias("c").join(fitted.alias("f"), same[0] & same[1] & same[2]).select(*[f"c.{a}" for a in AXES], "documents", "tokens", "weight", "probability")


def _uniform(seed: int) -> Column:
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id"), F.lit(seed))).otherwise(F.xxhash64(F.col("text"), F.lit(seed)))
    return (F.pmod(key, F.lit(1 << 52).cast("long")).cast("double") + 0.5) / float(1 << 52)


def sample(docs: DataFrame, targets: dict[str, dict] | None = None, seed: int = 0, **options) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns and topic, tokens and probability (``added``)."""
    name, _, probability = added(docs)
    both, cells = calibrated(docs, targets, **options)
    keys = [unused(docs, k) for k in ("cell_source", "cell_lang", "cell_topic")]
    chance = cells.select(*[F.col(a).alias(k) for a, k in zip(AXES, keys, strict=True)], F.col("probability").alias(probability))
    # at most CELLS rows are told to every task; more are joined by shuffle
    if chance.count() <= CELLS:
        chance = F.broadcast(chance)
    on = F.col("source").eqNullSafe(F.col(keys[0])) & F.col("lang").eqNullSafe(F.col(keys[1])) & F.col(name).eqNullSafe(F.col(keys[2]))
    return both.join(chance, on).filter(_uniform(seed) < F.col(probability)).drop(*keys)


def drawn(docs: DataFrame, targets: dict[str, dict] | None = None, seed: int = 0, **options) -> DataFrame:
    """The drawn rows of ``docs`` with their own columns alone."""
    return sample(docs, targets, seed, **options).drop(*added(docs))
