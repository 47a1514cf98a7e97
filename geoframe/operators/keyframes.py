"""Keyframes of videos of any length.

A pick depends on the pick before, yet no scan is needed.  Where the next pick would be if a frame
were one is a matter of three ordered operations, each over ranges of the rows:

* prefix sums of the motion, a carry for each range;
* a sliding maximum of the sharpness, the first rows of a range lent to the ranges before;
* a range search: frames and the values they look for (the motion before a frame, plus the least
  motion) are sorted together, and each value takes the frame that follows it.

That gives a pointer for every frame.  The picks are the frames on the path from each video's
first one: within a range, numpy follows pointers to the last pick inside; the pointers that leave
a range link these paths, and pointer doubling ranks them in as many rounds as the number of ranges
has binary digits.  No task holds more than a range, whatever the length of a video, and only a row
a range reaches the driver.

Motion is counted in whole units of 1e-9, so sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import ROWS, in_ranges, whole
from .shared import cut

UNIT = 10**9


def _segments(v: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Numbers of the runs of equal values."""
    codes = pc.dictionary_encode(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.cumsum(np.r_[0, (codes[1:] != codes[:-1])]) if len(codes) else codes


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of rows, first and last video, and motion of the last video of a range."""
    table = whole(batches)
    if table is not None:
        tail = int(table.column("m").to_numpy()[_segments(table.column("v")) == _segments(table.column("v"))[-1]].sum())
        made = pa.table({"_range": table.column("_range").slice(0, 1), "n": pa.array([len(table)], pa.int64()), "first": table.column("v").slice(0, 1), "last": table.column("v").slice(len(table) - 1, 1), "tail": pa.array([tail], pa.int64())})
        yield from made.combine_chunks().to_batches()


def _carries(ranged: DataFrame, kind: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """_range, _start (rows before), carry (motion before, of the video that goes on from the range
    before) and goes_on; and (range, start, n) of all ranges."""
    rows = ranged.select("_range", "v", "m").mapInArrow(_edges, f"_range int, n long, first {kind}, last {kind}, tail long").collect()
    out, spans, before, start, total = [], [], None, 0, 0
    for r in sorted(rows, key=lambda r: r["_range"]):
        goes_on = before is not None and before["last"] == r["first"]
        carry = total if goes_on else 0
        total = r["tail"] + (carry if r["first"] == r["last"] else 0)
        out.append((r["_range"], start, carry, goes_on))
        spans.append((r["_range"], start, r["n"]))
        start += r["n"]
        before = r
    return ranged.sparkSession.createDataFrame(out, "_range int, _start long, carry long, goes_on boolean"), spans


def _lent(spans: list[tuple[int, int, int]], window: int) -> list[tuple[int, int]]:
    """(range, earlier range that needs its first rows)."""
    out = []
    for i, (later, start, _) in enumerate(spans):
        for earlier, first, n in reversed(spans[:i]):
            if start - (first + n) >= window - 1:
                break
            out.append((later, earlier))
    return out


def _scored(window: int):
    """Adds to the frames of a range the motion before (p), the sharpest of the window that starts
    at the frame (best, best_range), and whether the frame is its video's first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        own = table.column("own").to_numpy()
        n, seg = int(own.sum()), _segments(table.column("v"))
        m = table.column("m").to_numpy()
        sums = np.cumsum(m) - m
        first = np.r_[True, seg[1:] != seg[:-1]]
        p = sums - np.maximum.accumulate(np.where(first, sums, 0))
        goes_on = bool(table.column("goes_on")[0].as_py())
        p[seg == 0] += table.column("carry")[0].as_py() if goes_on else 0
        first[0] = not goes_on
        s = table.column("s").to_numpy(zero_copy_only=False)
        s = np.where(np.isnan(s), np.inf, s)
        at, top, best = np.arange(n), s[:n].copy(), np.arange(n)
        for k in range(1, window):
            to = np.minimum(at + k, len(s) - 1)
            better = (at + k < len(s)) & (seg[to] == seg[:n]) & (s[to] > top)
            top, best = np.where(better, s[to], top), np.where(better, to, best)
        out = table.slice(0, n)
        return pa.table({"_range": out.column("_range"), "rank": out.column("rank"), "v": out.column("v"), "o": out.column("o"), "p": pa.array(p[:n]), "best": table.column("rank").take(pa.array(best)), "best_range": table.column("from").take(pa.array(best)), "first": pa.array(first[:n])})

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first frame among the sorted frames and values of a range, if any, and the last video."""
    table = whole(batches)
    if table is not None:
        frames = np.flatnonzero(table.column("kind").to_numpy() == 1)
        head = table.take(pa.array(frames[:1] if len(frames) else [0]))
        made = {"_range": head.column("_range"), "holds": pa.array([len(frames) > 0]), "v": head.column("v"), "best": head.column("best"), "best_range": head.column("best_range"), "last": table.column("v").slice(len(table) - 1, 1)}
        yield from pa.table(made).combine_chunks().to_batches()


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each value takes the frame that follows it, if that is one of the same video."""
    table = whole(batches)
    if table is None:
        return
    n, frame, seg = len(table), table.column("kind").to_numpy() == 1, _segments(table.column("v"))
    probe = np.flatnonzero(~frame)
    follows = np.minimum.accumulate(np.where(frame, np.arange(n), n)[::-1])[::-1][probe]
    inside, at = follows < n, np.minimum(follows, n - 1)
    same = inside & (seg[at] == seg[probe])

    def taken(name: str) -> pa.Array:
        """Of the frame in this range; what is left over at the end takes the first frame of a later one."""
        here, later = table.column(name).to_numpy(), table.column(f"after_{name}").to_numpy()
        return pa.array(np.where(same, here[at], np.where(inside, -1, later[probe])))

    rows = table.take(pa.array(probe))
    yield from pa.table({"home": rows.column("home"), "rank": rows.column("rank"), "v": rows.column("v"), "o": rows.column("o"), "next": taken("best"), "next_range": taken("best_range")}).combine_chunks().to_batches()


def pointers(frames: DataFrame, video: str, order: str, min_displacement: float, window: int, rows: int = ROWS) -> tuple[DataFrame, DataFrame, int]:
    """A row for each frame: home (range), rank, v, o, next and next_range (-1: none); the first
    picks: node (rank) and home; and the number of ranges."""
    spark, kinds = frames.sparkSession, dict(frames.dtypes)
    kind, place = kinds[video], kinds[order]
    least = round(min_displacement * UNIT)
    # without a least motion the next frame always will do
    moved = F.greatest(F.lit(0), F.round(F.coalesce(F.col("displacement_to_next").cast("double"), F.lit(0.0)) * UNIT).cast("long")) if least > 0 else F.lit(1).cast("long")
    least = max(least, 1)
    sharp = F.coalesce(F.col("sharpness").cast("double"), F.lit(float("-inf")))
    base = in_ranges(frames.select(F.col(f"`{video}`").alias("v"), F.col(f"`{order}`").alias("o"), sharp.alias("s"), moved.alias("m")), ["v", "o", "s", "m"], rows)
    carries, spans = _carries(base, kind)
    placed = base.join(F.broadcast(carries), "_range").withColumn("rank", F.col("_start") + F.col("_at"))  # a row for each range
    common = ["rank", "v", "o", "s", "m", "carry", "goes_on"]
    own = placed.select("_range", *common, F.col("_range").alias("from"), F.lit(True).alias("own"))
    lend = F.broadcast(spark.createDataFrame(_lent(spans, window), "from int, to int"))  # about a row for each range
    lent = placed.filter(F.col("_at") < window - 1).withColumnRenamed("_range", "from").join(lend, "from").select(F.col("to").alias("_range"), *common, "from", F.lit(False).alias("own"))
    scored = cut(own.unionByName(lent).groupBy("_range").applyInArrow(_scored(window), f"_range int, rank long, v {kind}, o {place}, p long, best long, best_range int, first boolean"))
    targets = scored.select("v", F.col("p").alias("value"), F.lit(1).alias("kind"), "rank", F.lit(None).cast(place).alias("o"), F.col("_range").alias("home"), "best", "best_range")
    sought = scored.select("v", (F.col("p") + least).alias("value"), F.lit(0).alias("kind"), "rank", "o", F.col("_range").alias("home"), F.lit(-1).cast("long").alias("best"), F.lit(-1).alias("best_range"))
    both = in_ranges(targets.unionByName(sought), ["v", "value", "kind", "rank"], rows, 2 * sum(n for _, _, n in spans))
    heads = both.select("_range", "v", "kind", "best", "best_range").mapInArrow(_heads, f"_range int, holds boolean, v {kind}, best long, best_range int, last {kind}").collect()
    after, head = [], None
    for r in sorted(heads, key=lambda r: -r["_range"]):
        fits = head is not None and head["v"] == r["last"]
        after.append((r["_range"], head["best"] if fits else -1, head["best_range"] if fits else -1))
        head = r if r["holds"] else head
    known = F.broadcast(spark.createDataFrame(after, "_range int, after_best long, after_best_range int"))  # a row for each range
    made = both.join(known, "_range").mapInArrow(_filled, f"home int, rank long, v {kind}, o {place}, next long, next_range int")
    return cut(made), scored.filter("first").select(F.col("best").alias("node"), F.col("best_range").alias("home")), len(spans)


def _inside(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The frames of a range in order; the place of each pointer in the range (or -1) and its frame."""
    table = table.sort_by("rank")
    rank, to = table.column("rank").to_numpy(), table.column("next").to_numpy()
    at = np.minimum(np.searchsorted(rank, to), max(len(rank) - 1, 0))
    return table, np.where((to >= 0) & (rank[at] == to), at, -1), to


def _ends(local: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last frame of the path inside the range from each frame, and the steps to it."""
    at = np.where(local >= 0, local, np.arange(len(local)))
    steps = (local >= 0).astype(np.int64)
    while (at[at] != at).any():
        steps, at = steps + steps[at], at[at]
    return at, steps


def _exits(table: pa.Table) -> pa.Table:
    """The frames outside to which paths of a range go."""
    table, local, to = _inside(table)
    end, _ = _ends(local)
    out = table.take(pa.array(np.unique(end)))
    out = out.filter(pc.greater_equal(out.column("next"), 0))
    return pa.table({"node": out.column("next"), "home": out.column("next_range")})


def _hops(table: pa.Table, nodes: pa.Table) -> pa.Table:
    """From where paths enter a range to where they go on outside, and the picks on the way."""
    table, local, to = _inside(table)
    end, steps = _ends(local)
    at = np.searchsorted(table.column("rank").to_numpy(), nodes.column("node").to_numpy())
    on = to[end[at]] >= 0
    at = at[on]
    return pa.table({"node": nodes.column("node").filter(pa.array(on)), "next": pa.array(to[end[at]]), "n": pa.array(steps[at] + 1)})


def _followed(video: str, order: str):
    def run(table: pa.Table, nodes: pa.Table) -> pa.Table:
        """All picks on the paths that enter a range."""
        table, local, _ = _inside(table)
        at = np.searchsorted(table.column("rank").to_numpy(), nodes.column("node").to_numpy())
        pick, picks, numbers = nodes.column("pick").to_numpy(), [], []
        while len(at):
            picks.append(at)
            numbers.append(pick)
            on = local[at] >= 0
            at, pick = local[at][on], pick[on] + 1
        rows = table.take(pa.array(np.concatenate(picks) if picks else np.zeros(0, np.int64)))
        return pa.table({video: rows.column("v"), order: rows.column("o"), "pick": pa.array(np.concatenate(numbers) if numbers else np.zeros(0, np.int64))})

    return run


def _ranked(links: DataFrame, first: DataFrame) -> DataFrame:
    """node and pick of all nodes on the paths from ``first`` (node); ``links``: node, next, n.
    Each round doubles the reach of links and the part of the paths that is known."""
    reached, jump = cut(first.select("node", F.lit(0).cast("long").alias("pick"))), cut(links)
    while not jump.isEmpty():
        more = reached.join(jump, "node").select(F.col("next").alias("node"), (F.col("pick") + F.col("n")).alias("pick"))
        reached = cut(reached.unionByName(more))
        on = jump.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        jump = cut(jump.join(on, "next").select("node", F.col("_next").alias("next"), (F.col("n") + F.col("_n")).alias("n")))
    return reached


def select_keyframes(frames: DataFrame, video: str, order: str, min_displacement: float, window: int = 5, rows: int = ROWS) -> DataFrame:
    """video, frame order and pick number.  ``frames``: sharpness and displacement_to_next (at
    least 0; null counts as 0).  The first pick of a video is the sharpest of its first ``window``
    frames; then, again and again, from where the motion since the last pick reaches
    ``min_displacement``, the sharpest of the next ``window``; ties to the earliest.  A null
    sharpness is the least, NaN the largest."""
    kinds = dict(frames.dtypes)
    links, first, ranges = pointers(frames, video, order, min_displacement, window, rows)
    reached = first.withColumn("pick", F.lit(0).cast("long"))
    if ranges > 1:
        exits = cut(links.groupBy("home").applyInArrow(_exits, "node long, home int").distinct())
        nodes = first.unionByName(exits).distinct()
        hops = links.groupBy("home").cogroup(nodes.groupBy("home")).applyInArrow(_hops, "node long, next long, n long")
        reached = _ranked(hops, first).join(nodes, "node")
    return links.groupBy("home").cogroup(reached.groupBy("home")).applyInArrow(_followed(video, order), f"`{video}` {kinds[video]}, `{order}` {kinds[order]}, pick long")
