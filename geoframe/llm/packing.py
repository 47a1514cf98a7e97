"""Best-fit packing of documents into sequences by large-item matching.

Documents become token ids; those longer than a sequence are cut into full pieces and a
rest.  Only the number of pieces of each length matters for the packing, so it is solved on
that histogram (at most as many counts as a sequence has tokens), whatever the size of the
corpus.  Pieces above a third of the capacity go at most two into a sequence: from the
longest on, each is matched with the longest partner that still fits, which gives the fewest
sequences for them.  Then the smaller pieces, from the longest on, each go where the least
room that is enough remains.  Runs of equal pieces are placed together.  The solution is a
list of segments (length, ranks, sequences, offset); a piece's rank among those of its length
gives its place.

Defined results: a null text counts as empty and is the end id alone.  Rows with null or
repeated ids are packed like all others.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, doc_slices, tasks_for, text_bytes
from .tokens import encoder

CAPACITY = 4096
SLICE = 1 << 20
SALT_ROWS = 100_000


@dataclass(frozen=True)
class Segment:
    """Pieces of one length with ranks first .. first + count - 1; the i-th of them goes into
    sequence base + i // each, at offset + (i % each) * length."""

    length: int
    first: int
    count: int
    base: int
    each: int
    offset: int


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Segment], int]:
    """Segments for all pieces, and the number of sequences."""
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    out: list[Segment] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (base, number)
    rooms: list[int] = []
    sequences = 0

    def free(room: int, base: int, number: int) -> None:
        if room and number:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((base, number))

    def put(size: int, number: int, base: int, each: int, offset: int) -> None:
        out.append(Segment(size, used[size], number, base, each, offset))
        used[size] += number
        left[size] -= number

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect_left(large, capacity - a + 1) - 1
        while i >= 0 and not left[large[i]]:
            large.pop(i)
            i -= 1
        b = large[i] if i >= 0 else None
        if b is None:
            n = left[a]
        elif b == a:
            n = left[a] // 2
        else:
            n = min(left[a], left[b])
        if b is None or n == 0:  # alone: nothing fits, or one is left without a partner of its own length
            if n == 0:
                i -= 1
                while i >= 0 and not left[large[i]]:
                    large.pop(i)
                    i -= 1
                b = large[i] if i >= 0 else None
                n = 1
            else:
                b = None
        put(a, n, sequences, 1, 0)
        if b is not None:
            put(b, n, sequences, 1, a)
        free(capacity - a - (b or 0), sequences, n)
        sequences += n
    for size in sorted((s for s in left if left[s]), reverse=True):
        while left[size]:
            i = bisect_left(rooms, size)
            if i == len(rooms):
                each = capacity // size
                number = left[size] // each
                if number:
                    put(size, number * each, sequences, each, 0)
                    free(capacity - each * size, sequences, number)
                    sequences += number
                if rest := left[size]:
                    put(size, rest, sequences, rest, 0)
                    free(capacity - rest * size, sequences, 1)
                    sequences += 1
                break
            room = rooms[i]
            base, number = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(i)
            each = room // size
            full = min(number, left[size] // each)
            if full:
                put(size, full * each, base, each, capacity - room)
                free(room - each * size, base, full)
                base, number = base + full, number - full
            if number and left[size]:
                rest = left[size]
                put(size, rest, base, rest, capacity - room)
                free(room - rest * size, base, 1)
                base, number = base + 1, number - 1
            free(room, base, number)
    return out, sequences


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids_of = batch.column("doc_id")
            for i, j in doc_slices(offsets, SLICE):
                ids, totals = coder.encode_buffer(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                starts = np.cumsum(totals) - totals
                pieces = -(-totals // capacity)
                row = np.repeat(np.arange(j - i), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, totals[row] - start)
                body = memoryview(ids.astype("<u4").tobytes())
                at = starts[row] + start
                sums = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(row + i)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class _Places:
    """The segments as arrays, ordered by length and rank."""

    def __init__(self, segments: list[Segment]):
        rows = sorted((s.length, s.first, s.base, s.each, s.offset) for s in segments)
        self.table = np.array(rows, np.int64).reshape(-1, 5)
        # lengths are far under 2^20 and ranks under 2^43
        self.keys = (self.table[:, 0] << 43) + self.table[:, 1]

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, (length << 43) + rank, side="right") - 1
        _, first, base, each, offset = self.table[at].T
        i = rank - first
        return base + i // each, offset + (i % each) * length


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    pieces = cut(docs.mapInArrow(_pieces(tokenizer, capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    segments, _ = solve(counts, capacity)
    places = spark.sparkContext.broadcast(_Places(segments))
    salts = tasks_for(spark, sum(counts.values()), SALT_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
