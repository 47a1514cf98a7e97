"""Token ids in wavelet matrix files.

Documents become token ids, in ascending order of their ids.  Rows are dealt to tasks by ranges of
their ids; a task encodes its range and writes it as one file or, beyond FILE_TOKENS ids, several.
A file holds blocks of at most BLOCK tokens (a longer document goes on in the next block).  A block
is a wavelet matrix: one bit-plane for each bit of an id, from the highest, with the ids stably
sorted by each plane's bit before the next.  Planes are cut into frames of CHUNK bits, each packed
by itself, and the ones before each frame are kept beside its place, as are the counts of every
plane's zeros.  So rank reads one frame of a plane, select bisects the kept counts and reads one
frame, and single ids, counts and positions of an id come from the compressed file without
decoding a block.  A reader keeps the frames that it used last.

    file      magic "GFWM2\\n", then the frames, then the footer, its length (8 bytes), magic
    footer    zstandard: the length of a JSON line (8 bytes), the line (levels, chunk, number of
              documents, tokens of each block), then arrays of 64-bit integers: ids, nulls and
              tokens of the documents, zeros of each plane, and place, size and ones before of
              each frame, by block, plane and frame

Defined results: a null text counts as empty and is the end id alone.  Rows with a null id
come first.  Rows that repeat an id are next to each other, ordered by a hash of their text.
An empty table gives no file and no rows.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, doc_slices, shared_folder, text_bytes
from .tokens import encoder

MAGIC = b"GFWM2\n"
BLOCK = 1 << 18
#: Bits of one frame of a plane.
CHUNK = 1 << 16
#: Bytes of text for one task.
TASK_BYTES = 48_000_000
#: Ids after which a task begins its next file.
FILE_TOKENS = 1 << 25
#: Frames that a reader keeps (8 kB each).
KEPT_FRAMES = 4096
SLICE = 1 << 20


class WaveletMatrix:
    """Ids of one block with access, rank and select.

    ``frame(level, c)`` gives the bytes of a frame, ``before[level, c]`` the ones before it."""

    def __init__(self, size: int, zeros: np.ndarray, before: np.ndarray, frame: Callable[[int, int], np.ndarray]):
        self.size, self.zeros, self.before, self.frame = size, zeros, before, frame
        self.levels = len(zeros)

    @classmethod
    def of(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        chunks = -(-len(ids) // CHUNK)
        zeros, before = np.zeros(levels, np.int64), np.zeros((levels, chunks), np.int64)
        planes = np.zeros((levels, chunks * (CHUNK // 8)), np.uint8)
        a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        for v in range(levels):
            bit = (a & a.dtype.type(1 << (levels - 1 - v))) != 0
            planes[v, : -(-len(ids) // 8)] = np.packbits(bit)
            zeros[v] = n = len(a) - np.count_nonzero(bit)
            parted = np.empty_like(a)
            np.compress(~bit, a, out=parted[:n])
            np.compress(bit, a, out=parted[n:])
            a = parted
            before[v, 1:] = np.cumsum(np.bitwise_count(planes[v]).reshape(chunks, CHUNK // 8).sum(axis=1, dtype=np.int64))[:-1]
        return cls(len(ids), zeros, before, lambda v, c: planes[v, c * (CHUNK // 8) : (c + 1) * (CHUNK // 8)])

    def decode(self) -> np.ndarray:
        """All ids, by undoing the sorts from the last plane up."""
        a = np.zeros(self.size, np.uint16 if self.levels <= 16 else np.uint32)
        for v in range(self.levels - 1, -1, -1):
            packed = [self.frame(v, c) for c in range(self.before.shape[1])]
            bit = np.unpackbits(np.concatenate(packed) if packed else np.zeros(0, np.uint8), count=self.size).view(bool)
            out = np.empty_like(a)
            out[~bit] = a[: self.zeros[v]]
            out[bit] = a[self.zeros[v] :] | a.dtype.type(1 << (self.levels - 1 - v))
            a = out
        return a

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        c, inner = divmod(i, CHUNK)
        if not inner:
            return int(self.before[level, c]) if c < self.before.shape[1] else self.size - int(self.zeros[level])
        part = self.frame(level, c)
        last = int(part[inner >> 3]) >> (8 - (inner & 7)) if inner & 7 else 0
        return int(self.before[level, c]) + int(np.bitwise_count(part[: inner >> 3]).sum(dtype=np.int64)) + last.bit_count()

    def _bit(self, level: int, i: int) -> int:
        return int(self.frame(level, i // CHUNK)[i % CHUNK >> 3]) >> (7 - (i & 7)) & 1

    def _place(self, level: int, one: int, k: int) -> int:
        """Where the k-th one or zero of a plane is."""
        before = self.before[level] if one else np.arange(self.before.shape[1]) * CHUNK - self.before[level]
        c = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.frame(level, c), count=min(CHUNK, self.size - c * CHUNK))
        return c * CHUNK + int(np.flatnonzero(bits == one)[k - int(before[c])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        out = 0
        for v in range(self.levels):
            ones, bit = self._ones(v, i), self._bit(v, i)
            out = 2 * out + bit
            i = int(self.zeros[v]) + ones if bit else i - ones
        return out

    def _range(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where the ``token``s among ids a to b are after the last sort."""
        if token < 0 or token >> self.levels:
            return 0, 0
        for v in range(self.levels):
            if a == b:
                return a, b
            x, y = self._ones(v, a), self._ones(v, b)
            a, b = (int(self.zeros[v]) + x, int(self.zeros[v]) + y) if token >> (self.levels - 1 - v) & 1 else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` is among the first i ids."""
        return self.count(token, 0, min(i, self.size))

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        x, y = self._range(token, a, self.size if b is None else b)
        return y - x

    def select(self, token: int, k: int) -> int:
        """Position of the k-th ``token`` (from 0)."""
        a, b = self._range(token, 0, self.size)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for v in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - v) & 1
            i = self._place(v, one, i - int(self.zeros[v]) if one else i)
        return i

    def positions(self, token: int) -> Iterator[int]:
        """All positions of ``token``, in order."""
        for k in range(self.count(token)):
            yield self.select(token, k)


class Writer:
    """One file.  Ids are added document by document."""

    def __init__(self, stream, levels: int):
        self.stream, self.levels = stream, levels
        self.documents: list[tuple[int | None, int]] = []
        self.sizes: list[int] = []
        self.zeros: list[np.ndarray] = []
        self.frames: list[tuple[int, int, int]] = []
        self.at = stream.write(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.tokens += len(ids)
        if self.n_held >= BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint16)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, whole, BLOCK):
            m = WaveletMatrix.of(ids[a : min(a + BLOCK, whole)], self.levels)
            for v in range(self.levels):
                for c in range(m.before.shape[1]):
                    data = self.pack.compress(m.frame(v, c).tobytes())
                    self.stream.write(data)
                    self.frames.append((self.at, len(data), int(m.before[v, c])))
                    self.at += len(data)
            self.sizes.append(m.size)
            self.zeros.append(m.zeros)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(last=True)
        line = json.dumps({"levels": self.levels, "chunk": CHUNK, "documents": len(self.documents), "blocks": self.sizes}).encode()
        arrays = [[d or 0 for d, _ in self.documents], [d is None for d, _ in self.documents], [n for _, n in self.documents], np.concatenate(self.zeros) if self.zeros else [], *(zip(*self.frames, strict=True) if self.frames else ([], [], []))]
        footer = zstandard.compress(len(line).to_bytes(8, "little") + line + b"".join(np.array(list(a), "<i8").tobytes() for a in arrays))
        self.stream.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """A file; frames are read when they are asked for."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.seek(0, os.SEEK_END)
        stream.seek(end - 8 - len(MAGIC))
        tail = stream.read(8 + len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError("not a whole file of this format")
        size = int.from_bytes(tail[:8], "little")
        stream.seek(end - 8 - len(MAGIC) - size)
        data = zstandard.decompress(stream.read(size))
        line = int.from_bytes(data[:8], "little")
        kept = json.loads(data[8 : 8 + line])
        if kept["chunk"] != CHUNK:
            raise ValueError(f"frames of {kept['chunk']} bits")
        n, levels, sizes = kept["documents"], kept["levels"], np.array(kept["blocks"], np.int64)
        chunks = -(-sizes // CHUNK)
        frames = int(chunks.sum()) * levels
        flat = np.frombuffer(data, "<i8", offset=8 + line)
        ids, nulls, tokens, zeros, *places = np.split(flat, np.cumsum([n, n, n, len(sizes) * levels, frames, frames]))
        self.documents = [(None if z else d, k) for d, z, k in zip(ids.tolist(), nulls.tolist(), tokens.tolist(), strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.cumsum(chunks * levels)[:-1]
        shaped = lambda a: [p.reshape(levels, -1) for p in np.split(a, cuts)] if len(sizes) else []
        self.places, self.lengths, before = (shaped(p) for p in places)
        self.cache: OrderedDict[tuple[int, int, int], np.ndarray] = OrderedDict()
        self.frames_read = 0
        self.blocks = [WaveletMatrix(int(s), z, b, lambda v, c, k=k: self._frame(k, v, c)) for k, (s, z, b) in enumerate(zip(sizes, zeros.reshape(-1, levels), before, strict=True))]

    def __len__(self) -> int:
        return int(self.starts[-1])

    def _frame(self, block: int, level: int, c: int) -> np.ndarray:
        key = (block, level, c)
        if key in self.cache:
            self.cache.move_to_end(key)
            return self.cache[key]
        self.stream.seek(int(self.places[block][level, c]))
        found = np.frombuffer(zstandard.decompress(self.stream.read(int(self.lengths[block][level, c]))), np.uint8)
        self.frames_read += 1
        self.cache[key] = found
        if len(self.cache) > KEPT_FRAMES:
            self.cache.popitem(last=False)
        return found

    def access(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.starts, i, side="right")) - 1
        return self.blocks[k].access(i - int(self.starts[k]))

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` is among the file's first i ids."""
        return sum(b.rank(token, i - int(s)) for s, b in zip(self.starts, self.blocks, strict=False) if s < i)

    def count(self, token: int) -> int:
        return self.rank(token, len(self))

    def select(self, token: int, k: int) -> int:
        """Position in the file of the k-th ``token`` (from 0)."""
        left = k
        for s, b in zip(self.starts, self.blocks, strict=False):
            n = b.count(token)
            if 0 <= left < n:
                return int(s) + b.select(token, left)
            left -= n
        raise IndexError(k)

    def positions(self, token: int) -> Iterator[int]:
        """All positions of ``token`` in the file, in order."""
        for s, b in zip(self.starts, self.blocks, strict=False):
            for i in b.positions(token):
                yield int(s) + i

    def document_at(self, i: int) -> tuple[int, int]:
        """Number of the document that id i is in, and the place there."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        ends = np.cumsum([n for _, n in self.documents])
        d = int(np.searchsorted(ends, i, side="right"))
        return d, i - int(ends[d] - self.documents[d][1])

    def rows(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """The documents with their ids, in order; a block is decoded at a time."""
        k, held = 0, np.zeros(0, np.uint16)
        for doc_id, n in self.documents:
            parts = []
            while n > len(held):
                parts.append(held)
                n -= len(held)
                held = self.blocks[k].decode()
                self.cache.clear()
                k += 1
            parts.append(held[:n])
            held = held[n:]
            yield doc_id, np.concatenate(parts) if len(parts) > 1 else parts[0]


def _open(path: str, mode: str):
    """A stream on a shared path.  Local files have no scheme; others go through Arrow's file systems."""
    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" not in local:
        if mode == "wb":
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    if mode == "wb":
        system.create_dir(os.path.dirname(name), recursive=True)
        return system.open_output_stream(name)
    return system.open_input_file(name)


def _rename(old: str, new: str) -> None:
    local = [p.removeprefix("file://") if p.startswith("file://") else p.removeprefix("file:") for p in (old, new)]
    if "://" not in local[0]:
        os.replace(*local)
        return
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(old)
    system.move(name, fs.FileSystem.from_uri(new)[1])


def _write(folder: str, path: str, end: int):
    """Encodes and writes a range of rows, which come sorted.  A file gets its name when it is
    whole, so a task that is repeated replaces it with the same content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        wide = np.uint16 if len(coder.ends) <= 1 << 16 and end < 1 << 16 else np.uint32
        levels = max(1, int(max(len(coder.ends) - 1, end)).bit_length())
        part, out, name, done = TaskContext.get().partitionId(), None, "", []

        def finish() -> None:
            out.close()
            out.stream.close()
            final = f"{folder}/part-{part:07d}-{len(done):04d}.gfwm"
            _rename(name, final)
            done.append((part, len(done), final, out.tokens))

        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j in doc_slices(offsets, SLICE):
                ids, totals = coder.encode_buffer(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end)
                ids = ids.astype(wide)
                at = np.concatenate([[0], np.cumsum(totals)])
                for k in range(i, j):
                    if out is None:
                        name = f"{folder}/part-{uuid.uuid4().hex}.tmp"
                        out = Writer(_open(name, "wb"), levels)
                    out.add(doc_ids[k], ids[at[k - i] : at[k - i + 1]])
                    if out.tokens >= FILE_TOKENS:
                        finish()
                        out = None
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["part", "file", "path", "tokens"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """Writes the files; returns path and number of ids, in order of their documents (the list
    has a row for about TASK_BYTES of text)."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-size // TASK_BYTES), min(4 * cores, size // (TASK_BYTES // 16)))
    # rows that repeat an id are told apart by their text, and equal rows by where they are read, so
    # that no range has to hold all rows of one id
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_text").asc()]
    ranged = docs.withColumns({"_text": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(tasks, *keys, F.col("_row").asc())
    rows = ranged.sortWithinPartitions(*keys).select("doc_id", "text").mapInArrow(_write(folder, tokenizer, end), "part int, file int, path string, tokens long")
    return [(r["path"], r["tokens"]) for r in sorted(rows.collect(), key=lambda r: (r["part"], r["file"]))]


def _read(files: list[tuple[str, int]]):
    """Digests of the files whose numbers come as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                path, at = files[number]
                with _open(path, "rb") as stream:
                    rows: list[tuple] = []
                    for doc_id, ids in Reader(stream).rows():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _digest(rows)
                            rows = []
                    if rows:
                        yield _digest(rows)

    return run


def _digest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(spark, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files, a task for each file."""
    starts = np.cumsum([0, *(n for _, n in files)]).tolist()
    listed = [(path, start) for (path, _), start in zip(files, starts, strict=False)]
    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(_read(listed), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Writes the files into the shared folder, digests what they hold and removes them."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/geoframe-tokens-{uuid.uuid4().hex}"
    digests = cut(read_digests(spark, write_tokens(docs, tokenizer, folder, end)))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return digests
