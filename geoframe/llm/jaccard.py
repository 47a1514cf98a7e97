"""N-gram Jaccard join: groups of documents whose 5-word shingle sets are at least 3/4 alike.

A document's set is the set of hashes of its shingles, a node is a distinct set (documents
with equal sets are one node).  Steps, each a scan or one shuffle of compact arrays:

1. ``fingerprint``: id, set size and set fingerprint of each document.
2. ``active``: two linked sets of m and n shingles (m <= n) share many of the smallest 3/8
   of their hashes, at least ceil(3m/8) - floor(m/4).  A document of whose smallest 3/8 fewer
   are shared with any other node can't link; this leaves out most documents.
3. ``sets``: the whole sets of the active nodes.
4. ``blocks``: global order: rare hashes first, in hash order, then frequent ones by their
   count.  Two linked sets share one of their first floor(n/4)+1 hashes in that order.  The
   nodes that share such a hash form a block, named after the smallest of them, and all hashes
   with the same smallest node give one block, so near copies meet in one or few blocks.
5. ``links``: within a block a prefix tree over the ordered sets finds what links; sets known
   to be connected aren't compared again.  A block over a size bound is split, and its pivot
   goes to every part; then the sets that didn't connect with the pivot are split into batches
   of that size, too, and each batch meets each part in a task of their own.  So a task holds
   two parts at most, and no pair is lost.
6. Connected components over the blocks' results.

Defined results: null or empty texts, or texts of white space, have no shingle and link with
nothing.  Rows with a null id get a size, a null component, and link with nothing.  Rows that
repeat an id keep their own sets; a component's id is the smallest id of its rows.  Columns
other than the id and the text aren't read.  Sets are told apart by 64 bits of fingerprint
within the join and by 128 bits as classes of equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, doc_slices, tasks_for, text_bytes, unused
from .trie import join_block
from .words import fingerprints, mix64, shingle_sets

SLICE = 4 << 20
#: A hash in this many active sets or more is frequent; at most MAX_FREQUENT are told to all tasks
#: (the bound is raised to meet that, which only makes blocks larger).
FREQUENT = 32
MAX_FREQUENT = 1_000_000
#: Shingles in one part of a block (8 bytes each).
PART = 1_000_000
#: Hashes in one bucket of a shuffle.
BUCKET = 500_000
#: Rows that are told to all tasks at most.
MAX_TOLD = 1_000_000
#: Groups of nodes whose counts are added up together.
SLOTS = 256


def _binary(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = text_bytes(batch.column("text"))
    for i, j in doc_slices(offsets, SLICE):
        yield i, j, shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, sets in _slices(batch):
            one, two = fingerprints(sets)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "key")), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two)], ["doc_id", "key", "n_shingles", "node", "check"])


def _distinct_rows(nodes: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """First row of each distinct non-empty set."""
    full = np.array([len(s) > 0 for s in sets])
    _, first = np.unique(nodes, return_index=True)
    return first[full[first]]


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _cut_buckets(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Runs of each bucket in sorted hashes."""
    if len(hashes):
        b = _bucket(hashes, buckets)
        starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(b)).tolist(), strict=True):
            yield int(b[s]), slice(s, e)


_POSTED = "bucket int, hashes binary, nodes binary"


def _post_smallest(buckets: int):
    """Posts the smallest 3/8 of each node's hashes.  A hash that several nodes of a slice
    have is posted once, without an owner, and counted for its owners at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in _slices(batch):
                nodes, _ = fingerprints(sets)
                rows = _distinct_rows(nodes, sets)
                if not len(rows):
                    continue
                parts = [sets[i][: -(-3 * len(sets[i]) // 8)] for i in rows]
                hashes = np.concatenate(parts)
                owner = np.repeat(nodes[rows], [len(p) for p in parts])
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], owner[order]
                first = np.r_[True, hashes[1:] != hashes[:-1]]
                run_ = np.cumsum(first) - 1
                many = np.bincount(run_)[run_] > 1
                out: list[tuple[int, bytes, bytes]] = []
                if many.any():
                    own, counts = np.unique(owner[many], return_counts=True)
                    at = int(mix64(own[:1].view(np.uint64))[0] % np.uint64(buckets))
                    out.append((-1 - at, _binary(counts.astype(np.int64)), _binary(own)))
                keep = first | ~many
                owner = np.where(many, 0, owner)[keep]
                hashes = hashes[keep]
                for b, s in _cut_buckets(hashes, buckets):
                    out.append((b, _binary(hashes[s]), _binary(owner[s])))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "hashes", "nodes"])

    return run


def _join_arrays(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _count_shared(table: pa.Table) -> pa.Table:
    """Of one bucket: how many of its hashes each node shares with another."""
    counts = np.zeros(0, np.int64)
    if table.num_rows and table.column("bucket")[0].as_py() < 0:  # counted already
        nodes, counts = _join_arrays(table.column("nodes"), np.int64), _join_arrays(table.column("hashes"), np.int64)
    else:
        hashes, owner = _join_arrays(table.column("hashes"), np.uint64), _join_arrays(table.column("nodes"), np.int64)
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        if len(hashes):
            new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
            hashes, owner = hashes[new], owner[new]
            run = np.cumsum(np.r_[True, hashes[1:] != hashes[:-1]]) - 1
            weight = np.bincount(run, weights=np.where(owner == 0, 2, 1))
            owner = owner[(weight[run] > 1) & (owner != 0)]
        nodes, counts = np.unique(owner, return_counts=True)
    slots = (mix64(nodes.view(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)
    order = np.argsort(slots, kind="stable")
    nodes, counts, slots = nodes[order], np.asarray(counts, np.int64)[order], slots[order]
    starts = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]]) if len(slots) else np.zeros(0, np.int64)
    runs = list(zip(starts.tolist(), np.append(starts[1:], len(slots)).tolist(), strict=True)) if len(slots) else []
    return pa.table({"slot": pa.array(slots[starts], pa.int32()), "nodes": pa.array([_binary(nodes[a:b]) for a, b in runs], pa.binary()), "counts": pa.array([_binary(counts[a:b]) for a, b in runs], pa.binary())})


def _sum_shared(table: pa.Table) -> pa.Table:
    """Of one slot of nodes: their counts over all buckets."""
    nodes, at = np.unique(_join_arrays(table.column("nodes"), np.int64), return_inverse=True)
    counts = np.bincount(at, weights=_join_arrays(table.column("counts"), np.int64), minlength=len(nodes)).astype(np.int64)
    return pa.table({"node": pa.array(nodes, pa.int64()), "shared": pa.array(counts, pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets of the rows that have the wanted fingerprint, sorted by hash."""
    for batch in batches:
        wanted = batch.column("node").to_numpy(zero_copy_only=False)
        for i, j, sets in _slices(batch):
            nodes, _ = fingerprints(sets)
            rows = [k for k in range(j - i) if nodes[k] == wanted[i + k] and len(sets[k])]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[rows], pa.int64()), pa.array([len(sets[k]) for k in rows], pa.int64()), pa.array([_binary(sets[k]) for k in rows], pa.binary())], ["node", "n", "hashes"])


def _groups(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Nodes and sets of a batch, about ``limit`` hashes at a time."""
    nodes = batch.column("node").to_numpy(zero_copy_only=False)
    data, offsets = text_bytes(batch.column("hashes"))
    for i, j in doc_slices(offsets, 8 * limit):
        yield nodes[i:j], [np.frombuffer(data[offsets[k] : offsets[k + 1]].tobytes(), np.uint64) for k in range(i, j)]


def _post_counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _groups(batch, BUCKET):
                hashes, counts = np.unique(np.concatenate(sets), return_counts=True)
                out = [(b, _binary(hashes[s]), _binary(counts[s].astype(np.int64))) for b, s in _cut_buckets(hashes, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "hashes", "nodes"])

    return run


def _frequent(table: pa.Table) -> pa.Table:
    hashes, counts = _join_arrays(table.column("hashes"), np.uint64), _join_arrays(table.column("nodes"), np.int64)
    if len(hashes):
        hashes, at = np.unique(hashes, return_inverse=True)
        counts = np.bincount(at, weights=counts).astype(np.int64)
        often = counts >= FREQUENT
        hashes, counts = hashes[often], counts[often]
    return pa.table({"hash": pa.array(hashes.view(np.int64), pa.int64()), "df": pa.array(counts, pa.int64())})


class Order:
    """The global order of hashes: rare ones by hash, then the frequent ones by count and hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def first(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rare and the frequent ones among the first floor(n/4)+1 hashes of a set."""
        need = len(s) // 4 + 1
        if not len(self.hashes):
            return s[:need], s[:0]
        at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
        often = self.hashes[at] == s
        rare = s[~often][:need]
        rest = need - len(rare)
        if not rest:
            return rare, s[:0]
        left = s[often]
        return rare, left[np.lexsort((left, self.counts[at[often]]))[:rest]]


def _frequent_pivots(order):
    """The smallest node that has each frequent hash among its first ones, and how many have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sets in _groups(batch, BUCKET):
                parts = [order.value.first(s)[1] for s in sets]
                hashes = np.concatenate(parts)
                owner = np.repeat(nodes, [len(p) for p in parts])
                by = np.lexsort((owner, hashes))
                hashes, owner = hashes[by], owner[by]
                first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64), pa.int64()), pa.array(owner[first], pa.int64()), pa.array(np.diff(np.append(first, len(hashes))), pa.int64())], ["hash", "pivot", "n"])

    return run


def _post_first(order, pivots, buckets: int):
    """Posts the rare first hashes with their owners; memberships by frequent hashes are known at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, smallest = pivots.value
        for batch in batches:
            for nodes, sets in _groups(batch, BUCKET):
                out: list[tuple[int, bytes, bytes]] = []
                rare, often = zip(*(order.value.first(s) for s in sets), strict=True)
                hashes = np.concatenate(often)
                if len(hashes) and len(keys):
                    owner = np.repeat(nodes, [len(p) for p in often])
                    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    known = keys[at] == hashes
                    pairs = np.unique(np.stack([smallest[at[known]], owner[known]]), axis=1)
                    if pairs.size:
                        spread = int(mix64(nodes[:1].view(np.uint64))[0] % np.uint64(buckets))
                        out.append((-1 - spread, _binary(pairs[0]), _binary(pairs[1])))
                hashes = np.concatenate(rare)
                owner = np.repeat(nodes, [len(p) for p in rare])
                by = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[by], owner[by]
                for b, s in _cut_buckets(hashes, buckets):
                    out.append((b, _binary(hashes[s]), _binary(owner[s])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], ["bucket", "hashes", "nodes"])

    return run


def _members(table: pa.Table) -> pa.Table:
    """(pivot, node) for the hashes of one bucket that two nodes or more have."""
    if table.num_rows and table.column("bucket")[0].as_py() < 0:  # memberships already
        pivot, node = _join_arrays(table.column("hashes"), np.int64), _join_arrays(table.column("nodes"), np.int64)
    else:
        hashes, node = _join_arrays(table.column("hashes"), np.uint64), _join_arrays(table.column("nodes"), np.int64)
        order = np.lexsort((node, hashes))
        hashes, node = hashes[order], node[order]
        pivot = node
        if len(hashes):
            first = np.r_[True, hashes[1:] != hashes[:-1]]
            run = np.cumsum(first) - 1
            pivot = node[first][run]
            several = np.bincount(run)[run] > 1
            pivot, node = pivot[several], node[several]
    if len(node):
        pivot, node = np.unique(np.stack([pivot, node]), axis=1)
    return pa.table({"pivot": pa.array(pivot, pa.int64()), "node": pa.array(node, pa.int64())})


_LINKED = "pivot long, node long, root long, alone boolean"


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins each part of a block with a batch of probes; rows come sorted by pivot, part, batch and role."""
    key, held = None, []
    out: list[tuple[int, int, int, bool]] = []

    def finish() -> None:
        pivot = key[0]
        rows = {}
        for node, role, hashes in held:  # a probe that is a member, too, is a probe
            rows[node] = (max(role, rows[node][0]) if node in rows else role, hashes)
        nodes = sorted(rows, key=lambda v: (v != pivot, v))
        sets = [np.frombuffer(rows[v][1], np.uint64) for v in nodes]
        probes = [i for i, v in enumerate(nodes) if rows[v][0]]
        group = join_block(sets, probes or None)
        main = group[nodes.index(pivot)] if pivot in rows else -1
        for v, g in zip(nodes, group, strict=True):
            out.append((pivot, v, nodes[g], g != main))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], ["pivot", "node", "root", "alone"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("pivot", "part", "batch")), strict=True))
        roles, nodes = (batch.column(c).to_pylist() for c in ("role", "node"))
        sets = batch.column("hashes")
        for i in range(batch.num_rows):
            if key != keys[i]:
                if held:
                    finish()
                key, held = keys[i], []
                if len(out) > 50_000:
                    yield flush()
            held.append((nodes[i], roles[i], sets[i].as_buffer().to_pybytes()))
    if held:
        finish()
    if out:
        yield flush()


def _joined(rows: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """rows: pivot, part, batch, role, node."""
    whole = rows.join(sets, "node").select("pivot", "part", "batch", "role", "node", "hashes")
    return whole.repartition(tasks, "pivot", "part", "batch").sortWithinPartitions("pivot", "part", "batch", "role", "node").mapInArrow(_join_parts, _LINKED)


def _told(rows: DataFrame) -> DataFrame:
    """``rows``, told to all tasks if they are few."""
    return F.broadcast(rows) if rows.count() <= MAX_TOLD else rows


def links(sets: DataFrame) -> DataFrame:
    """Edges a, b of a graph with the components of the link graph, over node, n, hashes."""
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = tasks_for(spark, total, BUCKET)
    frequent = cut(sets.mapInArrow(_post_counts(buckets), _POSTED).groupBy("bucket").applyInArrow(_frequent, "hash long, df long"))
    least, kept = FREQUENT, 0
    for r in frequent.groupBy(F.floor(F.log2("df")).cast("int").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect():
        kept += r["n"]
        if kept > MAX_FREQUENT:
            least = 1 << (r["k"] + 1)
            break
    told = frequent.filter(F.col("df") >= least).toPandas()
    context = spark.sparkContext
    order = context.broadcast(Order(told["hash"].to_numpy(np.int64).view(np.uint64), told["df"].to_numpy(np.int64)))
    found = sets.mapInArrow(_frequent_pivots(order), "hash long, pivot long, n long").groupBy("hash").agg(F.min("pivot").alias("pivot"), F.sum("n").alias("n")).filter("n > 1").toPandas()
    keys = found["hash"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(keys)
    pivots = context.broadcast((keys[by], found["pivot"].to_numpy(np.int64)[by]))
    buckets = tasks_for(spark, total / 4, BUCKET)
    members = cut(sets.mapInArrow(_post_first(order, pivots, buckets), _POSTED).groupBy("bucket").applyInArrow(_members, "pivot long, node long").distinct())
    # only blocks over PART are looked up by pivot; of these there is at most one for PART shingles in all blocks
    sized = members.join(sets.select("node", "n"), "node")
    large = cut(sized.groupBy("pivot").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts")).filter("parts > 1"))
    tasks = tasks_for(spark, total, PART)
    parts = F.coalesce("parts", F.lit(1))
    part = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(7)), parts).cast("int")))
    placed = cut(members.join(_told(large), "pivot", "left").select("pivot", "node", F.explode(part).alias("part")))
    first = cut(_joined(placed.select("pivot", "part", F.lit(0).alias("batch"), F.lit(0).alias("role"), "node"), sets, tasks))
    edges = first.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    alone = cut(first.filter("alone").select("pivot", "node").join(_told(large), "pivot").select("pivot", "node", "parts").distinct().join(sets.select("node", "n"), "node"))
    if alone.isEmpty():
        return edges
    probed = cut(alone.groupBy("pivot").agg(F.ceil(F.sum("n") / PART).cast("int").alias("batches")))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    batch = F.pmod(F.xxhash64("node", F.lit(11)), F.col("batches")).cast("int").alias("batch")
    probes = alone.join(_told(probed), "pivot").select("pivot", F.explode(count("parts")).alias("part"), batch, F.lit(1).alias("role"), "node")
    rest = placed.join(_told(probed), "pivot").select("pivot", "part", F.explode(count("batches")).alias("batch"), F.lit(0).alias("role"), "node")
    second = cut(_joined(probes.unionByName(rest), sets, tasks))
    return edges.union(second.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, component_id and group for each row of ``docs``.

    group and lone tell the groups apart: rows of one group have both alike."""
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    spark = docs.sparkSession
    known = cut(docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_fingerprint, "doc_id long, key long, n_shingles long, node long, check long"))
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = tasks_for(spark, total * 3 / 8, BUCKET)
    named = docs.filter("doc_id is not null and text is not null")
    shared = named.select("text").mapInArrow(_post_smallest(buckets), _POSTED).groupBy("bucket").applyInArrow(_count_shared, "slot int, nodes binary, counts binary").groupBy("slot").applyInArrow(_sum_shared, "node long, shared long")
    classes = known.filter("doc_id is not null and n_shingles > 0").groupBy("node", "check").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"))
    active = cut(classes.join(shared, "node").filter("shared >= ceil(ceil(n * 3 / 4) / 8)").select(F.col("first_id").alias("doc_id"), "node"))
    sets = cut(named.join(active, "doc_id").mapInArrow(_sets, "node long, n long, hashes binary").dropDuplicates(["node"]))
    grouped = components(links(sets))
    smallest = classes.join(grouped, "node", "left").select("node", "check", "first_id", F.coalesce("component", "node").alias("group"), F.col("component").isNotNull().alias("linked"))
    lowest = smallest.filter("linked").groupBy("group").agg(F.min("first_id").alias("component_id"))
    of_class = smallest.join(lowest, "group", "left").select("node", "check", "group", F.when(~F.col("linked"), F.col("check")).alias("lone"), F.coalesce("component_id", "first_id").alias("component_id"))
    full = F.when(F.col("n_shingles") > 0, F.col("node"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return known.withColumn("node", full).join(of_class, ["node", "check"], "left").select("doc_id", "key", "n_shingles", component, "group", "lone")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``."""
    return _grouped(docs, doc_id, text).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row for each group: one with the smallest id.

    Rows are told apart by id and text: unlike texts that share an id are judged each by itself, of
    several texts of a group with the smallest id one stays, and of repeated rows one.  Rows with a
    null id, and rows without a shingle, stay.  Names of other columns don't matter."""
    found = _grouped(docs, doc_id, text).filter("doc_id is not null and n_shingles > 0")
    rows = cut(found.groupBy("doc_id", "key", "group", "lone").agg(F.first("component_id").alias("component_id"), F.count("*").alias("n")))
    least = rows.filter("doc_id = component_id").groupBy("doc_id", "group", "lone").agg(F.min("key").alias("least"), F.count("*").alias("texts")).filter("texts > 1")
    others = rows.filter("doc_id = component_id").alias("r").join(least.alias("l"), (F.col("r.doc_id") == F.col("l.doc_id")) & (F.col("r.group") == F.col("l.group")) & F.col("r.lone").eqNullSafe(F.col("l.lone")) & (F.col("key") > F.col("least"))).select("r.doc_id", "key")
    id_, key = unused(docs, "id"), unused(docs, "key")
    gone = cut(rows.filter("doc_id <> component_id").select("doc_id", "key").unionByName(others).toDF(id_, key))
    again = cut(rows.filter("doc_id = component_id and n > 1").select("doc_id", "key").toDF(id_, key))
    marked = docs.withColumns({id_: F.col(f"`{doc_id}`").cast("long"), key: F.xxhash64(F.col(f"`{text}`").cast("string"))})
    kept = marked.join(gone, [id_, key], "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, [id_, key], "left_anti").unionByName(kept.join(again, [id_, key], "left_semi").dropDuplicates([id_, key]))
    return kept.drop(id_, key)
