import random
import re

import numpy as np

from geoframe.llm import jaccard
from geoframe.llm.trie import join_block


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = sorted((find(a), find(b)))
                up[v] = u
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


def texts(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "One"), (5, "one"), (6, "a b c d"), (7, "A b\tc D"), (8, "a b c d e"), (9, "a b c d é"), (10, "a b c d É")]
    i = 20
    for n in (6, 8, 12, 30, 60, 200, 1500):
        for _ in range(4):
            base = [word() for _ in range(n)]
            if rnd.random() < 0.5:
                base = base[: n // 2] + passage + base[n // 2 :]
            for k in range(rnd.choice((1, 3, 8))):
                w = list(base)
                for _ in range(rnd.choice((0, 0, 1, max(1, n // 40), max(1, n // 18)))):
                    w[rnd.randrange(len(w))] = word()
                rows.append((i, " ".join(w)))
                i += 1
    return rows


def test_matches_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(jaccard.near_duplicates(df)) == brute(rows)


def test_large_group_in_parts(spark, monkeypatch):
    """Parts of 2,000 shingles, so the group is split and the rest meets all parts."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(80)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 160):
        w = list(base)
        for _ in range(rnd.choice((1, 1, 2, 3))):
            w[rnd.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "PART", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(jaccard.near_duplicates(df)) == brute(rows)


def test_frequent_hashes(spark):
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, passage + " " + " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice((0, 1, 2, 3, 20))))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(jaccard.near_duplicates(df)) == brute(rows)


def test_data(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert result(jaccard.near_duplicates(docs)) == brute(rows)


def test_edges(spark):
    schema = "text string, node long, doc_id long, part int, hashes string"
    empty = spark.createDataFrame([], schema)
    assert jaccard.near_duplicates(empty).collect() == []
    assert jaccard.keep_one(empty).collect() == []
    rows = [("a b c d e f", 1, None, 0, ""), ("a b c d e f", 1, 5, 0, None), ("A b c d e f", 2, 4, 0, ""), ("x", None, 5, 0, ""), ("a b c d e f", 1, 5, 0, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert got == [(-1, 2, None), (4, 2, 4), (5, 1, 5), (5, 2, 4), (5, 2, 4)]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns


def test_keep_one_by_row(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue pink grey black white")
    near = a.replace("six", "SIX")  # the same set
    schema = "doc_id long, text string, _key long, _ID string, `x.y` int"
    rows = [(4, a), (5, a), (5, b), (6, c), (4, near), (4, a), (7, "x"), (7, "y"), (None, a), (8, ""), (8, None), (9, c)]
    df = spark.createDataFrame([(*r, 1, "i", 2) for r in rows], schema).repartition(3)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=str)
    assert got == sorted([(4, a), (5, b), (6, c), (7, "x"), (7, "y"), (None, a), (8, ""), (8, "")], key=str)


def test_batches_of_probes(spark, monkeypatch):
    """One hash that all share, so one block; nearly nothing links, and parts and probes are many."""
    rnd = random.Random(9)
    monkeypatch.setattr(jaccard, "PART", 500)
    rows = []
    for i in range(120):
        w = [f"p{k}" for k in range(8)] + [f"u{rnd.randrange(40)}" for _ in range(6)]
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            rows.append((1000 + i, " ".join([*w, "end"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(jaccard.near_duplicates(df)) == brute(rows)


def test_very_long_word_and_text(spark):
    long = "z" * 700_000
    many = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long.upper()), (3, many), (4, many + " end"), (5, long + " a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(jaccard.near_duplicates(df)) == brute(rows)


def test_block_with_queries():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**60, 100).astype(np.uint64))
    sets = [base, *(base[rng.random(len(base)) < 0.95] for _ in range(10)), np.unique(rng.integers(0, 2**60, 50).astype(np.uint64))]
    assert join_block(sets) == [0] * 11 + [11]
    assert join_block(sets, [11]) == list(range(12))
    assert join_block(sets, [3])[0] == 0
