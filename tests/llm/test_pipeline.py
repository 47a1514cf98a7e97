"""Each stage of the pipeline against a plain version of it, on all rows that its predecessor kept."""

import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from geoframe.llm import mixing, quality, toxicity

from .test_jaccard import brute


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The input and the rows after each stage."""
    tables = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], sf).cache())
    return tables


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source", "lang").collect()]


def ids(table):
    return sorted(r[0] for r in table)


def taught(spark, sf, label):
    fold = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    return {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r[label] in (0, 1) and not fold(r["doc_id"])}


def test_names_and_columns(spark, sf, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    assert all(t.columns == stages[0].columns for t in stages[:-1])
    end = {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "piece", "ids_crc32").collect()}
    assert end == {tuple(r) for r in stages[-1].select("doc_id", "piece", "ids_crc32").collect()}


def test_quality_stage(spark, sf, stages):
    truth, docs = taught(spark, sf, "quality"), rows(stages[0])
    stats = {d: quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for d, t, *_ in docs}
    density = {}
    groups = {y: np.stack([stats[d] for d, *_ in docs if truth.get(d) == y]) for y in (0, 1)}
    n = sum(map(len, groups.values()))
    pooled = sum(np.cov(g.T, bias=True) * len(g) for g in groups.values()) / n
    diagonal = np.diag(np.maximum(np.diag(pooled), 1e-8))
    for y, g in groups.items():
        c = 0.85 * np.cov(g.T, bias=True) + 0.075 * pooled + 0.075 * diagonal + 1e-3 * diagonal
        density[y] = {d: np.log(len(g) / n) - np.linalg.slogdet(c)[1] / 2 - (s - g.mean(0)) @ np.linalg.solve(c, s - g.mean(0)) / 2 for d, s in stats.items()}
    assert ids(rows(stages[1])) == sorted(d for d, *_ in docs if 1 / (1 + np.exp(density[0][d] - density[1][d])) >= 0.3)


def test_toxicity_stage(spark, sf, stages):
    truth = taught(spark, sf, "toxic")
    texts = {y: [t.encode() for d, t, *_ in sorted(rows(stages[1])) if truth.get(d) == y and t is not None] for y in (0, 1)}
    model = toxicity.train(texts[1], texts[0], sum(truth.values()) / len(truth))
    one, two = (toxicity._compressor(d + toxicity.ANCHOR) for d in (model.ordinary + toxicity.FILLER * len(model.toxic), model.ordinary + model.toxic))

    def score(t):
        words, saved = t.lower().split(), []
        for pair in dict.fromkeys(tuple(words[i : i + 2]) for i in range(0, len(words), 2)):
            w = toxicity.ANCHOR + b" " + b" ".join(pair) + b" " + toxicity.ANCHOR
            saved.append(len(one.compress(w)) - len(two.compress(w)))
        x = [1.0]
        for level in toxicity.LEVELS:
            hits = sum(s >= level for s in saved)
            x += [np.log1p(hits), np.log1p(1000 * hits / max(1, len(saved)))]
        return 1 / (1 + np.exp(-np.dot(x, model.weights)))

    assert ids(rows(stages[2])) == sorted(d for d, t, *_ in rows(stages[1]) if score((t or "").encode()) < 0.5)


def test_near_duplicates_stage(stages):
    found = brute([r[:2] for r in rows(stages[2])])
    assert ids(rows(stages[3])) == sorted(d for d, _, c in found if d == c)


def test_mixing_stage(stages):
    """Cells, goals and capped raking as plain loops; a document stays by a hash of its id."""
    docs = rows(stages[3])
    cell, tokens = {}, Counter()
    for d, t, source, lang in docs:
        data = (t or "").encode()
        topic, n = mixing.topics_and_tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        assert n[0] == len(data.split())
        cell[d] = (source, lang, int(topic[0]))
        tokens[cell[d]] += int(n[0])
    total = sum(tokens.values())
    goals = []
    for axis in range(3):
        has = Counter()
        for c, n in tokens.items():
            has[c[axis]] += n
        share = {v: n**mixing.TEMPER for v, n in has.items() if n}
        full: dict = {}
        while True:
            left = {v: s for v, s in share.items() if v not in full}
            want = {v: s * max(mixing.BUDGET * total - sum(full.values()), 0) / sum(left.values()) for v, s in left.items()}
            more = {v: has[v] for v in left if want[v] >= has[v]}
            full |= more
            if not more:
                break
        goals.append(full | want)
    u = {c: mixing.BUDGET if n else 0.0 for c, n in tokens.items()}
    for _ in range(mixing.ROUNDS):
        for axis in range(3):
            now, free = Counter(), Counter()
            for c, n in tokens.items():
                now[c[axis]] += n * min(u[c], 1)
                free[c[axis]] += n * u[c] if u[c] < 1 else 0
            for c in u:
                v = c[axis]
                goal = goals[axis].get(v, 0.0)
                factor = ((goal - now[v] + free[v]) / free[v] if free[v] > 0 else 1) if goal >= now[v] else goal / now[v]
                u[c] = min(u[c] * factor, mixing.HIGH)

    def drawn(d):
        first = xxhash.xxh64_intdigest(struct.pack("<q", d), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", 0), first)
        return ((h % (1 << 52)) + 0.5) / (1 << 52)

    margin = {d: drawn(d) - min(u[cell[d]], 1) for d, *_ in docs}
    kept = set(ids(rows(stages[4])))
    assert all((m < 0) == (d in kept) for d, m in margin.items() if abs(m) > 1e-4)
    assert 0 < len(kept) < len(docs)


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = []
    for d, t, *_ in rows(stages[4]):
        all_ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k, a, len(all_ids[a : a + 4096]), zlib.crc32(np.array(all_ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(all_ids), 4096))]
    got = stages[5].collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= 1.02 * -(-sum(w[3] for w in want) // 4096) + 1
