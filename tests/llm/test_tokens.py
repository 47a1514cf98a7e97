import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geoframe.llm import packing, wavelet
from geoframe.llm.tokens import Encoder, encoder

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", " ", "don't  we'll I'VE x's", "İstanbul ΣΑΣ ok", "a\x1cb \x85c d\xa0e ½ ²", "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|>", "é café ß ẞ Œ ×÷", "a'sb ''s 12ab34 你好", "😀 ok\u0301 e\u0301", "z" * 3000]


def reference(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_on_odd_texts():
    whole = Tokenizer.from_file(PATH)
    ids, sizes = Encoder(PATH).encode([t.encode() for t in ODD])
    assert [i for t in ODD for i in [*whole.encode(t, add_special_tokens=False).ids, 1]] == ids.tolist()
    assert sizes.sum() == len(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_on_any_text(texts):
    whole = encoder(PATH).tokenizer
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, sizes = encoder(PATH).encode([t.encode() for t in texts])
    assert np.split(ids, np.cumsum(sizes)[:-1])[0].tolist() == ([*whole.encode(texts[0], add_special_tokens=False).ids, 1] if texts else []) if texts else len(ids) == 0
    assert [i for t in texts for i in [*whole.encode(t, add_special_tokens=False).ids, 1]] == ids.tolist()


@pytest.mark.parametrize("text", ["\x00:", "a\x00b \x00", "\x00", ":\x00:"])
def test_nul_bytes(text):
    ids, sizes = Encoder(PATH).encode([b"", text.encode(), text.encode()])
    assert ids.tolist() == [1, *reference(text), *reference(text)]


def test_other_vocabulary():
    ids, sizes = Encoder(str(public_tokenizers.path("byte_bpe_50k.json"))).encode([b"Hello  there", b""], end=7)
    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert ids.tolist() == [*whole.encode("Hello  there", add_special_tokens=False).ids, 7, 7] and sizes[1] == 1


ROWS = [(5, ODD[2]), (3, ODD[8]), (None, "null id"), (9, None), (3, "again three"), (-4, "minus"), (12, "word " * 9000), (11, ODD[5])]
SCHEMA = "doc_id long, text string"


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, levels in ((0, 4), (1, 1), (1000, 3), (5000, 9)):
        a = rng.integers(0, 1 << levels, n)
        m = wavelet.WaveletMatrix.of(a, levels)
        assert m.decode().tolist() == a.tolist()
        for i in range(0, n, 97):
            assert m.access(i) == a[i]
        for token in rng.integers(0, 1 << levels, 5).tolist():
            where = np.flatnonzero(a == token).tolist()
            assert m.count(token) == len(where) and m.rank(token, n // 2) == sum(w < n // 2 for w in where)
            assert [m.select(token, k) for k in range(0, len(where), 37)] == where[::37]
        assert m.count(1 << levels) == 0


def test_file_blocks(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 100)
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 300, int(rng.integers(0, 350))).astype(np.uint16)) for i in range(20)]
    stream = io.BytesIO()
    w = wavelet.Writer(stream, 9)
    for d in docs:
        w.add(*d)
    w.close()
    r = wavelet.Reader(stream)
    assert [(i, a.tolist()) for i, a in r.rows()] == [(i, a.tolist()) for i, a in docs]
    flat = np.concatenate([a for _, a in docs])
    assert r.access(777) == flat[777] and r.count(5) == (flat == 5).sum()
    for token in (0, 5, 17, 299, 300, 1 << 9):
        where = np.flatnonzero(flat == token).tolist()
        assert list(r.positions(token)) == where and r.count(token) == len(where)
        assert [r.select(token, k) for k in range(len(where))] == where
        assert [r.rank(token, i) for i in range(0, len(flat), 61)] == [sum(w < i for w in where) for i in range(0, len(flat), 61)]
    for i in (0, 99, 100, len(flat) - 1):
        d, at = r.document_at(i)
        assert docs[d][1][at] == flat[i]
    for bad in (-1, len(flat)):
        with pytest.raises(IndexError):
            r.access(bad)
    with pytest.raises(IndexError):
        r.select(5, r.count(5))


def test_lookups_read_single_frames():
    """One id, and one occurrence, of a file of a million take a frame or a few of each plane."""
    a = np.random.default_rng(2).integers(0, 49_000, 1 << 20).astype(np.uint16)
    stream = io.BytesIO()
    w = wavelet.Writer(stream, 16)
    w.add(1, a)
    w.close()
    r = wavelet.Reader(stream)
    total = sum(p.size for p in r.places)
    assert r.access(700_001) == a[700_001] and r.frames_read <= 16 < total / 8
    k = int((a[:700_001] == a[700_001]).sum())
    r = wavelet.Reader(stream)
    assert r.blocks[2].select(int(a[700_001]), int((a[2 << 18 : 700_001] == a[700_001]).sum())) == 700_001 - (2 << 18)
    assert r.frames_read <= 48 and r.rank(int(a[700_001]), 700_001) == k


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "TASK_BYTES", 20_000)
    monkeypatch.setattr(wavelet, "FILE_TOKENS", 1 << 25)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in wavelet.round_trip(docs, PATH).collect()), key=lambda r: r[1])
    order = sorted(((d, reference(t)) for d, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, crc(np.array(r[1], "<u2"))))
    assert sorted(map(str, (g[0] for g in got))) == sorted(str(d) for d, _ in ROWS)
    starts = {}
    at = 0
    for g in got:
        assert g[1] == at
        at += g[2]
    assert [g[0] for g in got] == [d for d, _ in order]
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((str(d), len(i), crc(i)) for d, i in order)
    assert not starts
    assert wavelet.round_trip(docs.limit(0), PATH).collect() == []


def test_packing(spark):
    docs = spark.createDataFrame(ROWS + [(100 + i, "one two three " * (i * 7)) for i in range(80)], SCHEMA + "").repartition(3)
    rows = [tuple(r) for r in docs.collect()]
    got = packing.pack(docs, PATH, capacity=512).collect()
    want = []
    for d, t in rows:
        ids = reference(t)
        want += [(str(d), k, a, len(ids[a : a + 512]), crc(ids[a : a + 512])) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 512
    assert len(bins) <= 1.05 * -(-sum(w[3] for w in want) // 512) + 1
    assert packing.pack(docs.limit(0), PATH).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.integers(4, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=12))
def test_solver_places_every_piece_once(capacity, counts):
    counts = {s: n for s, n in counts.items() if s <= capacity}
    segments, n = packing.solve(counts, capacity)
    places = packing._Places(segments)
    bins = {}
    for s, k in counts.items():
        seq, off = places(np.full(k, s), np.arange(k))
        for a, b in zip(seq.tolist(), off.tolist(), strict=True):
            bins.setdefault(a, []).append((b, s))
    assert set(bins) == set(range(n))
    for b in bins.values():
        at = 0
        for o, s in sorted(b):
            assert o == at
            at += s
        assert at <= capacity
