"""The archive's records against plain ones, their exact bytes, and its defined results."""

import base64
import hashlib
import re
from pathlib import Path

import pytest

from geoframe.llm import warc

SCHEMA = "page_id long, url string, html string"


def plain(rows, min_bytes=0):
    """(page_id, bytes, digest, type, refers_to) of each record."""
    groups, out = {}, []
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    for payload, ids in groups.items():
        body = payload.encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        known = [i for i in ids if i is not None]
        keeper = max(known) if known else None
        ids.remove(keeper)
        small = len(body) < min_bytes
        out += [(keeper, len(body), digest, "response", None), *((i, len(body), digest, *(("response", None) if small else ("revisit", keeper))) for i in ids)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


ROWS = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "http://a/9", "<p>nine ü€</p>"), (5, "http://a/5", None), (6, None, ""),
    (7, "http://a/7\r\nX: y", "a\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\nb"), (None, "http://a/n", "<p>one</p>"), (None, None, "alone"),
    (2, "http://a/2", "<p>one</p>"), (11, "http://a/11", "x" * 3_000_000),
]


def test_records_equal_plain_ones(spark):
    pages = spark.createDataFrame([(*r, 1, "k") for r in ROWS], f"{SCHEMA}, Key int, part string")
    assert found(warc.round_trip(pages)) == plain(ROWS)


def test_hot_payloads_are_dealt_over_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PART_ROWS", 7)
    rows = [(i, f"http://a/{i}", "same" if i % 3 else f"page {i}") for i in range(300)] + [(298, "http://a/again", "same")]
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"))
    heads = spark.read.parquet(str(tmp_path / "a/heads"))
    assert heads.groupBy("key").agg({"part": "max"}).filter("`max(part)` > 20").count() == 1
    assert found(warc.digests(spark, str(tmp_path / "a"))) == plain(rows)


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(i, "u", "tiny" if i < 3 else "long enough") for i in range(6)]
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"), min_bytes=5)
    assert found(warc.digests(spark, str(tmp_path / "a"))) == plain(rows, 5)


def test_payloads_are_stored_once_and_records_come_back_whole(spark, tmp_path):
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({r[2] or "" for r in ROWS})
    ids = set()
    for r in warc.records(spark, str(tmp_path / "a")).collect():
        payload = bytes(r.payload)
        head, _, block = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and int(fields["Content-Length"]) == len(block)
        http, _, body = block.partition(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", http)[1]) == len(payload) and body == (b"" if r.record_type == "revisit" else payload)
        assert (r.page_id, payload.decode()) in {(i, h or "") for i, _, h in ROWS}
        ids.add(fields["WARC-Record-ID"])
    assert len(ids) == len(ROWS)


def test_exported_files_read_by_their_lengths(spark, tmp_path):
    warc.write_archive(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "a"))
    warc.export(spark, str(tmp_path / "a"), str(tmp_path / "out"))
    seen = []
    for path in Path(tmp_path / "out").glob("part-*"):
        data = path.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
            block, data = rest[:n], rest[n + 4 :]
            assert rest[n : n + 4] == b"\r\n\r\n"
            if b"WARC-Type: response" in head:
                seen.append(block.partition(b"\r\n\r\n")[2].decode())
    assert sorted(seen) == sorted({r[2] or "" for r in ROWS})


@pytest.mark.parametrize("table", ["payloads", "heads"])
def test_changed_bytes_are_an_error(spark, tmp_path, table):
    warc.write_archive(spark.createDataFrame(ROWS[:3], SCHEMA), str(tmp_path / "a"))
    column = "payload" if table == "payloads" else "head"
    kept = {t: spark.read.parquet(str(tmp_path / "a" / t)) for t in ("payloads", "heads")}
    kept[table] = kept[table].selectExpr("*", f"cast(replace(cast({column} as string), '{'one' if table == 'payloads' else 'sha1:'}', 'sha1:A') as binary) as x").drop(column).withColumnRenamed("x", column)
    for name, df in kept.items():
        df.write.parquet(str(tmp_path / "b" / name))
    with pytest.raises(Exception, match="digest|fit its payload"):
        warc.digests(spark, str(tmp_path / "b")).collect()


def test_an_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
