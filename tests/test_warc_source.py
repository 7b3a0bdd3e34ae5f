"""Archives read in byte ranges: every split size gives the same records."""

from __future__ import annotations

import gzip
import random

import pyarrow as pa
import pytest

from docloom.sources import warc_source, web_archive


def record(url: str, block: bytes, kind: str = "response") -> bytes:
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def blocks() -> list[bytes]:
    noise = random.Random(3)
    inner = record("inner", b"x" * 30)
    return [
        b"", b"plain", b"a\r\n\r\nWARC/1.1\r\nWARC-Type: none\r\n\r\n tail", b"q\r\n\r\n" + inner[:-10],
        bytes(noise.randrange(256) for _ in range(5000)), b"\x1f\x8b\x08\x00" * 50, gzip.compress(b"no record", mtime=0), b"e" * 200_000, b"last\r\n\r\n",
    ]


def read(file: bytes, split: int) -> list[tuple]:
    source = pa.BufferReader(file)
    found = []
    for at in range(0, len(file), split):
        found += [(r.head, r.block, r.cut_short) for _, _, _, r in warc_source.range_records(source, at, min(at + split, len(file)))]
    return found


@pytest.mark.parametrize("layout", ["plain", "members", "pairs", "whole"])
@pytest.mark.parametrize("split", [37, 1000, 4096, 1 << 30])
def test_every_split_reads_each_record_once(layout, split):
    all_ = [record(f"u{n}", b) for n, b in enumerate(blocks())]
    if layout == "plain":
        file = b"".join(all_)
    elif layout == "members":
        file = b"".join(gzip.compress(r) for r in all_)
    elif layout == "pairs":
        file = b"".join(gzip.compress(b"".join(all_[i : i + 2])) for i in range(0, len(all_), 2))
    else:
        file = gzip.compress(b"".join(all_))
    got = read(file, split)
    assert [b for _, b, _ in got] == blocks()
    assert not any(cut for _, _, cut in got)


def test_cut_file_and_record_without_length():
    whole = record("a", b"one") + record("b", b"two" * 100)
    assert [(b, c) for _, b, c in read(whole[:-200], 64)] == [(b"one", False), (b"two" * 100, True)] or read(whole[:-200], 64)[-1][2]
    packed = gzip.compress(record("a", b"one")) + gzip.compress(record("b", random.Random(1).randbytes(500)))
    assert [c for _, _, c in read(packed[:-100], 32)] == [False, True]
    loose = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nbody\r\n\r\n" + record("b", b"two")
    assert [b for _, b, _ in read(loose, 1 << 20)] == [b"body", b"two"]
    assert read(b"not an archive at all", 5) == []


def test_source_round_trip(spark, tmp_path):
    rows = [("response" if n % 3 else "request", f"u{n}", b) for n, b in enumerate(blocks() * 20)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "rec_type string, url string, block binary, file int").repartition(3)
    for compressed in (True, False):
        folder = str(tmp_path / f"a{compressed}")
        warc_source.write_archives(df, folder, compressed)
        got = warc_source.read_archives(spark, folder, split_bytes=20_000)
        assert got.rdd.getNumPartitions() > 3
        assert sorted((r.rec_type, r.url, r.payload) for r in got.collect()) == sorted((k, u, b.decode("utf-8", "replace")) for k, u, b in rows)
        assert warc_source.gaps(got).count() == 0
        assert warc_source.read_archives(spark, folder, ("request",)).count() == sum(k == "request" for k, _, _ in rows)
        warc_source.write_archives(df.limit(0), str(tmp_path / f"e{compressed}"), compressed)
        assert warc_source.read_archives(spark, str(tmp_path / f"e{compressed}")).count() == 0
    lost = warc_source.read_archives(spark, folder).filter("url != 'u8'")
    assert warc_source.gaps(lost).count() == 1


def test_damaged_member():
    members = [gzip.compress(record(f"u{n}", random.Random(n).randbytes(3000))) for n in range(5)]
    members[2] = members[2][:1000] + bytes(200) + members[2][1200:]
    for split in (500, 1 << 20):
        got = read(b"".join(members), split)
        assert [len(b) for _, b, cut in got if not cut] == [3000] * 4


def test_separators_where_a_read_buffer_ends(spark, tmp_path):
    """Payloads that end in line breaks, the separator at every place around 64 KB."""
    def record(url, payload):
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"

    want = {}
    for k in range(20):
        head = len(record(f"a{k:02}", "")) + 1  # the length has five digits
        want |= {f"a{k:02}": "x" * (65536 - head - k) + "\r\n\r\n", f"b{k:02}": "y\r\n", f"c{k:02}": "z"}
        text = "".join(record(f"{n}{k:02}", want[f"{n}{k:02}"]) for n in "abc")
        (tmp_path / f"{k}.warc").write_bytes(text.encode())
    for records in (web_archive.read_warc(spark, str(tmp_path)), warc_source.read_archives(spark, str(tmp_path))):
        rows = records.select("url", "payload", "cut_short").collect()
        assert len(rows) == len(want) and {r["url"]: r["payload"] for r in rows} == want
        assert not any(r["cut_short"] for r in rows)
