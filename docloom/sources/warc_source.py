"""Web archives as a data source: files are read in byte ranges, compressed ones too.

A compressed archive is a row of gzip members, one or more records each.  A task takes a
byte range: it looks for the first record (plain files) or member (compressed files) that
begins in it, and reads until one begins beyond it.  What looks like a beginning counts
only if it ends where the next one begins, or with the file, by the length it states or
by the checksum of the member; bytes inside a payload that look like a record do not.  A
whole archive inside a payload of an uncompressed file cannot be told from records;
``gaps`` shows whether the ranges of a read meet.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of an archive that a task reads.
SPLIT_BYTES = 128 << 20
CHUNK = 1 << 20
#: Bytes of payloads in one batch of rows.
BATCH_BYTES = 8 << 20

#: What gzip members and records begin with, and what ends a head.
MEMBER = b"\x1f\x8b\x08"
RECORD = re.compile(rb"WARC/1\.\d\r\n")
HEAD_END = b"\r\n\r\n"

SCHEMA = "file string, begin long, end long, part int, rec_type string, url string, payload string, cut_short boolean"
ARROW = pa.schema([
    ("file", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("part", pa.int32()),
    ("rec_type", pa.string()), ("url", pa.string()), ("payload", pa.string()), ("cut_short", pa.bool_()),
])


def _header(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return found[1].strip() if found else None


def _length(head: bytes) -> int | None:
    stated = _header(head, b"Content-Length")
    return int(stated) if stated is not None and stated.isdigit() else None


@dataclass
class Record:
    begin: int
    end: int
    head: bytes
    block: bytes
    cut_short: bool


class _Window:
    """Bytes of a stream from a place on; ``need`` says whether so many are there."""

    def __init__(self, chunks: Iterator[bytes], at: int = 0):
        self.chunks, self.held, self.at = chunks, bytearray(), at

    def need(self, n: int) -> bool:
        while len(self.held) < n:
            chunk = next(self.chunks, None)
            if chunk is None:
                return False
            self.held += chunk
        return True

    def find(self, mark: bytes, begin: int = 0) -> int:
        while True:
            place = self.held.find(mark, begin)
            if place >= 0:
                return place
            begin = max(begin, len(self.held) - len(mark) + 1)
            if not self.need(len(self.held) + 1):
                return -1

    def drop(self, n: int) -> None:
        del self.held[:n]
        self.at += n


def stream_records(chunks: Iterator[bytes], at: int = 0, until: Callable[[int], bool] = lambda place: False) -> Iterator[Record]:
    """The records of a stream that begins at one, to the end or to the first beginning ``until`` holds for.

    A block without ``Content-Length`` ends before the next record or with the stream.  A
    record the stream ends in is ``cut_short``.  Reading ends at bytes that are no record.
    """
    window = _Window(chunks, at)
    while True:
        while window.need(1) and window.held[:1] in b"\r\n":
            window.drop(1)
        if until(window.at) or not window.need(10) or not RECORD.match(window.held):
            return
        head_end = window.find(HEAD_END)
        if head_end < 0:
            yield Record(window.at, window.at + len(window.held), bytes(window.held), b"", True)
            return
        head, body = bytes(window.held[:head_end]), head_end + 4
        length = _length(head)
        if length is None:
            following = window.find(HEAD_END + b"WARC/1.", body)
            stop = following if following >= 0 else len(window.held.rstrip(b"\r\n"))
            length = max(0, stop - body)
        whole = window.need(body + length)
        block = bytes(window.held[body : body + length])
        begin = window.at
        window.drop(body + len(block))
        yield Record(begin, window.at, head, block, not whole)


def _chunks(file: pa.NativeFile, at: int) -> Iterator[bytes]:
    """The file from a place on; a generator keeps its own place, so several may read on."""
    size = file.size()
    while at < size:
        file.seek(at)
        chunk = file.read(min(CHUNK, size - at))
        at += len(chunk)
        yield chunk


class Member:
    """One gzip member: ``bytes`` streams its content, then ``end`` is the place behind it."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at, self.end, self.whole, self.broken = file, at, file.size(), False, False

    def bytes(self) -> Iterator[bytes]:
        engine, read = zlib.decompressobj(31), self.at
        for chunk in _chunks(self.file, self.at):
            read += len(chunk)
            while chunk:
                try:
                    out = engine.decompress(chunk, CHUNK)
                except zlib.error:
                    self.broken = True
                    return
                if out:
                    yield out
                if engine.eof:
                    self.end, self.whole = read - len(engine.unused_data), True
                    return
                chunk = engine.unconsumed_tail


def _begins_member(file: pa.NativeFile, at: int) -> bool:
    """Whether a member with records begins here and another, or nothing, behind it."""
    member, first = Member(file, at), b""
    for chunk in member.bytes():
        if len(first) < 10:
            first += chunk[:10]
            if len(first) >= 10 and not RECORD.match(first):
                return False
    if member.broken or not RECORD.match(first):
        return False
    file.seek(member.end)
    return not member.whole or file.read(3) in (MEMBER, b"")


def _begins_record(file: pa.NativeFile, at: int) -> bool:
    """Whether a record begins here and another, or nothing, where its length says."""
    window = _Window(_chunks(file, at))
    if not window.need(10) or not RECORD.match(window.held):
        return False
    head_end = window.find(HEAD_END)
    if head_end < 0 or _header(bytes(window.held[:head_end]), b"WARC-Type") is None:
        return False
    length = _length(bytes(window.held[:head_end]))
    if length is None:
        return False
    behind = at + head_end + 4 + length
    if behind >= file.size():
        return True
    file.seek(behind)
    following = file.read(16).lstrip(b"\r\n")
    return following == b"" or following.startswith(b"WARC/1.")


def _first(file: pa.NativeFile, begin: int, end: int, mark: bytes, holds: Callable[[pa.NativeFile, int], bool]) -> int | None:
    """The first place of the range where the mark stands and a beginning is proven."""
    at = begin
    window = _Window(_chunks(file, begin), begin)
    while True:
        place = window.held.find(mark)
        if place >= 0:
            at = window.at + place
            if at >= end:
                return None
            if holds(file, at):
                return at
            window.drop(place + 1)
        else:
            window.drop(max(0, len(window.held) - len(mark) + 1))
            if window.at >= end or not window.need(len(window.held) + 1):
                return None


def range_records(file: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[int, int, int, Record]]:
    """(begin, end, number in the member, record) of all that begins in a byte range.

    ``begin`` and ``end`` are places in the file: of the member if it is compressed, of
    the record if not.
    """
    file.seek(0)
    if file.read(3) == MEMBER:
        at = 0 if begin == 0 else _first(file, begin, end, MEMBER, _begins_member)
        while at is not None and (at < end or not _begins_member(file, at)):
            member, held = Member(file, at), None
            stream = member.bytes()
            # A row needs the member's end: the last record waits until it is known.
            for part, record in enumerate(stream_records(stream)):
                if held:
                    yield at, -1, part - 1, held
                held, last = record, part
            for _ in stream:
                pass
            if held:
                yield at, member.end, last, held
            if member.broken:
                at = _first(file, at + len(MEMBER), end, MEMBER, _begins_member)
            else:
                at = member.end if member.end < file.size() else None
        return
    at = 0 if begin == 0 else _first(file, begin, end, b"WARC/1.", _begins_record)
    if at is not None:
        for record in stream_records(_chunks(file, at), at, lambda place: place >= end and _begins_record(file, place)):
            yield record.begin, record.end, 0, record


def _row(file: str, begin: int, end: int, part: int, record: Record) -> tuple:
    block = record.block
    if block.startswith(b"HTTP/"):
        block = block.partition(HEAD_END)[2]
    kind, url = _header(record.head, b"WARC-Type"), _header(record.head, b"WARC-Target-URI")
    shown = [v.decode("utf-8", "replace") if v is not None else "" for v in (kind, url)]
    return file, begin, None if end < 0 else end, part, *shown, block.decode("utf-8", "replace"), record.cut_short


@dataclass
class ByteRange(InputPartition):
    file: str
    begin: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, types: frozenset[str]):
        self.path, self.split_bytes, self.types = path, split_bytes, types

    def partitions(self) -> list[ByteRange]:
        fs, path = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        shown = [f for f in files if f.is_file and f.size and not f.base_name.startswith((".", "_"))]
        return [ByteRange(f.path, at, min(at + self.split_bytes, f.size)) for f in shown for at in range(0, f.size, self.split_bytes)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read is one task all the same
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        with fs.open_input_file(partition.file) as file:
            for begin, end, part, record in range_records(file, partition.begin, partition.end):
                kind = (_header(record.head, b"WARC-Type") or b"").decode("utf-8", "replace")
                if self.types and kind not in self.types:
                    continue
                rows.append(_row(partition.file, begin, end, part, record))
                size += len(record.block)
                if size >= BATCH_BYTES or len(rows) >= 10_000:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    held: str
    file: str


class WarcWriter(DataSourceArrowWriter):
    """One file a task, under a hidden name until the job commits; a record a member."""

    def __init__(self, path: str, compressed: bool):
        self.path, self.compressed = path, compressed

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.compressed else ''}"
        written = Written(f"{path}/.{name}", f"{path}/{name}")
        stamp = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        with fs.open_output_stream(written.held, compression=None) as out:
            for batch in iterator:
                for row in batch.select(["rec_type", "url", "block"]).to_pylist():
                    block = row["block"] or b""
                    head = (
                        f"WARC/1.1\r\nWARC-Type: {row['rec_type']}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {stamp}\r\n"
                        f"WARC-Target-URI: {row['url'] or ''}\r\nContent-Length: {len(block)}\r\n\r\n"
                    ).encode()
                    whole = head + block + b"\r\n\r\n"
                    if self.compressed:
                        engine = zlib.compressobj(wbits=31)
                        whole = engine.compress(whole) + engine.flush()
                    out.write(whole)
        return written

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            if message is not None:
                fs.move(message.held, message.file)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            if message is not None:
                fs.delete_file(message.held)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options ``path``, ``split_bytes`` and ``types`` (commas between)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        types = frozenset(filter(None, self.options.get("types", "").split(",")))
        return WarcReader(_uri(self.options["path"]), int(self.options.get("split_bytes", SPLIT_BYTES)), types)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(_uri(self.options["path"]), self.options.get("compressed", "true") == "true")


def _uri(path: str) -> str:
    """The path as other readers than Hadoop's name it."""
    path = path.replace("s3a://", "s3://", 1)
    return path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def read_archives(spark: SparkSession, path: str, types: tuple[str, ...] = (), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records under a path, plain or compressed by member, in tasks of byte ranges.

    ``rec_type``, ``url``, ``payload`` and ``cut_short`` as ``read_warc`` gives them, and
    where a record stands: ``file``, ``begin``, ``end`` and, in a member of several
    records, ``part`` (``end`` is null for all but the member's last).  Records of other
    ``types`` are dropped as they are read.  Files must not be compressed as one whole:
    such a file is one member, so one task.  A file cut inside a record gives what is
    there, marked; a damaged member what can be unpacked, and reading goes on behind it.  Empty and hidden files give no rows.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("types", ",".join(types)).option("split_bytes", str(split_bytes)).load(path)


def write_archives(records: DataFrame, path: str, compressed: bool = True) -> None:
    """``rec_type``, ``url`` and ``block`` (text or bytes) as archive files, one for each partition."""
    records.sparkSession.dataSource.register(WarcSource)
    chosen = records.select(F.col("rec_type").cast("string"), F.col("url").cast("string"), F.col("block").cast("binary"))
    chosen.write.format("warc").mode("append").option("compressed", str(compressed).lower()).save(path)


def gaps(records: DataFrame) -> DataFrame:
    """(file, end, begin): places of a whole read where what follows does not begin at the end.

    Line breaks between records are no gap.  The rows are three numbers a record.
    """
    places = records.filter(F.col("end").isNotNull()).select("file", "begin", "end")
    following = F.lead("begin").over(Window.partitionBy("file").orderBy("begin"))
    return places.select("file", "end", following.alias("begin")).filter(~F.col("begin").between(F.col("end"), F.col("end") + 4))
