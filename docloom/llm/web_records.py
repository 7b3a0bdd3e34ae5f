"""Web archives with segmented records: write pages, read them back whole.

A record longer than a segment is cut into a first record and continuations that name
its identifier and count up; the last one states the total length.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equal payloads of this many bytes or more are stored once.
REVISIT_BYTES = 1000
SEGMENT_BYTES = 64 * 1024
#: Records in a file: with the segment length, the bound of what a reader holds at once.
FILE_RECORDS = 1024
CHUNK_BYTES = 8 * 1024
END = "\r\n\r\n"


def page_records(pages: DataFrame, url: str = "url", body: str = "html", id_column: str = "page_id") -> DataFrame:
    """Pages with ``payload``, ``n_bytes``, ``digest``, ``kind`` and ``origin``.

    Of equal payloads of ``REVISIT_BYTES`` or more, the page with the largest id is the
    response and the others revisit it; rows tied on that id are all responses, and so
    are pages without an id where no other page has one.  A null body is an empty
    payload, a null url stays without a target.
    """
    held = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload"))
    held = held.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload"))
    large = held.filter(F.col("n_bytes") >= REVISIT_BYTES)
    # Partial sums meet before the shuffle: a payload shared by a third of the pages is a row a task.
    first = large.groupBy("digest").agg(F.max("page_id").alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = held.join(first, "digest", "left")
    again = (F.col("n_bytes") >= REVISIT_BYTES) & F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    return joined.withColumn("kind", F.when(again, "revisit").otherwise("response")).withColumn("origin", F.when(again, F.col("origin")))


def record_id(page_id: Column, digest: Column) -> Column:
    """A urn made from the page's id and payload: repeated rows, alike byte for byte, share it."""
    h = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    groups = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; a line whose value is null is left out."""
    parts = [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n")) for name, value in pairs]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def write_pages(
    pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, compression: str = "gzip"
) -> None:
    """Writes one record for each page, cut into segments, as archive files.

    The payload travels in chunked transfer framing.  Spark's text writer puts the two
    line breaks after each record and commits whole files only.  A file starts anew after
    ``FILE_RECORDS`` segments; files are compressed, as archives usually are, unless
    ``compression`` is "none".
    """
    rows = page_records(pages)
    size = F.length("payload")
    crlf = F.lit("\r\n").cast("binary")

    def chunk(at: Column) -> Column:
        framed = F.lower(F.hex(F.least(F.lit(chunk_bytes), size - at + 1).cast("long"))).cast("binary")
        # A string holds any bytes; the cast only lets the pieces be joined.
        return F.concat(framed, crlf, F.substring(F.col("payload"), at, F.lit(chunk_bytes)), crlf).cast("string")

    starts = F.when(size > 0, F.sequence(F.lit(1), size, F.lit(chunk_bytes))).otherwise(F.array().cast("array<int>"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n")
    body = F.concat(F.array_join(F.transform(starts, chunk), ""), F.lit("0\r\n\r\n"))
    joined = F.concat(http, F.lit("Transfer-Encoding: chunked\r\n\r\n"), body).cast("binary")
    block = F.when(F.col("kind") == "response", joined).otherwise(F.concat(http, F.lit("\r\n")).cast("binary"))
    rows = rows.select("page_id", "url", "digest", "kind", "origin", block.alias("block"))
    total = F.length("block")
    cuts = F.sequence(F.lit(1), F.greatest(total, F.lit(1)), F.lit(segment_bytes))
    rows = rows.select("*", F.posexplode(cuts).alias("n", "at"))
    part = F.substring(F.col("block"), F.col("at"), F.lit(segment_bytes))
    first, last, cut = F.col("n") == 0, F.col("at") + segment_bytes > total, total > segment_bytes
    own = record_id(F.col("page_id"), F.col("digest"))
    segment_id = F.concat(F.substring(own, 1, 46), F.lit("-"), F.col("n") + 1, F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _lines(
            ("WARC-Type", F.when(first, F.col("kind")).otherwise("continuation")),
            ("WARC-Record-ID", F.when(first, own).otherwise(segment_id)),
            ("WARC-Date", "2024-01-01T00:00:00Z"),
            ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
            ("X-Page-ID", F.when(first, F.col("page_id").cast("string"))),
            ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
            ("WARC-Refers-To", F.when(first & F.col("origin").isNotNull(), record_id(F.col("origin"), F.col("digest")))),
            ("WARC-Segment-Number", F.when(cut, (F.col("n") + 1).cast("string"))),
            ("WARC-Segment-Origin-ID", F.when(~first, own)),
            ("WARC-Segment-Total-Length", F.when(cut & last, total.cast("string"))),
            ("Content-Type", F.when(first, "application/http; msgtype=response")),
            ("Content-Length", F.length(part).cast("string")),
        ),
        F.lit("\r\n"),
    )
    record = F.concat(header.cast("binary"), part).cast("string").alias("value")
    rows.select(record).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", compression).text(folder)


SEGMENT = (
    "record_id string, origin_id string, number int, total long, kind string, page_id string, url string, "
    "digest string, refers_to string, block binary, error string"
)
_SEGMENT_ARROW = pa.schema(
    [(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in SEGMENT.split(", "))]
)
BATCH_BYTES = 2 << 20


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of an archive file, plain or compressed, cut by their stated lengths.

    A record that is not closed as it should be gets an ``error`` and ends the file.
    """
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        close = content.find(b"\r\n\r\n", at)
        lines = content[at : max(close, at)].split(b"\r\n")
        if not lines[0].startswith(b"WARC/1."):
            yield {"error": "no record header"}
            return
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        n = int(fields.get("content-length", -1))
        block = content[close + 4 : close + 4 + max(n, 0)]
        after = close + 4 + max(n, 0)
        whole = n >= 0 and len(block) == n and content[after : after + 4] == b"\r\n\r\n"
        number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
        yield {
            "record_id": fields.get("warc-record-id"),
            "origin_id": fields.get("warc-segment-origin-id"),
            "number": int(number) if number else None,
            "total": int(total) if total else None,
            "kind": fields.get("warc-type"),
            "page_id": fields.get("x-page-id"),
            "url": fields.get("warc-target-uri"),
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "refers_to": fields.get("warc-refers-to"),
            "block": block,
            "error": None if whole else "record cut short",
        }
        if not whole:
            return
        at = after + 4


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """``content`` of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content")


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The records that are cut into segments, one row a segment."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                cut = (r for r in parse_archive(content.as_py()) if r.get("number") is not None)
                yield from _in_batches(cut, lambda r: len(r["block"]), _SEGMENT_ARROW)

    return archive_files(spark, folder).mapInArrow(parse, SEGMENT)


def reassemble(segments: DataFrame) -> DataFrame:
    """Segmented records whole again, in the columns of ``read_segments``.

    Segments meet by the identifier of the first one and are joined by number.  A gap or
    a length other than the stated total is an ``error``.  A record that was stored k
    times, alike byte for byte, comes back k times.  One record is one row, so a group
    is never longer than a record.
    """
    part = F.struct("number", "total", "block", "error", "kind", "page_id", "url", "digest", "refers_to")
    grouped = segments.groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(F.collect_list(part).alias("parts"))
    firsts = F.filter("parts", lambda p: p["number"] == 1)
    once = F.array_sort(F.array_distinct(F.transform("parts", lambda p: F.struct(p["number"].alias("number"), p["total"].alias("total"), p["block"].alias("block")))))
    rows = grouped.select("record_id", firsts.alias("firsts"), once.alias("parts"), F.exists("parts", lambda p: p["error"].isNotNull()).alias("bad"))
    rows = rows.select(
        "*",
        F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary").alias("block"),
        F.array_max(F.transform("parts", lambda p: p["total"])).alias("total"),
        F.transform("parts", lambda p: p["number"]).alias("numbers"),
    )
    gap = F.col("numbers") != F.sequence(F.lit(1), F.size("parts"))
    short = F.col("total").isNull() | (F.length("block") != F.col("total"))
    error = F.when(F.col("bad"), "record cut short").when(gap, "segments missing").when(short, "total length differs")
    rows = rows.withColumn("first", F.explode_outer("firsts"))
    return rows.select(
        "record_id", F.lit(None).cast("string").alias("origin_id"), F.lit(1).alias("number"), "total",
        F.col("first.kind").alias("kind"), F.col("first.page_id").alias("page_id"), F.col("first.url").alias("url"),
        F.col("first.digest").alias("digest"), F.col("first.refers_to").alias("refers_to"), "block",
        F.when(F.col("first").isNull(), "segments missing").otherwise(error).alias("error"),
    )


def dechunk(body: bytes) -> bytes:
    """The payload behind chunked transfer framing; ``ValueError`` if the framing is broken."""
    parts, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("no chunk size")
        n = int(body[at:line].partition(b";")[0], 16)
        if n == 0:
            return b"".join(parts)
        part = body[line + 2 : line + 2 + n]
        if len(part) != n or body[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("chunk cut short")
        parts.append(part)
        at = line + 4 + n


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(
        line.lower().startswith(b"transfer-encoding:") and b"chunked" in line.lower() for line in head.split(b"\r\n")
    )
    return dechunk(body) if chunked else body


RECORD = "record_id string, kind string, page_id string, url string, digest string, refers_to string, n_bytes long, payload binary, error string"


_RECORD_ARROW = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (f.split() for f in RECORD.split(", "))]
)


def _decoded(record: dict, with_payload: bool) -> dict:
    """A whole record in the fields of ``RECORD``: a response's payload is decoded and checked."""
    out = {n: record.get(n) for n in ("record_id", "kind", "page_id", "url", "digest", "refers_to", "error")}
    if out["error"] is None and out["kind"] == "response":
        try:
            payload = http_payload(record["block"])
        except ValueError as problem:
            out["error"] = str(problem)
        else:
            own = hashlib.sha1(payload).hexdigest()
            if out["digest"] and out["digest"] != own:
                out["error"] = "digest differs"
            out |= {"digest": own, "n_bytes": len(payload), "payload": payload if with_payload else None}
    return out


def _in_batches(records: Iterator[dict], size: Callable[[dict], int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for record in records:
        held.append(record)
        n += size(record) + 500
        if n >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def decode_records(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """Reassembled records with their payload decoded; ``n_bytes`` and ``digest`` are of that payload.

    A revisit has no payload of its own: its digest is the stated one, its length null.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ({c: batch.column(c)[k].as_py() for c in batch.schema.names} for k in range(batch.num_rows))
            yield from _in_batches((_decoded(r, with_payload) for r in rows), lambda r: len(r.get("payload") or b""), _RECORD_ARROW)

    return records.mapInArrow(decode, RECORD)


def read_pages(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives in a folder, whole and decoded, in the columns of ``RECORD``.

    Records of one segment are decoded where they were read; only segmented ones move.
    The files are parsed once for either kind, which is cheaper than moving or storing
    all payloads.  Without ``with_payload`` payloads are measured, digested and let go.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                whole = (r for r in parse_archive(content.as_py()) if r.get("number") is None)
                yield from _in_batches((_decoded(r, with_payload) for r in whole), lambda r: len(r.get("payload") or b""), _RECORD_ARROW)

    single = archive_files(spark, folder).mapInArrow(parse, RECORD)
    return single.unionByName(decode_records(reassemble(read_segments(spark, folder)), with_payload))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with ``refers_to_page`` and the full payload's ``n_bytes``, revisits included."""
    targets = records.filter(F.col("kind") == "response").groupBy(F.col("record_id").alias("refers_to"))
    targets = targets.agg(F.max("page_id").alias("refers_to_page"), F.max("n_bytes").alias("full_bytes"))
    plain = records.filter(F.col("kind") != "revisit").withColumn("refers_to_page", F.lit(None).cast("string"))
    again = records.filter(F.col("kind") == "revisit").join(targets, "refers_to", "left")
    again = again.withColumn("n_bytes", F.col("full_bytes")).drop("full_bytes")
    return plain.unionByName(again)
